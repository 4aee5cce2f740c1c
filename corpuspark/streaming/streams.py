"""Structured Streaming forms of the log metrics, the change log, deduplication, audit verification, metering and document arrivals.

Windows and deduplication are streaming DataFrames with Spark's own state. What needs an order or a whole document runs on each
micro-batch with DataFrame operators; the little that goes from batch to batch is a table of its own for each batch, so a batch that
runs twice starts from the same table and writes the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpuspark.operators import chunk, parse
from corpuspark.operators.audit import TAILS, canonical_payload, chain_findings, meter_from, meter_walk, row_hash
from corpuspark.operators.versions import change_state, indexed_documents, merge_states
from corpuspark.sources.numbered import batches_in, keep_last, latest, remove, write_number  # noqa: F401

BUCKETS = 64
STATE = "doc_key {}, indexed long, deleted long, set_at long, set_to int, indexed_as int"


def read_log(spark: SparkSession, path: str, schema, per_trigger: int = 1000) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def each_batch(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def with_event_time(logs: DataFrame, column: str = "created_at", late: str = "1 hour") -> DataFrame:
    """Time stamps without zone are taken as UTC; rows later than the watermark are dropped by what follows."""
    return logs.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def tumbling_metrics(logs: DataFrame, width: str = "1 hour") -> DataFrame:
    """Rows and tokens by tenant and hour."""
    return logs.groupBy(F.window("created_at", width).alias("w"), "tenant_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).select(
        F.col("w.start").alias("start"), "tenant_id", "n", "tokens"
    )


def sliding_p95(logs: DataFrame, width: str = "1 hour", slide: str = "5 minutes") -> DataFrame:
    """Approximate 95th percentile of the latency by tenant in sliding windows."""
    return logs.groupBy(F.window("created_at", width, slide).alias("w"), "tenant_id").agg(F.percentile_approx("latency_ms", 0.95, 10_000).alias("p95")).select(
        F.col("w.start").alias("start"), "tenant_id", "p95"
    )


POINTERS = "bucket int, number long"


def index_change_log(events: DataFrame, index_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the state of every document at ``index_path``. A batch reads and writes only the hash buckets that it touches, as files of its own;
    a small table of pointers (bucket, batch), written last, says which files are live, so readers see whole batches only."""
    key = events.schema["doc_key"].dataType.simpleString()

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("doc_key"), F.lit(BUCKETS)).cast("int").alias("bucket")
        fresh = change_state(batch).select("*", bucket)
        pointers = {r.bucket: r.number for r in latest(spark, f"{index_path}/pointers", POINTERS, number).collect()}  # at most BUCKETS rows
        touched = sorted(r.bucket for r in fresh.select("bucket").distinct().collect())
        paths = [f"{index_path}/states/batch={pointers[b]}/bucket={b}" for b in touched if b in pointers]
        old = spark.read.schema(STATE.format(key)).parquet(*paths) if paths else spark.createDataFrame([], STATE.format(key))
        merged = merge_states(old.unionByName(fresh.drop("bucket")))
        write_number(merged.select("*", bucket), f"{index_path}/states", number, "bucket")
        live = spark.createDataFrame(sorted((pointers | dict.fromkeys(touched, number)).items()), POINTERS)
        write_number(live.coalesce(1), f"{index_path}/pointers", number)
        for b in touched:  # what a repetition of this batch reads stays; older files of these buckets have no pointer any more
            for old in superseded(spark, f"{index_path}/states", b, pointers.get(b, -1)):
                remove(spark, old)
        keep_last(spark, f"{index_path}/pointers", number)

    return each_batch(events, apply, checkpoint, **trigger)


def superseded(spark: SparkSession, folder: str, bucket: int, number: int) -> list[str]:
    """A bucket's folders in batches before ``number``."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.globStatus(path(f"{folder}/batch=*/bucket={bucket}")) or ()]
    return [p.toString() for p in found if int(p.getParent().getName().split("=")[1]) < number]


def read_index(spark: SparkSession, index_path: str, key: str = "long") -> DataFrame:
    """The documents of the index as of the last whole batch."""
    live = latest(spark, f"{index_path}/pointers", POINTERS).collect()
    paths = [f"{index_path}/states/batch={r.number}/bucket={r.bucket}" for r in live]
    states = spark.read.schema(STATE.format(key)).parquet(*paths) if paths else spark.createDataFrame([], STATE.format(key))
    return indexed_documents(states)


def dedupe_uploads(files: DataFrame) -> DataFrame:
    """The first upload of each content in a tenant within the watermark."""
    return files.withColumn("content_hash", F.sha2("content", 256)).dropDuplicatesWithinWatermark(["tenant_id", "content_hash"])


def verify_audit(rows: DataFrame, out_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Findings for each chained row (tenant_key, id, mismatch, broken, gap) at ``out_path``/findings. Rows are compared with those before them in
    id order, a large tenant in several ranges; what goes on is one row a tenant, its last hash. Rows must come in the order of ids from
    batch to batch."""

    def apply(batch: DataFrame, number: int) -> None:
        tenant = F.coalesce(F.col("tenant_id").cast("string"), F.lit("")).alias("tenant_key")
        slim = batch.select(tenant, "id", "prev_hash", "row_hash", row_hash(F.col("prev_hash"), canonical_payload(batch)).alias("expected"))
        findings, tails = chain_findings(slim, latest(batch.sparkSession, f"{out_path}/tails", TAILS, number))
        write_number(findings, f"{out_path}/findings", number)
        write_number(tails, f"{out_path}/tails", number)
        keep_last(batch.sparkSession, f"{out_path}/tails", number)

    return each_batch(rows, apply, checkpoint, **trigger)


FINDINGS = "tenant_key string, id long, mismatch boolean, broken boolean, gap boolean"


def audit_findings(rows: DataFrame) -> DataFrame:
    """The findings of ``verify_audit`` as a stateful stream: Spark keeps each tenant's last hash and whether it had any. A tenant's rows of one
    batch are one group, so batches should be small; ``verify_audit`` is the form for tenants with very many rows in a batch."""

    def check(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, started = state.get if state.exists else (None, False)
        part = pd.concat(list(frames)).sort_values("id")
        link, own = (part[c].where(part[c].notna(), None).to_numpy(object) for c in ("prev_hash", "row_hash"))
        there, free = own != None, link == None  # noqa: E711
        above = np.concatenate([[last], own[:-1]])
        begun = started | (np.cumsum(there) - there > 0)
        broken = there & ~free & (above != None) & (link != above)  # noqa: E711
        state.update((own[-1], bool(started or there.any())))
        columns = {"tenant_key": key[0], "id": part.id, "mismatch": there & (part.expected.to_numpy(object) != own), "broken": broken, "gap": ~there | (free & begun)}
        yield pd.DataFrame(columns).astype({c: bool for c in ("mismatch", "broken", "gap")})

    tenant = F.coalesce(F.col("tenant_id").cast("string"), F.lit("")).alias("tenant_key")
    slim = rows.select(tenant, "id", "prev_hash", "row_hash", row_hash(F.col("prev_hash"), canonical_payload(rows)).alias("expected"))
    return slim.groupBy("tenant_key").applyInPandasWithState(check, FINDINGS, "last string, started boolean", "append", GroupStateTimeout.NoTimeout)


USAGE = "tenant_id long, period string, docs long, bytes long"


def meter_usage(events: DataFrame, out_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Running usage of each tenant-month, never below 0, at ``out_path`` as of each batch, whose events apply in the order of seq."""

    def apply(batch: DataFrame, number: int) -> None:
        write_number(meter_from(meter_walk(batch), latest(batch.sparkSession, out_path, USAGE, number)), out_path, number)
        keep_last(batch.sparkSession, out_path, number)

    return each_batch(events, apply, checkpoint, **trigger)


RUNNING = "tenant_id long, period string, seq long, docs long, bytes long"


def running_usage(events: DataFrame) -> DataFrame:
    """The counters of each tenant-month after each batch that touches it, with the last seq, from state that Spark keeps: two whole numbers a
    tenant-month. Within a batch events apply in the order of seq; batches must follow each other by it. It goes on from its checkpoint."""

    def walk(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = np.array(state.get if state.exists else (0, 0), np.int64)
        steps = pd.concat(list(frames)).sort_values("seq")  # a batch's events of one tenant-month
        change = steps.doc_delta.to_numpy(np.int64)
        sums = used + np.cumsum(np.stack([change, change * steps.bytes.to_numpy(np.int64)], 1), 0)
        docs, size = (sums[-1] - np.minimum(0, sums.min(0))).tolist()  # a running sum that never goes below 0
        state.update((docs, size))
        yield pd.DataFrame({"tenant_id": [key[0]], "period": [key[1]], "seq": [steps.seq.iloc[-1]], "docs": [docs], "bytes": [size]})

    return events.groupBy("tenant_id", "period").applyInPandasWithState(walk, RUNNING, "docs long, bytes long", "append", GroupStateTimeout.NoTimeout)


def ingest_arrivals(docs: DataFrame, out_path: str, checkpoint: str, size: int = chunk.SIZE, overlap: float = chunk.OVERLAP, **trigger) -> StreamingQuery:
    """Documents (file_id, text) as they arrive: parsed to blocks, cut to chunks, each with its content hash and fingerprint."""

    def apply(batch: DataFrame, number: int) -> None:
        chunks = chunk.chunk_naive(parse.parse_markdown(batch), size, overlap)
        write_number(chunks.select("*", chunk.content_hash(F.col("content")).alias("content_hash"), chunk.simhash64("content").alias("simhash")), out_path, number)

    return each_batch(docs, apply, checkpoint, **trigger)


def append_log(rows: DataFrame, path: str, time_column: str = "created_at") -> None:
    """Append log rows to a table partitioned by day."""
    rows.withColumn("day", F.to_date(time_column)).write.mode("append").partitionBy("day").parquet(path)


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run an append-mode stream over all that is there now, into Parquet files."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
