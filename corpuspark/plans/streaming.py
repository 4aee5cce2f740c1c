"""Streams over the given tables, run to their end; each equals a batch query."""

import uuid

from pyspark.sql import functions as F

from corpuspark.operators import audit
from corpuspark.plans.base import query
from corpuspark.plans.ingest import simhash_sql
from corpuspark.sources.staging import fresh_path, staged
from corpuspark.sources.views import VIEWS
from corpuspark.streaming import streams

#: A last row far in the future moves the watermark past all windows.
END = "2100-01-01"
PARTS = 3


def stream_of(v, name: str, rows=None, part=None, last=None):
    """The rows as a stream of Parquet files in ``PARTS`` batches, and a place for its output. ``part`` numbers the batch of a row; by default rows
    are dealt out by hash, so that each batch has rows earlier than some before it. ``last`` rows come in a batch of their own.

    A batch is as many files as tasks read the table, so that no task writes or reads a batch alone. Files without rows make up the number where
    some tasks have none, as the stream takes the same number of files for each batch."""
    rows = getattr(v, name) if rows is None else rows
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(PARTS)) if part is None else part
    path = fresh_path(v.spark, f"stream-{name}")
    numbered = staged(rows.withColumn("_part", part.cast("int")), f"rows-{name}")
    tasks, written = numbered.rdd.getNumPartitions(), 0
    for k in range(PARTS):
        numbered.where(F.col("_part") == k).drop("_part").write.mode("append").parquet(path)
        there = len(v.spark.read.schema(rows.schema).parquet(path).inputFiles())
        for _ in range(written + tasks - there):
            rows.where("false").coalesce(1).write.mode("append").parquet(path)
        written += tasks
    if last is not None:
        last.coalesce(1).write.mode("append").parquet(path)
    return streams.read_log(v.spark, path, rows.schema, tasks), f"{path}-out-{uuid.uuid4().hex[:8]}"


def in_order(rows, column: str):
    """The part of a row so that parts follow each other by ``column``."""
    least, most = rows.agg(F.min(column), F.max(column)).first()
    return F.floor((F.col(column) - least) * PARTS / ((most or 0) - (least or 0) + 1))


def finished(v, stream, out):
    streams.run_once(stream, f"{out}/rows", f"{out}/checkpoint")
    return v.spark.read.schema(stream.schema).parquet(f"{out}/rows")


def with_end(rows):
    """One row far in the future, so that every real window closes."""
    return rows.limit(1).select(*(F.to_timestamp_ntz(F.lit(END)).alias(c) if c == "created_at" else F.col(c) for c in rows.columns))


@query("t1_tumbling_metrics", "SELECT CAST(date_trunc('hour', created_at) AS VARCHAR) AS start, tenant_id, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM {v_cost_log} GROUP BY 1, 2")
def t1(v):
    rows = v.v_cost_log
    stream, out = stream_of(v, "cost_log", rows, last=with_end(rows))
    windows = streams.tumbling_metrics(streams.with_event_time(stream, late="100 days"))
    return finished(v, windows, out).where(f"start < '{END}'").withColumn("start", F.col("start").cast("string"))


@query(
    "t2_sliding_p95",
    """SELECT CAST(time_bucket(INTERVAL 5 MINUTE, created_at) - k * INTERVAL 5 MINUTE AS VARCHAR) AS start, tenant_id, quantile_disc(latency_ms, 0.95) AS p95
FROM (SELECT *, CAST(unnest(range(12)) AS INT) AS k FROM {v_query_log}) GROUP BY 1, 2""",
)
def t2(v):
    stream, out = stream_of(v, "query_log", v.v_query_log, last=with_end(v.v_query_log))
    windows = streams.sliding_p95(streams.with_event_time(stream, late="100 days"))
    return finished(v, windows, out).where(f"start < '{END}'").withColumn("start", F.col("start").cast("string"))


@query(
    "t3_index_change_log",
    """WITH s AS (SELECT doc_key, max(seq) FILTER (event_type = 'index') AS indexed, max(seq) FILTER (event_type = 'delete') AS deleted, max(seq) FILTER (event_type = 'set_available') AS set_at,
  arg_max(available, seq) FILTER (event_type = 'set_available') AS set_to FROM {v_outbox} GROUP BY 1)
SELECT doc_key, indexed AS indexed_seq, CASE WHEN set_at > indexed THEN set_to ELSE 0 END AS available FROM s WHERE indexed > coalesce(deleted, -1)""",
)
def t3(v):
    stream, out = stream_of(v, "outbox", v.v_outbox.select("seq", "doc_key", "event_type", "available"))
    streams.index_change_log(stream, f"{out}/index", f"{out}/checkpoint").awaitTermination()
    return streams.read_index(v.spark, f"{out}/index")


@query("t4_dedupe_uploads", "SELECT tenant_id, sha256(content) AS content_hash FROM {v_file} GROUP BY 1, 2")
def t4(v):
    rows = v.v_file.select("tenant_id", "content", F.col("created_date").cast("timestamp_ntz").alias("created_at"))
    stream, out = stream_of(v, "uploads", rows)
    return finished(v, streams.dedupe_uploads(streams.with_event_time(stream, late="3650 days")), out).select("tenant_id", "content_hash")


AUDITED = """WITH r AS (SELECT *, lag(id) OVER w AS prior, id % 1000 <> 13 AS hashed, count(*) FILTER (id % 1000 <> 13) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n
  FROM {v_audit} WINDOW w AS (PARTITION BY tenant_id ORDER BY id))
SELECT id, hashed AND (id % 1000 = 11 OR (id % 1000 = 17 AND prior IS NOT NULL) OR (id % 1000 = 7 AND result <> 'tampered')) AS mismatch,
  id % 1000 = 11 AND coalesce(prior % 1000 <> 13, false) AS broken, NOT hashed OR ((id % 1000 = 17 OR prior IS NULL) AND n > 0) AS gap FROM r"""


def bent_chain(v):
    """A chain with changed fields, links and hashes, as a stream in order of ids."""
    built = audit.build_chain(v.v_audit)
    kind = F.col("id") % 1000
    bent = built.withColumns(
        {
            "result": F.when(kind == 7, "tampered").otherwise(F.col("result")),
            "prev_hash": F.when(kind == 11, "x").when(kind == 17, None).otherwise(F.col("prev_hash")),
            "row_hash": F.when(kind != 13, F.col("row_hash")),
        }
    )
    return stream_of(v, "audit", bent, in_order(bent, "id"))


@query("t5_verify_audit", AUDITED)
def t5(v):
    stream, out = bent_chain(v)
    streams.verify_audit(stream, out, f"{out}/checkpoint").awaitTermination()
    return v.spark.read.parquet(f"{out}/findings").select("id", "mismatch", "broken", "gap")


@query("t5_audit_findings", AUDITED)
def t5_stateful(v):
    stream, out = bent_chain(v)
    return finished(v, streams.audit_findings(stream), out).select("id", "mismatch", "broken", "gap")


@query(
    "t6_meter_usage",
    """WITH s AS (SELECT *, sum(doc_delta) OVER w AS d, sum(doc_delta * bytes) OVER w AS b FROM {v_meter_event} WINDOW w AS (PARTITION BY tenant_id, period ORDER BY seq))
SELECT tenant_id, period, (arg_max(d, seq) - least(0, min(d)))::BIGINT AS docs, (arg_max(b, seq) - least(0, min(b)))::BIGINT AS bytes FROM s GROUP BY 1, 2""",
)
def t6(v):
    stream, out = stream_of(v, "v_meter_event", None, in_order(v.v_meter_event, "seq"))
    streams.meter_usage(stream, f"{out}/usage", f"{out}/checkpoint").awaitTermination()
    return streams.latest(v.spark, f"{out}/usage", streams.USAGE)


@query(
    "t6_running_usage",
    """WITH s AS (SELECT *, sum(doc_delta) OVER w AS d, sum(doc_delta * bytes) OVER w AS b FROM {v_meter_event} WINDOW w AS (PARTITION BY tenant_id, period ORDER BY seq))
SELECT tenant_id, period, max(seq) AS seq, (arg_max(d, seq) - least(0, min(d)))::BIGINT AS docs, (arg_max(b, seq) - least(0, min(b)))::BIGINT AS bytes FROM s GROUP BY 1, 2""",
)
def t6_running(v):
    stream, out = stream_of(v, "v_meter_event", None, in_order(v.v_meter_event, "seq"))
    rows = finished(v, streams.running_usage(stream), out)
    last = F.max_by(F.struct("seq", "docs", "bytes"), "seq").alias("last")
    return rows.groupBy("tenant_id", "period").agg(last).select("tenant_id", "period", "last.*")


ARRIVED = r"""WITH d AS (SELECT doc_id AS file_id, trim(text, ' ' || chr(10)) AS body FROM {documents} WHERE trim(text, ' ' || chr(10)) <> ''),
t AS (SELECT file_id, regexp_extract_all(body, '[\pL\pN_]+|[^\s\pL\pN_]|\s+') AS t FROM d),
w AS (SELECT file_id, t, unnest(range(0, 1 + CAST(ceil(greatest(0, len(t) - 512) / 460.0) AS BIGINT))) AS k FROM t),
c AS (SELECT file_id, CAST(k AS BIGINT) AS chunk_order, trim(array_to_string(t[460 * k + 1 : 460 * k + 512], ''), ' ' || chr(10)) AS content, file_id || ':' || k AS k0 FROM w)"""


@query(
    "t7_document_arrivals",
    f"""{ARRIVED}, {simhash_sql("c", "k0", "content", "sh")}
SELECT file_id, chunk_order, sha256(content) AS content_hash, h AS simhash FROM c JOIN sh USING (k0)""",
)
def t7(v):
    stream, out = stream_of(v, "documents")
    files = stream.select(F.col("doc_id").alias("file_id"), "text")
    streams.ingest_arrivals(files, f"{out}/chunks", f"{out}/checkpoint").awaitTermination()
    return v.spark.read.parquet(f"{out}/chunks").select("file_id", "chunk_order", "content_hash", "simhash")


@query("s10_append_log", f"SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(*) AS n FROM ({VIEWS['v_query_log']}) GROUP BY 1")
def s10(v):
    rows = v.v_query_log
    out = fresh_path(v.spark, "log")
    for half in (0, 1):  # two appends
        streams.append_log(rows.where(F.col("id") % 2 == half), out)
    return v.spark.read.parquet(out).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))
