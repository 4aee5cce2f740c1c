"""Versioned publish, incremental refresh, change logs, retention and reconciliation.

A version's rows are immutable; which version of a file is live is a small pointer table (file_id, active_version, ...) that is
rewritten last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuspark.sources.numbered import batches_in, latest, write_number
from corpuspark.sources.staging import staged

EVENTS_PER_DELETE = 500
MAX_ATTEMPTS = 3


def dedupe_upload(files: DataFrame) -> DataFrame:
    """Each file of a tenant with the first file of equal content: (file_id, tenant_id, kept_id, reused). The first is an aggregate, so that
    the many copies of one content are never sorted together."""
    hashed = files.select("file_id", "tenant_id", "created_date", F.sha2("content", 256).alias("hash"))
    first = hashed.groupBy("tenant_id", "hash").agg(F.min(F.struct("created_date", "file_id")).alias("first"))
    kept = first.select(F.col("tenant_id").alias("t"), F.concat("hash", F.lit("")).alias("h"), F.col("first.file_id").alias("kept_id"))
    joined = hashed.join(kept, F.col("tenant_id").eqNullSafe(F.col("t")) & F.col("hash").eqNullSafe(F.col("h")))
    return joined.select("file_id", "tenant_id", "kept_id", (F.col("kept_id") != F.col("file_id")).alias("reused"))


def next_version(files: DataFrame, versions: DataFrame) -> DataFrame:
    last = versions.groupBy("file_id").agg(F.max("version").alias("last"))
    return files.select("file_id").join(last, "file_id", "left").select("file_id", (F.coalesce("last", F.lit(0)) + 1).alias("next_version"))


def diff_chunks(new: DataFrame, previous: DataFrame) -> DataFrame:
    """New chunks (file_id, chunk_key, chunk_order, content) with the previous chunk of equal content, the last one if several."""
    hashed = F.sha2("content", 256)
    old = previous.groupBy("file_id", hashed.alias("hash")).agg(F.max_by("chunk_key", "chunk_order").alias("previous_key"))
    joined = new.withColumn("hash", hashed).join(old, ["file_id", "hash"], "left")
    return joined.select("file_id", "chunk_key", "chunk_order", "previous_key", F.col("previous_key").isNull().alias("fresh"))


def choose_mode(diff: DataFrame, targets: DataFrame, limit: float = 0.5) -> DataFrame:
    """(file_id, changed_ratio, mode): incremental where a previous version exists and at most ``limit`` of the chunks are fresh."""
    counted = diff.groupBy("file_id").agg(F.avg(F.col("fresh").cast("double")).alias("ratio"))
    ratio = F.coalesce("ratio", F.lit(0.0))
    mode = F.when((F.col("next_version") > 1) & (ratio <= limit), "incremental").otherwise("full")
    return targets.join(counted, "file_id", "left").select("file_id", ratio.alias("changed_ratio"), mode.alias("mode"))


def reuse_vectors(diff: DataFrame, previous_vectors: DataFrame, fresh_vectors: DataFrame) -> DataFrame:
    """(chunk_key, vector, reused): matched chunks take the previous vector, only the others need a new one."""
    old = previous_vectors.select(F.col("chunk_key").alias("previous_key"), F.col("vector").alias("old"))
    new = fresh_vectors.select("chunk_key", F.col("vector").alias("new"))
    joined = diff.join(old, "previous_key", "left").join(new, "chunk_key", "left")
    return joined.select("chunk_key", F.coalesce("old", "new").alias("vector"), F.col("old").isNotNull().alias("reused"))


def remap_summaries(sources: DataFrame, diff: DataFrame) -> DataFrame:
    """Summaries (file_id, summary_key, pos, chunk_key) whose sources all live on, with the new keys in order."""
    to_new = diff.where("NOT fresh").groupBy("previous_key").agg(F.max_by("chunk_key", "chunk_order").alias("new_key"))
    mapped = sources.join(to_new.withColumnRenamed("previous_key", "chunk_key"), "chunk_key", "left")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "new_key"))), lambda s: s.new_key)
    whole = mapped.groupBy("file_id", "summary_key").agg(F.every(F.col("new_key").isNotNull()).alias("alive"), ordered.alias("source_chunk_ids"))
    return whole.where("alive").drop("alive")


def publish(chunks: DataFrame, targets: DataFrame, pending: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks with available, pointers): the target version goes live and older ones go dark, but for files with pending events."""
    ready = targets.select("file_id", F.col("next_version").alias("target")).join(pending.select("file_id").distinct(), "file_id", "left_anti")
    flipped = chunks.join(ready, "file_id", "left")
    live = F.when(F.col("target").isNull(), F.lit(None).cast("int")).otherwise((F.col("version") == F.col("target")).cast("int"))
    pointers = ready.select("file_id", *(F.col("target").alias(f"active_{k}_version") for k in ("doc", "chunk", "summary", "anchor")))
    return flipped.withColumn("available", live).drop("target"), pointers


POINTERS = "file_id long, active_doc_version int, active_chunk_version int, active_summary_version int, active_anchor_version int"


def stage_version(chunks: DataFrame, path: str, number: int) -> None:
    """First half of a publish: the rows of the new versions as a table of their own. Nobody sees them before the flip."""
    write_number(chunks, f"{path}/chunks", number)


def flip(spark: SparkSession, targets: DataFrame, pending: DataFrame, path: str, number: int) -> None:
    """Second half of a publish: a small table of pointers, written last. It moves all four pointers of each target (file_id, next_version)
    without pending events; all other files keep theirs. Repeating it writes the same."""
    ready = targets.join(pending.select("file_id").distinct(), "file_id", "left_anti")
    old = latest(spark, f"{path}/pointers", POINTERS, number)
    moved = ready.select("file_id", F.col("next_version").cast("int").alias("target"))
    kinds = [c.split()[0] for c in POINTERS.split(", ")[1:]]
    new = old.join(moved, "file_id", "full").select("file_id", *(F.coalesce("target", k).alias(k) for k in kinds))
    write_number(new, f"{path}/pointers", number)


def published_pointers(spark: SparkSession, path: str) -> DataFrame:
    return latest(spark, f"{path}/pointers", POINTERS)


def published_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of each file's live version: staged tables joined with the last pointers. What was staged without a flip is invisible."""
    staged_numbers = batches_in(spark, f"{path}/chunks")
    rows = spark.read.parquet(*(f"{path}/chunks/batch={n}" for n in staged_numbers))
    live = published_pointers(spark, path).select("file_id", F.col("active_chunk_version").alias("version"))
    return rows.join(live, ["file_id", "version"])


def visible_chunks(chunks: DataFrame, active: DataFrame) -> DataFrame:
    """Chunks of each file's active version only, with the file's tenant. Where chunks say whether they are ``available``, only those are."""
    if "available" in chunks.columns:
        chunks = chunks.where("available = 1")
    return chunks.join(active.select("file_id", "tenant_id", F.col("active_version").alias("version")), ["file_id", "version"])


def change_state(events: DataFrame) -> DataFrame:
    """What a fold of change events (seq, doc_key, event_type, available) has to know of each document. States of parts of a log merge."""
    at = lambda kind: F.when(F.col("event_type") == kind, F.col("seq"))
    return events.groupBy("doc_key").agg(
        F.max(at("index")).alias("indexed"),
        F.max(at("delete")).alias("deleted"),
        F.max(at("set_available")).alias("set_at"),
        F.max_by("available", at("set_available")).alias("set_to"),
        F.max_by("available", at("index")).alias("indexed_as"),
    )


def merge_states(states: DataFrame) -> DataFrame:
    """One state for each document of several, in any order; a state that is merged twice changes nothing."""
    return states.groupBy("doc_key").agg(
        F.max("indexed").alias("indexed"),
        F.max("deleted").alias("deleted"),
        F.max("set_at").alias("set_at"),
        F.max_by("set_to", "set_at").alias("set_to"),
        F.max_by("indexed_as", "indexed").alias("indexed_as"),
    )


def indexed_documents(state: DataFrame) -> DataFrame:
    """The documents of the index (doc_key, indexed_seq, available): those with an ``index`` after their last ``delete``. A document's last
    ``set_available`` since it was indexed counts, else what was indexed."""
    there = state.where("indexed IS NOT NULL AND indexed > coalesce(deleted, -1)")
    available = F.when(F.col("set_at") > F.col("indexed"), F.col("set_to")).otherwise(F.coalesce("indexed_as", F.lit(0)))
    return there.select("doc_key", F.col("indexed").alias("indexed_seq"), available.cast("int").alias("available"))


def apply_change_log(events: DataFrame) -> DataFrame:
    """Fold events (seq, doc_key, event_type, available) to the documents of the index (doc_key, indexed_seq, available)."""
    return indexed_documents(change_state(events))


INDEX_BUCKETS = 64


def upsert_index(rows: DataFrame, path: str, key: str, seq: str, buckets: int = INDEX_BUCKETS) -> None:
    """Upsert rows into the index table at ``path``, partitioned by hash buckets of the key: only the buckets that ``rows`` touch are read
    and replaced, all others keep their files. The greatest ``seq`` of a key stays, so doing it twice changes nothing."""
    spark = rows.sparkSession
    fresh = staged(rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), "upsert")
    touched = sorted(r.bucket for r in fresh.select("bucket").distinct().collect())  # at most ``buckets``
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        old = spark.read.schema(fresh.schema).parquet(path).where(F.col("bucket").isin(touched))
        fresh = staged(newest_per_id(old.unionByName(fresh), key, seq), "merged")  # a table can't be read while it is replaced
    else:
        fresh = newest_per_id(fresh, key, seq)
    fresh.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def newest_per_id(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each id: the state after idempotent upserts."""
    w = Window.partitionBy(key).orderBy(F.desc(seq))
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def encode_event(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def decode_event(payload: Column, schema: str) -> Column:
    return F.from_json(payload, schema)


def drain_status(outbox: DataFrame) -> DataFrame:
    """By aggregate: published, pending and failed events; anything unpublished is a barrier."""
    done = F.col("published_at").isNotNull()
    failed = ~done & (F.col("attempts") >= MAX_ATTEMPTS)
    n = lambda c: F.count(F.when(c, 1))
    return outbox.groupBy("aggregate_id").agg(
        n(done).alias("published"), n(~done & ~failed).alias("pending"), n(failed).alias("failed"), (n(~done) > 0).alias("barrier")
    )


def purge_projection(active: DataFrame, tables: dict[str, DataFrame], retain: int = 1) -> DataFrame:
    """By file: its threshold version and how many rows of each table (file_id, version) lie below it; files whose pointers differ are left out."""
    due = active.where("active_version = active_summary_version").select("file_id", (F.col("active_version") - retain + 1).alias("threshold")).where("threshold > 1")
    for name, rows in tables.items():
        below = rows.join(due, "file_id").where("version < threshold").groupBy("file_id").agg(F.count("*").alias(name))
        due = due.join(below, "file_id", "left")
    return due.na.fill(0, list(tables))


def delete_events(gone: DataFrame, per_event: int = EVENTS_PER_DELETE) -> DataFrame:
    """(file_id, batch, ids) of rows (file_id, kind, key) that leave the index: a file's ids in order of kind and key, so many in an event."""
    nth = F.row_number().over(Window.partitionBy("file_id").orderBy("kind", "key")) - 1
    placed = gone.withColumn("batch", F.floor(nth / per_event))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("kind", "key"))), lambda x: x.key)
    return placed.groupBy("file_id", "batch").agg(ids.alias("ids"))


def purge_tables(tables: dict[str, DataFrame], projection: DataFrame, pending: DataFrame, keys: dict[str, str], per_event: int = EVENTS_PER_DELETE) -> tuple[dict[str, DataFrame], DataFrame]:
    """(survivors of every table (file_id, version), delete events): below each file's threshold rows go, unless the file has pending events. The
    ids of the tables in ``keys`` (name: key column), which the index holds, go into events."""
    due = projection.select("file_id", "threshold").join(pending.select("file_id").distinct(), "file_id", "left_anti")
    below = F.coalesce(F.col("version") < F.col("threshold"), F.lit(False))
    marked = {name: rows.join(due, "file_id", "left") for name, rows in tables.items()}
    gone = [marked[name].where(below).select("file_id", F.lit(name).alias("kind"), F.col(key).cast("string").alias("key")) for name, key in keys.items()]
    return {name: rows.where(~below).drop("threshold") for name, rows in marked.items()}, delete_events(reduce(DataFrame.unionByName, gone), per_event)


def purge_apply(rows: DataFrame, projection: DataFrame, pending: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``purge_tables`` of one table."""
    left, events = purge_tables({"rows": rows}, projection, pending, {"rows": key})
    return left["rows"], events


def prune_change_log(outbox: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Without events published before the cutoff; unpublished ones stay."""
    cutoff = F.to_timestamp_ntz(F.lit(as_of)) - F.expr(f"INTERVAL {int(days)} DAYS")
    return outbox.where(F.col("published_at").isNull() | (F.col("published_at") >= cutoff))


def delete_files(gone: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the deleted files."""
    ids = gone.select("file_id").distinct()
    return {name: rows.join(ids, "file_id", "left_anti") for name, rows in tables.items()}


def delete_cascade(gone: DataFrame, tables: dict[str, DataFrame], keys: dict[str, str], per_event: int = EVENTS_PER_DELETE) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """(survivors, delete events, refund) of deleting files (file_id, tenant_id, size_bytes) with all that hangs on them. The ids of the tables in
    ``keys`` go into events; each tenant gets back its files and bytes."""
    ids = gone.select("file_id").distinct()
    leaving = [tables[name].join(ids, "file_id", "left_semi").select("file_id", F.lit(name).alias("kind"), F.col(key).cast("string").alias("key")) for name, key in keys.items()]
    return delete_files(gone, **tables), delete_events(reduce(DataFrame.unionByName, leaving), per_event), quota_refund(gone)


def quota_refund(gone: DataFrame) -> DataFrame:
    """(tenant_id, docs, bytes): what is taken off the counters; unknown sizes count as 0."""
    return gone.groupBy("tenant_id").agg((-F.count("*")).alias("docs"), (-F.sum(F.coalesce("size_bytes", F.lit(0)))).alias("bytes"))


def reconcile_classify(chunks: DataFrame, active: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_key, file_id, drift): one full outer join of what should be indexed with what is.

    Among active chunks: missing, version_drift, avail_drift; among visible others: retired_leak if any version has the chunk, else orphan.
    """
    known = chunks.join(active.select("file_id", "active_version"), "file_id").select(F.col("chunk_key").alias("doc_key"), "file_id", "version", "active_version")
    seen = index.select("doc_key", F.col("file_id").alias("index_file"), "chunk_version", "available")
    both = known.join(seen, "doc_key", "full")
    is_active, there = F.coalesce(F.col("version") == F.col("active_version"), F.lit(False)), F.col("index_file").isNotNull()
    drift = (
        F.when(is_active & ~there, "missing")
        .when(is_active & (F.col("chunk_version") != F.col("active_version")), "version_drift")
        .when(is_active & (F.col("available") != 1), "avail_drift")
        .when(~is_active & there & (F.col("available") == 1), F.when(F.col("version").isNotNull(), "retired_leak").otherwise("orphan"))
    )
    return both.select("doc_key", F.coalesce("file_id", "index_file").alias("file_id"), "version", drift.alias("drift")).where("drift IS NOT NULL")


def reconcile_repair(drift: DataFrame) -> DataFrame:
    """The events that mend each drift: (doc_key, file_id, event_type, available, version)."""
    kind = F.when(F.col("drift").isin("missing", "version_drift"), "index").when(F.col("drift") == "orphan", "delete").otherwise("set_available")
    available = F.when(F.col("drift").isin("missing", "version_drift", "avail_drift"), 1).when(F.col("drift") == "retired_leak", 0)
    return drift.select("doc_key", "file_id", kind.alias("event_type"), available.alias("available"), "version")


def repaired_index(index: DataFrame, events: DataFrame) -> DataFrame:
    """The index after repair events."""
    e = events.select("doc_key", F.col("file_id").alias("e_file"), "event_type", F.col("available").alias("e_available"), "version")
    both = index.join(e, "doc_key", "full").where("NOT (event_type <=> 'delete')")
    return both.select(
        "doc_key",
        F.coalesce("file_id", "e_file").alias("file_id"),
        F.when(F.col("event_type") == "index", F.col("version")).otherwise(F.col("chunk_version")).alias("chunk_version"),
        F.coalesce("e_available", "available").alias("available"),
    )
