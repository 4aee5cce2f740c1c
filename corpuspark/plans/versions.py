"""Queries of the versioned publish and the reconciliation."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspark.operators import chunk, versions
from corpuspark.plans.base import query
from corpuspark.plans.ingest import answers
from corpuspark.sources.staging import fresh_path
from corpuspark.sources.views import AS_OF


@query(
    "v1_dedupe_upload",
    """SELECT file_id, tenant_id, f AS kept_id, f <> file_id AS reused FROM (SELECT *, first_value(file_id) OVER (PARTITION BY tenant_id, sha256(content) ORDER BY created_date, file_id) AS f FROM {v_file})""",
)
def v1(v):
    return versions.dedupe_upload(v.v_file)


NEXT = "nxt AS (SELECT f.file_id, coalesce(max(version), 0) + 1 AS next_version FROM {v_file} f LEFT JOIN (SELECT * FROM {v_chunk_v1} WHERE file_id % 6 <> 0) c ON c.file_id = f.file_id GROUP BY 1)"
DIFF = """old AS (SELECT file_id, sha256(content) AS hash, arg_max(chunk_key, chunk_order) AS previous_key FROM {v_chunk_v1} GROUP BY 1, 2),
diff AS (SELECT n.file_id, chunk_key, chunk_order, previous_key, previous_key IS NULL AS fresh FROM {v_chunk_v2} n LEFT JOIN old ON old.file_id = n.file_id AND hash = sha256(content))"""


@query("v2_next_version", f"WITH {NEXT} SELECT * FROM nxt")
def v2(v):
    return versions.next_version(v.v_file, v.v_chunk_v1.where("file_id % 6 <> 0"))


def diff(v):
    return versions.diff_chunks(v.v_chunk_v2, v.v_chunk_v1)


@query("v3_diff_chunks", f"WITH {DIFF} SELECT * FROM diff")
def v3(v):
    return diff(v)


@query(
    "v4_choose_mode",
    f"""WITH {DIFF}, {NEXT}, r AS (SELECT file_id, avg(fresh::INT) AS r FROM diff GROUP BY 1)
SELECT nxt.file_id, round(coalesce(r, 0.0), 6) AS changed_ratio, CASE WHEN next_version > 1 AND coalesce(r, 0) <= 0.5 THEN 'incremental' ELSE 'full' END AS mode FROM nxt LEFT JOIN r ON r.file_id = nxt.file_id""",
)
def v4(v):
    found = versions.choose_mode(diff(v), versions.next_version(v.v_file, v.v_chunk_v1.where("file_id % 6 <> 0")))
    return found.withColumn("changed_ratio", F.round("changed_ratio", 6))


@query(
    "v5_reuse_vectors",
    f"""WITH {DIFF}, vec AS (SELECT vec_id, embedding[1]::DOUBLE AS x FROM {{embeddings}})
SELECT diff.chunk_key, coalesce(o.x, n.x) AS x, o.x IS NOT NULL AS reused FROM diff
LEFT JOIN (SELECT chunk_key, x FROM (SELECT chunk_key, (file_id * 31 + chunk_order) % n_vectors AS slot FROM {{v_chunk_v1}} CROSS JOIN {{v_size}}) c JOIN vec ON vec_id = slot) o ON o.chunk_key = previous_key
LEFT JOIN (SELECT chunk_key AS k, x FROM (SELECT chunk_key, (file_id * 7 + chunk_order) % n_vectors AS slot FROM {{v_chunk_v2}} CROSS JOIN {{v_size}}) c JOIN vec ON vec_id = slot) n ON n.k = diff.chunk_key""",
)
def v5(v):
    def vectors(chunks, factor):
        key = (F.col("file_id") * factor + F.col("chunk_order")) % F.col("n_vectors")
        return chunks.crossJoin(F.broadcast(v.v_size)).select("chunk_key", key.alias("vec_id")).join(v.embeddings, "vec_id").select("chunk_key", F.col("embedding").alias("vector"))

    found = versions.reuse_vectors(diff(v), vectors(v.v_chunk_v1, 31), vectors(v.v_chunk_v2, 7))
    return found.select("chunk_key", F.col("vector")[0].cast("double").alias("x"), "reused")


@query(
    "v6_remap_summaries",
    f"""WITH {DIFF}, m AS (SELECT previous_key, arg_max(chunk_key, chunk_order) AS new_key FROM diff WHERE NOT fresh GROUP BY 1)
SELECT file_id, summary_key, string_agg(new_key, ',' ORDER BY pos) AS sources FROM {{v_source}} s LEFT JOIN m ON m.previous_key = s.chunk_key GROUP BY 1, 2 HAVING count(new_key) = count(*)""",
)
def v6(v):
    return versions.remap_summaries(v.v_source, diff(v)).select("file_id", "summary_key", F.array_join("source_chunk_ids", ",").alias("sources"))


def pending(v):
    return v.v_outbox.where("published_at IS NULL").select("file_id")


@query(
    "v7_stage_and_flip",
    """WITH c AS (SELECT file_id, version, chunk_key FROM {v_chunk_v1} UNION ALL SELECT file_id, version, chunk_key FROM {v_chunk_v2}),
p AS (SELECT DISTINCT file_id FROM {v_outbox} WHERE published_at IS NULL)
SELECT c.file_id, chunk_key, CASE WHEN p.file_id IS NULL THEN (version = 2)::INT END AS available FROM c LEFT JOIN p ON p.file_id = c.file_id""",
)
def v7(v):
    chunks = v.v_chunk_v1.unionByName(v.v_chunk_v2)
    flipped, _ = versions.publish(chunks, v.v_file.select("file_id", F.lit(2).alias("next_version")), pending(v))
    return flipped.select("file_id", "chunk_key", "available")


@query(
    "v7_pointers",
    f"""WITH p AS (SELECT DISTINCT file_id FROM {{v_outbox}} WHERE published_at IS NULL),
a AS (SELECT f.file_id, CASE WHEN p.file_id IS NULL THEN 2 ELSE 1 END AS v FROM {{v_file}} f LEFT JOIN p ON p.file_id = f.file_id),
c AS (SELECT file_id, 1 AS v, count(*) AS n FROM {{v_chunk_v1}} GROUP BY 1 UNION ALL SELECT file_id, 2, count(*) FROM {{v_chunk_v2}} GROUP BY 1)
SELECT a.file_id, a.v AS active_doc_version, a.v AS active_chunk_version, a.v AS active_summary_version, a.v AS active_anchor_version, coalesce(n, 0) AS visible
FROM a LEFT JOIN c ON c.file_id = a.file_id AND c.v = a.v""",
)
def v7_pointers(v):
    """Two publishes: all files with version 1, then those without pending events with version 2; a third is staged and never flipped."""
    path = fresh_path(v.spark, "published")
    none = pending(v).limit(0)
    for number, chunks, waiting in ((1, v.v_chunk_v1, none), (2, v.v_chunk_v2, pending(v))):
        versions.stage_version(chunks, path, number)
        versions.flip(v.spark, v.v_file.select("file_id", F.lit(number).alias("next_version")), waiting, path, number)
    versions.stage_version(v.v_chunk_v2.withColumn("version", F.lit(3)), path, 3)
    visible = versions.published_chunks(v.spark, path).groupBy("file_id").agg(F.count("*").alias("visible"))
    return versions.published_pointers(v.spark, path).join(visible, "file_id", "left").na.fill(0, ["visible"])


@query(
    "v8_visible_chunks",
    """WITH c AS (SELECT * FROM {v_chunk_v1} UNION ALL SELECT * FROM {v_chunk_v2})
SELECT chunk_key, c.file_id, tenant_id FROM c JOIN {v_active} a ON a.file_id = c.file_id AND version = active_version
SEMI JOIN (SELECT * FROM {v_shown} WHERE available = 1) s ON s.file_id = c.file_id AND s.chunk_order = c.chunk_order AND s.version = c.version""",
)
def v8(v):
    chunks = v.v_chunk_v1.unionByName(v.v_chunk_v2).join(v.v_shown, ["file_id", "chunk_order", "version"])
    return versions.visible_chunks(chunks, v.v_active).select("chunk_key", "file_id", "tenant_id")


STATE = """state AS (SELECT doc_key, max(seq) FILTER (event_type = 'index') AS indexed, max(seq) FILTER (event_type = 'delete') AS deleted, max(seq) FILTER (event_type = 'set_available') AS set_at,
  arg_max(available, seq) FILTER (event_type = 'set_available') AS set_to FROM {v_outbox} GROUP BY 1)"""


@query(
    "v9_apply_change_log",
    f"""WITH {STATE} SELECT doc_key, indexed AS indexed_seq, CASE WHEN set_at > indexed THEN set_to ELSE 0 END AS available FROM state WHERE indexed > coalesce(deleted, -1)""",
)
def v9(v):
    return versions.apply_change_log(v.v_outbox)


@query("s8_write_index", "SELECT doc_key, max(seq) AS seq, arg_max(event_type, seq) AS event_type FROM {v_outbox} GROUP BY 1")
def s8(v):
    return versions.newest_per_id(v.v_outbox, "doc_key", "seq").select("doc_key", "seq", "event_type")


@query("s8_upsert_index", "SELECT doc_key, max(seq) AS seq, arg_max(event_type, seq) AS event_type FROM {v_outbox} GROUP BY 1")
def s8_upsert(v):
    """Three batches in any order, the second one twice."""
    path = fresh_path(v.spark, "index")
    rows = v.v_outbox.select("doc_key", "seq", "event_type")
    for part in (2, 0, 0, 1):
        versions.upsert_index(rows.where(F.col("seq") % 3 == part), path, "doc_key", "seq")
    return v.spark.read.parquet(path).drop("bucket")


@query("s9_decode_event", "SELECT seq, doc_key, available FROM {v_outbox}")
def s9(v):
    packed = v.v_outbox.select("seq", versions.encode_event("doc_key", "available").alias("payload"))
    return packed.select("seq", versions.decode_event(F.col("payload"), "doc_key long, available int").alias("e")).select("seq", "e.doc_key", "e.available")


@query(
    "v10_drain_status",
    """SELECT aggregate_id, count(published_at) AS published, count(*) FILTER (published_at IS NULL AND attempts < 3) AS pending,
  count(*) FILTER (published_at IS NULL AND attempts >= 3) AS failed, count(*) > count(published_at) AS barrier FROM {v_outbox} GROUP BY 1""",
)
def v10(v):
    return versions.drain_status(v.v_outbox)


def tables(v):
    chunks = v.v_chunk_v1.unionByName(v.v_chunk_v2).select("file_id", "version")
    summaries = v.v_summary.select("file_id", F.col("summary_version").alias("version"))
    both = v.v_file.select("file_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("version"))
    return {"chunks": chunks, "summaries": summaries, "anchors": summaries, "versions": both}


DUE = "due AS (SELECT file_id, active_version AS threshold FROM {v_active} WHERE active_version = active_summary_version AND active_version > 1)"


@query(
    "v11_purge_projection",
    f"""WITH {DUE}, c AS (SELECT file_id, count(*) AS n FROM {{v_chunk_v1}} GROUP BY 1), s AS (SELECT file_id, count(*) AS n FROM {{v_summary}} GROUP BY 1)
SELECT due.file_id, threshold, coalesce(c.n, 0) AS chunks, coalesce(s.n, 0) AS summaries, coalesce(s.n, 0) AS anchors, 1::BIGINT AS versions
FROM due LEFT JOIN c ON c.file_id = due.file_id LEFT JOIN s ON s.file_id = due.file_id""",
)
def v11(v):
    return versions.purge_projection(v.v_active, tables(v))


PENDING = "p AS (SELECT DISTINCT file_id FROM {v_outbox} WHERE published_at IS NULL)"


@query(
    "v12_purge_apply",
    f"""WITH {DUE}, {PENDING}, c AS (SELECT * FROM {{v_chunk_v1}} UNION ALL SELECT * FROM {{v_chunk_v2}}),
k AS (SELECT c.file_id, c.version, coalesce(version < threshold AND p.file_id IS NULL, false) AS gone FROM c LEFT JOIN due ON due.file_id = c.file_id LEFT JOIN p ON p.file_id = c.file_id)
SELECT file_id, count(*) FILTER (NOT gone) AS kept, count(*) FILTER (gone) AS deleted FROM k GROUP BY 1""",
)
def v12(v):
    chunks = v.v_chunk_v1.unionByName(v.v_chunk_v2)
    kept, events = versions.purge_apply(chunks, versions.purge_projection(v.v_active, tables(v)), pending(v), "chunk_key")
    left = kept.groupBy("file_id").agg(F.count("*").alias("kept"))
    gone = events.groupBy("file_id").agg(F.sum(F.size("ids")).alias("deleted"))
    return left.join(gone, "file_id", "full").select("file_id", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("deleted", F.lit(0)).alias("deleted"))


PER_EVENT = 20  # few ids an event, so that files have several


def keyed_tables(v):
    """The four tables of versions with their keys."""
    chunks = v.v_chunk_v1.unionByName(v.v_chunk_v2).select("file_id", "version", "chunk_key")
    summaries = v.v_summary.select("file_id", F.col("summary_version").alias("version"), "summary_key")
    both = v.v_file.select("file_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("version"))
    return {"chunks": chunks, "summaries": summaries, "anchors": summaries, "versions": both}


KEYED = """rows AS (SELECT 'chunks' AS name, file_id, version, chunk_key AS key FROM {v_chunk_v1} UNION ALL SELECT 'chunks', file_id, version, chunk_key FROM {v_chunk_v2}
  UNION ALL SELECT 'summaries', file_id, summary_version, summary_key FROM {v_summary} UNION ALL SELECT 'anchors', file_id, summary_version, summary_key FROM {v_summary}
  UNION ALL SELECT 'versions', file_id, x, NULL FROM {v_file}, (SELECT unnest([1, 2]) AS x) y)"""
PURGED = f"""WITH {DUE}, {PENDING}, {KEYED}, k AS (SELECT r.*, coalesce(r.version < threshold AND p.file_id IS NULL, false) AS gone
  FROM rows r LEFT JOIN due ON due.file_id = r.file_id LEFT JOIN p ON p.file_id = r.file_id)"""
EVENTS = f"(row_number() OVER (PARTITION BY file_id ORDER BY name, key) - 1) // {PER_EVENT}"
KEYS = {"chunks": "chunk_key", "summaries": "summary_key"}


def event_view(events):
    return events.select("file_id", "batch", F.array_join("ids", ",").alias("ids"))


@query("v12_purge_tables", f"{PURGED} SELECT name, count(*) FILTER (NOT gone) AS kept FROM k GROUP BY 1")
def v12_tables(v):
    left, _ = versions.purge_tables(keyed_tables(v), versions.purge_projection(v.v_active, tables(v)), pending(v), KEYS, PER_EVENT)
    return reduce(DataFrame.unionByName, [rows.agg(F.count("*").alias("kept")).select(F.lit(name).alias("name"), "kept") for name, rows in left.items()])


@query(
    "v12_delete_events",
    f"{PURGED}, e AS (SELECT file_id, name, key, {EVENTS} AS batch FROM k WHERE gone AND name IN ('chunks', 'summaries')) SELECT file_id, batch, string_agg(key, ',' ORDER BY name, key) AS ids FROM e GROUP BY 1, 2",
)
def v12_events(v):
    return event_view(versions.purge_tables(keyed_tables(v), versions.purge_projection(v.v_active, tables(v)), pending(v), KEYS, PER_EVENT)[1])


@query("v13_prune_change_log", f"SELECT seq FROM {{v_outbox}} WHERE published_at IS NULL OR published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY")
def v13(v):
    return versions.prune_change_log(v.v_outbox, AS_OF).select("seq")


def deleted(v):
    return versions.delete_cascade(v.v_file.where("file_id % 8 = 3"), keyed_tables(v) | {"links": v.v_file_kb}, KEYS, PER_EVENT)


@query(
    "v14_delete_files",
    f"WITH {KEYED} SELECT name, count(*) AS n FROM (SELECT name, file_id FROM rows UNION ALL SELECT 'links', file_id FROM {{v_file_kb}}) x WHERE file_id % 8 <> 3 GROUP BY 1",
)
def v14(v):
    return reduce(DataFrame.unionByName, [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, rows in deleted(v)[0].items()])


@query(
    "v14_delete_events",
    f"WITH {KEYED}, e AS (SELECT file_id, name, key, {EVENTS} AS batch FROM rows WHERE file_id % 8 = 3 AND name IN ('chunks', 'summaries')) SELECT file_id, batch, string_agg(key, ',' ORDER BY name, key) AS ids FROM e GROUP BY 1, 2",
)
def v14_events(v):
    return event_view(deleted(v)[1])


@query("v14_refund", "SELECT tenant_id, -count(*) AS docs, -sum(size_bytes)::BIGINT AS bytes FROM {v_file} WHERE file_id % 8 = 3 GROUP BY 1")
def v14_refund(v):
    return deleted(v)[2]


DRIFT = """known AS (SELECT c.chunk_key AS doc_key, c.file_id, version, active_version FROM (SELECT * FROM {v_chunk_v1} UNION ALL SELECT * FROM {v_chunk_v2}) c JOIN {v_active} a ON a.file_id = c.file_id),
j AS (SELECT coalesce(k.doc_key, i.doc_key) AS doc_key, coalesce(k.file_id, i.file_id) AS file_id, version, coalesce(version = active_version, false) AS act, active_version, i.doc_key IS NOT NULL AS there, chunk_version, available
  FROM known k FULL JOIN {v_index} i ON i.doc_key = k.doc_key),
drift AS (SELECT doc_key, file_id, CASE WHEN act AND NOT there THEN 'missing' WHEN act AND chunk_version <> active_version THEN 'version_drift' WHEN act AND available <> 1 THEN 'avail_drift'
  WHEN NOT act AND there AND available = 1 THEN CASE WHEN version IS NOT NULL THEN 'retired_leak' ELSE 'orphan' END END AS drift FROM j)"""


def drift(v, index=None):
    return versions.reconcile_classify(v.v_chunk_v1.unionByName(v.v_chunk_v2), v.v_active, v.v_index if index is None else index)


@query("v15_reconcile_classify", f"WITH {DRIFT} SELECT doc_key, file_id, drift FROM drift WHERE drift IS NOT NULL")
def v15(v):
    return drift(v).select("doc_key", "file_id", "drift")


@query(
    "v16_reconcile_repair",
    f"""WITH {DRIFT} SELECT doc_key, file_id, CASE WHEN drift IN ('missing', 'version_drift') THEN 'index' WHEN drift = 'orphan' THEN 'delete' ELSE 'set_available' END AS event_type,
  CASE WHEN drift = 'retired_leak' THEN 0 WHEN drift <> 'orphan' THEN 1 END AS available FROM drift WHERE drift IS NOT NULL""",
)
def v16(v):
    return versions.reconcile_repair(drift(v)).select("doc_key", "file_id", "event_type", "available")


@query("v16_repaired_is_clean", "SELECT doc_key, file_id FROM {v_index} WHERE false")
def v16_clean(v):
    index = versions.repaired_index(v.v_index, versions.reconcile_repair(drift(v)))
    return drift(v, index).select("doc_key", "file_id")


@query(
    "c21_ingest_stats",
    f"""WITH {DIFF}, c AS (SELECT file_id, count(*) AS n FROM {{v_chunk_v2}} GROUP BY 1), d AS (SELECT file_id, count(*) FILTER (NOT fresh) AS reused, count(*) FILTER (fresh) AS fresh FROM diff GROUP BY 1),
s AS (SELECT file_id, count(*) AS n FROM {{v_source}} WHERE file_id % 3 < 2 AND pos = 0 GROUP BY 1)
SELECT c.file_id, 2 AS version, c.n AS chunks, coalesce(s.n, 0) AS summaries, reused, d.fresh FROM c JOIN d ON d.file_id = c.file_id LEFT JOIN s ON s.file_id = c.file_id""",
)
def c21(v):
    chunks = v.v_chunk_v2.withColumn("skip_summary", F.lit(False))
    summaries = chunk.validate_summaries(answers(v))
    stats = chunk.ingest_stats(chunks, summaries, diff(v), chunk.coverage_ratio(chunks, summaries))
    return stats.select("file_id", "version", "chunks", "summaries", "reused", "fresh")
