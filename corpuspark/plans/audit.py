"""Queries of the audit chain and quotas."""

from pyspark.sql import functions as F

from corpuspark.operators import audit
from corpuspark.plans.base import query

TEXT = """CASE WHEN {0} IS NULL THEN 'null' ELSE CAST(to_json({0}) AS VARCHAR) END"""
PAYLOAD = (
    "'{\"action\":' || "
    + TEXT.format("action")
    + " || ',\"detail\":null,\"hit_chunk_ids\":null,\"ip\":null,\"kb_ids\":null,\"query_text\":' || "
    + TEXT.format("query_text")
    + " || ',\"request_id\":null,\"result\":' || "
    + TEXT.format("result")
    + " || ',\"tenant_id\":' || CASE WHEN tenant_id IS NULL THEN 'null' ELSE '\"' || tenant_id || '\"' END || ',\"user_agent\":null,\"user_id\":\"' || user_id || '\"}'"
)


def linked(v):
    """Audit rows whose links are pre-set: a row's hash takes its predecessor's id, so that SQL can state it without a fold."""
    rows = v.v_audit
    prev = F.when(F.col("id") % 17 != 0, F.sha2((F.col("id") - 1).cast("string"), 256))
    hashed = rows.withColumn("prev_hash", prev)
    return hashed.withColumn("row_hash", F.when(F.col("id") % 29 != 0, audit.row_hash(F.col("prev_hash"), audit.canonical_payload(hashed))))


LINKED = f"""linked AS (SELECT *, CASE WHEN id % 29 <> 0 THEN sha256(coalesce(prev_hash, '') || '|' || ({PAYLOAD})) END AS row_hash
  FROM (SELECT *, CASE WHEN id % 17 <> 0 THEN sha256(CAST(id - 1 AS VARCHAR)) END AS prev_hash FROM {{v_audit}}))"""


@query("q1_canonical_payload", f"SELECT id, {PAYLOAD} AS payload FROM {{v_audit}}")
def q1(v):
    return v.v_audit.select("id", audit.canonical_payload(v.v_audit).alias("payload"))


@query("q2_row_hash", f"WITH {LINKED} SELECT id, prev_hash, row_hash FROM linked")
def q2(v):
    return linked(v).select("id", "prev_hash", "row_hash")


@query(
    "q3_build_chain",
    f"""WITH RECURSIVE p AS (SELECT id, tenant_id, coalesce(tenant_id, -1) AS t, {PAYLOAD} AS payload, row_number() OVER (PARTITION BY tenant_id ORDER BY id) AS n FROM {{v_audit}}),
c AS (SELECT id, tenant_id, t, n, CAST(NULL AS VARCHAR) AS prev_hash, sha256('|' || payload) AS row_hash FROM p WHERE n = 1
  UNION ALL SELECT p.id, p.tenant_id, p.t, p.n, c.row_hash, sha256(c.row_hash || '|' || payload) FROM c JOIN p ON p.t = c.t AND p.n = c.n + 1)
SELECT id, tenant_id, prev_hash, row_hash FROM c""",
)
def q3(v):
    return audit.build_chain(v.v_audit).select("id", "tenant_id", "prev_hash", "row_hash")


@query(
    "q4_verify_chain",
    f"""WITH {LINKED}, t AS (SELECT * REPLACE (CASE WHEN id % 1000 = 7 THEN 'tampered' ELSE result END AS result) FROM linked),
c AS (SELECT tenant_id, id, row_hash IS NULL AS no_hash, coalesce(sha256(coalesce(prev_hash, '') || '|' || ({PAYLOAD})) <> row_hash, false) AS mismatch,
  coalesce(row_hash IS NOT NULL AND prev_hash <> lag(row_hash) OVER w, false) AS broken,
  row_hash IS NOT NULL AND prev_hash IS NULL AND count(row_hash) OVER (PARTITION BY tenant_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS restart
  FROM t WINDOW w AS (PARTITION BY tenant_id ORDER BY id))
SELECT tenant_id, count(*) AS rows, count(*) FILTER (mismatch) AS mismatches, count(*) FILTER (broken) AS breaks, count(*) FILTER (no_hash OR restart) AS gaps,
  min(id) AS head_id, max(id) AS tail_id, min(id) FILTER (mismatch) AS first_mismatch_id, min(id) FILTER (broken) AS first_break_id,
  count(*) FILTER (mismatch) = 0 AND count(*) FILTER (broken) = 0 AS verified FROM c GROUP BY 1""",
)
def q4(v):
    return audit.verify_chain(linked(v).withColumn("result", F.when(F.col("id") % 1000 == 7, "tampered").otherwise(F.col("result"))))


@query("q4_verify_built_chain", "SELECT tenant_id, count(*) AS rows, 0::BIGINT AS mismatches, 0::BIGINT AS breaks, 0::BIGINT AS gaps FROM {v_audit} GROUP BY 1")
def q4_built(v):
    return audit.verify_chain(audit.build_chain(v.v_audit)).select("tenant_id", "rows", "mismatches", "breaks", "gaps")


@query(
    "q5_anchor_chain",
    f"WITH {LINKED} SELECT tenant_id, count(*) AS rows, min(id) AS first_id, max(id) AS last_id, arg_max(row_hash, id) AS tail_hash FROM linked WHERE row_hash IS NOT NULL GROUP BY 1",
)
def q5(v):
    return audit.anchor_chain(linked(v))


LIMITS = """limits AS (SELECT t.tenant_id, coalesce(max_docs, 1000)::BIGINT AS max_docs, coalesce(max_bytes, 5368709120)::BIGINT AS max_bytes
  FROM (SELECT DISTINCT tenant_id FROM {v_file}) t LEFT JOIN {v_quota} q ON q.tenant_id = t.tenant_id)"""


@query("q6_quota_limits", f"WITH {LIMITS} SELECT * FROM limits")
def q6(v):
    return audit.quota_limits(v.v_file, v.v_quota)


USED = """used AS (SELECT tenant_id, coalesce(c_docs, f_docs) AS docs, coalesce(c_bytes, f_bytes) AS bytes
  FROM (SELECT tenant_id, count(*) AS c_docs, sum(bytes)::BIGINT AS c_bytes FROM {v_meter_event} WHERE period = '2024-01' AND tenant_id < 2 GROUP BY 1) c
  FULL JOIN (SELECT tenant_id, count(*) AS f_docs, sum(size_bytes)::BIGINT AS f_bytes FROM {v_file} WHERE date_trunc('month', created_date) = DATE '2024-01-01' GROUP BY 1) f USING (tenant_id))"""


def used(v):
    counters = v.v_meter_event.where("tenant_id < 2").groupBy("tenant_id", "period").agg(F.count("*").alias("docs"), F.sum("bytes").alias("bytes"))
    return audit.usage(counters, v.v_file, "2024-01")


@query("q7_usage", f"WITH {USED} SELECT * FROM used")
def q7(v):
    return used(v)


@query(
    "q8_check_quota",
    f"""WITH {USED}, {LIMITS} SELECT l.tenant_id, CASE WHEN max_docs > 0 AND coalesce(docs, 0) >= max_docs THEN 'docs'
  WHEN max_bytes > 0 AND coalesce(bytes, 0) >= max_bytes THEN 'bytes' ELSE 'ok' END AS reason FROM limits l LEFT JOIN used u ON u.tenant_id = l.tenant_id""",
)
def q8(v):
    return audit.check_quota(used(v), audit.quota_limits(v.v_file, v.v_quota))


@query(
    "q9_admit_uploads",
    f"""WITH RECURSIVE {LIMITS}, u AS (SELECT f.tenant_id, strftime(created_date, '%Y-%m') AS period, file_id AS seq, size_bytes AS bytes, max_docs, max_bytes,
  row_number() OVER (PARTITION BY f.tenant_id, strftime(created_date, '%Y-%m') ORDER BY file_id) AS n FROM {{v_file}} f JOIN limits l ON l.tenant_id = f.tenant_id),
a AS (SELECT *, NOT (max_bytes > 0 AND bytes > max_bytes) AS ok, CASE WHEN max_bytes > 0 AND bytes > max_bytes THEN 0 ELSE 1 END AS docs,
    CAST(CASE WHEN max_bytes > 0 AND bytes > max_bytes THEN 0 ELSE bytes END AS HUGEINT) AS used FROM u WHERE n = 1
  UNION ALL SELECT u.*, o.ok, a.docs + o.ok::INT, a.used + CASE WHEN o.ok THEN u.bytes ELSE 0 END FROM a JOIN u ON u.tenant_id = a.tenant_id AND u.period = a.period AND u.n = a.n + 1,
    LATERAL (SELECT NOT (u.max_docs > 0 AND a.docs >= u.max_docs) AND NOT (u.max_bytes > 0 AND a.used + u.bytes > u.max_bytes) AS ok) o)
SELECT tenant_id, period, seq, bytes, ok AS admitted FROM a""",
)
def q9(v):
    uploads = v.v_file.select("tenant_id", F.date_format("created_date", "yyyy-MM").alias("period"), F.col("file_id").alias("seq"), F.col("size_bytes").alias("bytes"))
    return audit.admit_uploads(uploads, audit.quota_limits(v.v_file, v.v_quota))


@query(
    "q10_meter",
    """WITH s AS (SELECT *, sum(doc_delta) OVER w AS d, sum(doc_delta * bytes) OVER w AS b FROM {v_meter_event} WINDOW w AS (PARTITION BY tenant_id, period ORDER BY seq))
SELECT tenant_id, period, (arg_max(d, seq) - least(0, min(d)))::BIGINT AS docs, (arg_max(b, seq) - least(0, min(b)))::BIGINT AS bytes FROM s GROUP BY 1, 2""",
)
def q10(v):
    return audit.meter(v.v_meter_event)
