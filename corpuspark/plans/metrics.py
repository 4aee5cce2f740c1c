"""Queries of the rolling metrics."""

from pyspark.sql import functions as F

from corpuspark.operators import audit, metrics
from corpuspark.plans.base import query
from corpuspark.sources.staging import staged

NOW = "2024-01-20 12:00:00"
HOURS = 48
RECENT = f"created_at >= TIMESTAMP '{NOW}' - INTERVAL {HOURS} HOUR AND created_at <= TIMESTAMP '{NOW}'"


@query("m1_retrieval_p95", f"SELECT tenant_id, quantile_cont(latency_ms, 0.95) AS p95 FROM {{v_query_log}} WHERE {RECENT} GROUP BY 1")
def m1(v):
    return metrics.retrieval_p95(v.v_query_log, NOW, HOURS)


@query("m2_ingest_rate", f"SELECT tenant_id, count(*) AS ingests, sum(tokens)::BIGINT AS tokens FROM {{v_cost_log}} WHERE {RECENT} GROUP BY 1")
def m2(v):
    return metrics.ingest_rate(v.v_cost_log, NOW, HOURS)


@query(
    "m3_quota_gauge",
    """WITH s AS (SELECT *, sum(doc_delta) OVER w AS d, sum(doc_delta * bytes) OVER w AS b FROM {v_meter_event} WINDOW w AS (PARTITION BY tenant_id, period ORDER BY seq))
SELECT tenant_id, (arg_max(d, seq) - least(0, min(d)))::BIGINT AS docs, (arg_max(b, seq) - least(0, min(b)))::BIGINT AS bytes FROM s WHERE period = '2024-01' GROUP BY 1""",
)
def m3(v):
    return metrics.quota_gauge(audit.meter(v.v_meter_event), "2024-01")


@query("m4_violations", f"SELECT tenant_id, count(*) AS violations FROM {{v_audit}} WHERE {RECENT} AND result <> 'ok' GROUP BY 1")
def m4(v):
    return metrics.violations(v.v_audit, NOW, HOURS)



@query(
    "m5_red_metrics",
    "SELECT method, concat('/v1/docs/', chr(123), 'id', chr(125)) AS endpoint, status, count(*) AS requests, round(sum(seconds), 4) AS seconds FROM {v_access_log} GROUP BY 1, 2, 3",
)
def m5(v):
    return metrics.red_metrics(v.v_access_log).withColumn("seconds", F.round("seconds", 4))


@query(
    "m6_slo_histogram",
    f"""SELECT le, count(*) FILTER (seconds <= le) AS n FROM {{v_access_log}}, (SELECT unnest([{", ".join(map(str, metrics.INGEST_SECONDS))}, 'infinity'::DOUBLE]) AS le) GROUP BY 1""",
)
def m6(v):
    return metrics.slo_histogram(v.v_access_log, "seconds", metrics.INGEST_SECONDS)


@query(
    "s11_sum_metric",
    "SELECT sum(id % 97)::DOUBLE AS total, arg_min(id % 97, id)::DOUBLE AS first FROM {v_access_log} WHERE method = 'GET'",
)
def s11(v):
    line = F.concat(F.when(F.col("method") == "GET", 'req_total{m="GET"} ').otherwise('other_total{m="POST"} '), (F.col("id") % 97).cast("string"))
    return metrics.sum_metric(v.v_access_log.select(F.col("id").alias("pos"), line.alias("value")), "req_total")


@query(
    "t8_rate_excess",
    "SELECT user_id, CAST(date_trunc('day', created_at) AS VARCHAR) AS start, count(*) AS requests FROM {v_access_log} GROUP BY 1, 2 HAVING count(*) > 3",
)
def t8(v):
    return metrics.rate_excess(v.v_access_log, 3, "day").select("user_id", F.col("start").cast("string").alias("start"), "requests")


BURST = """SELECT event_id AS id, user_id % 5 AS client, TIMESTAMP '2024-01-01 00:00:00' + CAST(event_id % 4 AS INT) * INTERVAL 1 MINUTE AS created_at,
  CASE event_type WHEN 'view' THEN '/v1/search' WHEN 'click' THEN '/v1/docs' WHEN 'purchase' THEN '/v1/chat' ELSE concat('/v1/docs/', CAST(event_id AS STRING)) END AS path FROM {events}"""


@query(
    "t8_rate_limited",
    f"""WITH c AS (SELECT client, CASE WHEN path LIKE '/v1/docs/%' THEN concat('/v1/docs/', chr(123), 'id', chr(125)) ELSE path END AS endpoint, CAST(created_at AS VARCHAR) AS start, count(*) AS requests
  FROM ({BURST}) GROUP BY 1, 2, 3), l AS (SELECT *, CASE endpoint WHEN '/v1/search' THEN 120 WHEN '/v1/chat' THEN 60 WHEN '/v1/docs' THEN 30 ELSE 600 END AS allowed FROM c)
SELECT client, endpoint, start, requests, requests - allowed AS rejected FROM l WHERE requests > allowed""",
)
def t8_limited(v):
    """A burst: all events within four minutes, from five clients."""
    burst = v.spark.sql(BURST, events=v.events)
    return metrics.rate_limited(burst).select("client", "endpoint", F.col("start").cast("string").alias("start"), "requests", "rejected")


@query("m1_sketched_p95", f"SELECT tenant_id, count(latency_ms) AS n, true AS near FROM {{v_query_log}} WHERE {RECENT} GROUP BY 1")
def m1_sketched(v):
    """Hourly sketches, stored and merged; near: the share of rows up to the value is 0.95, give or take a hundredth and the value's own rows."""
    recent = metrics.last_hours(v.v_query_log, NOW, HOURS)
    found = metrics.merged_quantile(staged(metrics.latency_sketches(recent), "sketches"), 0.95)
    met = recent.join(found, "tenant_id").groupBy("tenant_id").agg(F.max("n").alias("n"), F.avg((F.col("latency_ms") <= F.col("value")).cast("int")).alias("up_to"), F.avg((F.col("latency_ms") < F.col("value")).cast("int")).alias("below"))
    return met.select("tenant_id", "n", ((F.col("up_to") >= 0.94) & (F.col("below") <= 0.96)).alias("near"))
