"""Rolling service metrics over log tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the ingest-latency and completion-rate histograms.
INGEST_SECONDS = (0.1, 0.5, 1.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0, 600.0)
COMPLETION_RATE = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)


def last_hours(logs: DataFrame, as_of: str, hours: int = 1) -> DataFrame:
    now = F.to_timestamp_ntz(F.lit(as_of))
    return logs.where((F.col("created_at") >= now - F.expr(f"INTERVAL {int(hours)} HOURS")) & (F.col("created_at") <= now))


def retrieval_p95(queries: DataFrame, as_of: str, hours: int = 1) -> DataFrame:
    """Interpolated 95th percentile of the latency by tenant."""
    return last_hours(queries, as_of, hours).groupBy("tenant_id").agg(F.percentile("latency_ms", 0.95).alias("p95"))


def ingest_rate(costs: DataFrame, as_of: str, hours: int = 1) -> DataFrame:
    return last_hours(costs, as_of, hours).groupBy("tenant_id").agg(F.count("*").alias("ingests"), F.sum("tokens").alias("tokens"))


def quota_gauge(counters: DataFrame, period: str) -> DataFrame:
    return counters.where(F.col("period") == period).select("tenant_id", "docs", "bytes")


def violations(audit: DataFrame, as_of: str, hours: int = 1) -> DataFrame:
    """Audit rows by tenant whose result is known and not ok."""
    return last_hours(audit, as_of, hours).where("result <> 'ok'").groupBy("tenant_id").agg(F.count("*").alias("violations"))


def endpoint(path: Column) -> Column:
    """The path with its ids as a placeholder; anything outside the API is ``unmatched``."""
    return F.when(path.startswith("/v1/"), F.regexp_replace(path, r"/[0-9a-fA-F-]*[0-9][0-9a-fA-F-]*(?=/|$)", "/{id}")).otherwise("unmatched")


def red_metrics(access_log: DataFrame) -> DataFrame:
    """Requests and latency sums by method, endpoint and status."""
    return access_log.groupBy("method", endpoint(F.col("path")).alias("endpoint"), "status").agg(F.count("*").alias("requests"), F.sum("seconds").alias("seconds"))


def slo_histogram(rows: DataFrame, value: str, bounds: tuple[float, ...]) -> DataFrame:
    """Cumulative counts of values up to each bound, in one aggregate over the rows."""
    counted = rows.agg(*(F.count(F.when(F.col(value) <= b, 1)).alias(str(k)) for k, b in enumerate(bounds)), F.count(value).alias("all"))
    steps = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(str(k)).alias("n")) for k, b in enumerate(bounds)), F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("n")))
    return counted.select(F.inline(steps))


def sum_metric(lines: DataFrame, name: str) -> DataFrame:
    """(total, first) of the samples of a metric by name prefix in lines (pos, value) of a text exposition."""
    sample = F.element_at(F.split(F.rtrim(F.col("value")), r"\s+"), -1).try_cast("double")
    found = lines.where(F.col("value").startswith(name)).select("pos", sample.alias("x")).where("x IS NOT NULL")
    return found.agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("total"), F.min_by("x", "pos").alias("first"))


def rate_excess(access_log: DataFrame, limit: int, unit: str = "minute") -> DataFrame:
    """Clients and endpoints with more than ``limit`` requests in a fixed unit of time."""
    counted = access_log.groupBy("user_id", endpoint(F.col("path")).alias("endpoint"), F.date_trunc(unit, "created_at").alias("start")).agg(F.count("*").alias("requests"))
    return counted.where(F.col("requests") > limit)


#: Requests a client may make in a minute, by endpoint; all others together have the last.
LIMITS = {"/v1/search": 120, "/v1/chat": 60, "/v1/docs": 30}
OTHER_LIMIT = 600


def rate_limited(access_log: DataFrame, limits: dict[str, int] = LIMITS, other: int = OTHER_LIMIT) -> DataFrame:
    """(client, endpoint, start, requests, rejected): clients that pass an endpoint's limit in a fixed minute, and how many of their requests go
    beyond it. Each endpoint counts for itself; those without a limit of their own have ``other`` each."""
    at = endpoint(F.col("path"))
    allowed = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in limits.items() for x in kv)), at), F.lit(other))
    counted = access_log.groupBy("client", at.alias("endpoint"), allowed.alias("allowed"), F.date_trunc("minute", "created_at").alias("start")).agg(F.count("*").alias("requests"))
    return counted.where("requests > allowed").select("client", "endpoint", "start", "requests", (F.col("requests") - F.col("allowed")).alias("rejected"))


SKETCH_SIZE = 400


def latency_sketches(logs: DataFrame, unit: str = "hour") -> DataFrame:
    """(tenant_id, start, n, sketch): a mergeable quantile sketch of the latencies of each tenant and unit of time. A sketch has some kilobytes,
    whatever the number of rows."""
    some = logs.where("latency_ms IS NOT NULL").select("tenant_id", F.date_trunc(unit, "created_at").alias("start"), F.col("latency_ms").cast("long").alias("x"))
    return some.groupBy("tenant_id", "start").agg(F.count("*").alias("n"), F.kll_sketch_agg_bigint("x", F.lit(SKETCH_SIZE)).alias("sketch"))


def merged_quantile(sketches: DataFrame, q: float) -> DataFrame:
    """(tenant_id, n, value): a quantile over all of a tenant's sketches. Its rank is off by a hundredth of the rows at most, in all but rare cases."""
    whole = sketches.groupBy("tenant_id").agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch").alias("sketch"))
    return whole.select("tenant_id", "n", F.kll_sketch_get_quantile_bigint("sketch", F.lit(q)).alias("value"))
