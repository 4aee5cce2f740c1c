import numpy as np
import pandas as pd
from conftest import SMALL
from pyspark.sql import functions as F

from corpuspark.operators import audit
from corpuspark.plans.registry import QUERIES
from corpuspark.sources.views import view
from corpuspark.streaming import streams


def arrive(folder, frames, spark, schema):
    """Each frame is a file of its own and so a batch."""
    for rows in frames:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return streams.read_log(spark, folder, spark.createDataFrame([], schema).schema, 1)


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    schema = "created_at timestamp_ntz, tenant_id long, tokens long"
    at = lambda h: (pd.Timestamp(2024, 1, 1) + pd.Timedelta(hours=h)).to_pydatetime()
    stream = arrive(f"{tmp_path}/in", [[(at(10), 1, 5)], [(at(9.6), 1, 7), (at(14), 1, 1)], [(at(20), 1, 1)], [(at(9.7), 1, 100)], [(at(40), 1, 0)]], spark, schema)
    streams.run_once(streams.tumbling_metrics(streams.with_event_time(stream, late="1 hour")), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = {r.start.hour: (r.n, r.tokens) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {9: (1, 7), 10: (1, 5), 14: (1, 1), 20: (1, 1)}  # 9:36 came within the hour, 9:42 did not


def test_index_is_kept_by_touched_buckets(spark, tmp_path):
    schema = "seq long, doc_key long, event_type string, available int"
    first = [[(1, 1, "index", None), (2, 2, "index", None)], [(3, 1, "set_available", 1), (4, 3, "index", None)], [(5, 2, "delete", None)]]
    index, log = f"{tmp_path}/index", f"{tmp_path}/log"
    streams.index_change_log(arrive(log, first, spark, schema), index, f"{tmp_path}/c").awaitTermination()
    assert {r.doc_key: r.available for r in streams.read_index(spark, index).collect()} == {1: 1, 3: 0}
    done = streams.batches_in(spark, f"{index}/pointers")
    assert done == [1, 2] and len(list((tmp_path / "index/states" / f"batch={done[-1]}").glob("bucket=*"))) == 1
    streams.index_change_log(arrive(log, [[(6, 2, "index", None)]], spark, schema), index, f"{tmp_path}/c").awaitTermination()  # goes on from there
    assert {r.doc_key: r.available for r in streams.read_index(spark, index).collect()} == {1: 1, 2: 0, 3: 0}


def test_audit_and_usage_go_on_from_batch_to_batch(spark, tmp_path):
    rows = spark.createDataFrame([(k, k % 2, "a", "ok") for k in range(12)], "id long, tenant_id long, action string, result string")
    chain = audit.build_chain(rows).selectExpr("*", "CASE WHEN id = 5 THEN 'x' ELSE prev_hash END AS p", "CASE WHEN id = 8 THEN NULL ELSE row_hash END AS r")
    chain = chain.drop("prev_hash", "row_hash").withColumnsRenamed({"p": "prev_hash", "r": "row_hash"})
    whole = {r.tenant_id: (r.breaks, r.gaps) for r in audit.verify_chain(chain).collect()}
    parts = [chain.where(f"id BETWEEN {a} AND {a + 3}").collect() for a in (0, 4, 8)]
    streams.verify_audit(arrive(f"{tmp_path}/a", parts, spark, chain.schema), f"{tmp_path}/found", f"{tmp_path}/ca").awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/found/findings").toPandas()
    assert {int(t): (g.broken.sum(), g.gap.sum()) for t, g in found.groupby("tenant_key")} == whole == {0: (0, 1), 1: (1, 0)}
    steps = [[(1, "p", k, d, b) for k, d, b in part] for part in ([(0, 1, 5), (1, -1, 9)], [(70_000, -1, 3), (70_001, 1, 4)], [(140_000, 1, 2)])]
    schema = "tenant_id long, period string, seq long, doc_delta int, bytes long"
    streams.meter_usage(arrive(f"{tmp_path}/m", steps, spark, schema), f"{tmp_path}/usage", f"{tmp_path}/cm").awaitTermination()
    used = streams.latest(spark, f"{tmp_path}/usage", streams.USAGE).first()
    assert (used.docs, used.bytes) == (2, 6)


def test_sliding_windows_start_every_five_minutes(spark):
    got = QUERIES["t2_sliding_p95"](spark, SMALL).toPandas()
    rows = view(spark, SMALL, "v_query_log").select("tenant_id", "latency_ms", "created_at").toPandas()
    last = rows.created_at.dt.floor("5min")  # the last of the twelve windows of an hour that hold a row
    windows = pd.concat([rows.assign(start=(last - pd.Timedelta(minutes=5 * k)).dt.strftime("%Y-%m-%d %H:%M:%S")) for k in range(12)])
    want = windows.groupby(["start", "tenant_id"]).latency_ms.agg(lambda x: np.quantile(x, 0.95, method="inverted_cdf"))
    assert got.set_index(["start", "tenant_id"]).p95.sort_index().to_dict() == want.sort_index().to_dict()


def test_a_large_tenant_is_checked_in_ranges(spark):
    rows = spark.createDataFrame([(k, 1 if k % 10 else None, "a", "ok") for k in range(400)], "id long, tenant_id long, action string, result string")
    chain = audit.build_chain(rows)
    bent = chain.selectExpr("id", "tenant_id", "action", "CASE WHEN id % 71 = 5 THEN 'x' ELSE result END AS result", "CASE WHEN id % 53 = 7 THEN 'y' WHEN id % 59 = 3 THEN NULL ELSE prev_hash END AS prev_hash", "CASE WHEN id % 37 = 11 THEN NULL ELSE row_hash END AS row_hash")
    reports = [sorted(map(str, audit.verify_chain(bent, n).collect())) for n in (1, 2, 7, 40)]
    assert all(r == reports[0] for r in reports)
    mine = [r for r in bent.orderBy("id").collect() if r.tenant_id == 1]
    breaks = sum(1 for a, b in zip(mine, mine[1:]) if b.row_hash and b.prev_hash and a.row_hash and b.prev_hash != a.row_hash)
    gaps = sum(1 for i, r in enumerate(mine) if r.row_hash is None or (r.prev_hash is None and any(x.row_hash for x in mine[:i])))
    got = next(r for r in audit.verify_chain(bent, 9).collect() if r.tenant_id == 1)
    assert (got.rows, got.breaks, got.gaps) == (360, breaks, gaps) and breaks and gaps
    slim = bent.selectExpr("CAST(tenant_id AS STRING) AS tenant_key", "id", "prev_hash", "row_hash", "row_hash AS expected").where("tenant_key IS NOT NULL")
    tasks = slim.repartitionByRange(9, "tenant_key", "id").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 5  # one tenant, many tasks
    assert audit.verify_chain(rows.limit(0).selectExpr("*", "'' AS prev_hash", "'' AS row_hash")).count() == 0


def test_old_tables_of_a_stream_go(spark, tmp_path):
    schema = "seq long, doc_key long, event_type string, available int"
    log, index = f"{tmp_path}/log", f"{tmp_path}/index"
    for n in range(5):
        streams.index_change_log(arrive(log, [[(n, 7, "index", None), (100 + n, 8 + n, "index", None)]], spark, schema), index, f"{tmp_path}/c").awaitTermination()
    assert {r.doc_key for r in streams.read_index(spark, index).collect()} == {7, 8, 9, 10, 11, 12}
    assert len(streams.batches_in(spark, f"{index}/pointers")) == 2
    bucket = spark.range(1).selectExpr(f"pmod(xxhash64(7L), {streams.BUCKETS}) AS b").first().b
    assert len(list((tmp_path / "index/states").glob(f"batch=*/bucket={bucket}"))) == 2


def test_running_usage_goes_on_after_a_restart(spark, tmp_path):
    schema = "tenant_id long, period string, seq long, doc_delta int, bytes long"
    steps = [(t, "p", k, -1 if (k * 7 + t) % 5 < 3 else 1, k % 11) for k in range(120) for t in (1, 2)]
    want = {r.tenant_id: (r.docs, r.bytes) for r in audit.meter(spark.createDataFrame(steps, schema)).collect()}
    for part in (steps[:80], steps[80:]):  # a stop and a new start in between
        for half in (part[: len(part) // 2], part[len(part) // 2 :]):
            stream = arrive(f"{tmp_path}/log", [half], spark, schema)
        streams.run_once(streams.running_usage(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    rows = spark.read.parquet(f"{tmp_path}/out").orderBy("seq").collect()
    assert {r.tenant_id: (r.docs, r.bytes) for r in rows} == want
    assert len(rows) == 8  # two tenants in four batches
