"""Batches of the registered streams."""

from conftest import SMALL
from pyspark.sql import functions as F

from corpuspark.plans import streaming
from corpuspark.plans.base import Views


def test_batches_are_files_of_many_tasks(spark, monkeypatch):
    """A batch comes as several files though one part's rows lie in one task's split; batches keep to their parts."""
    made = []
    real = streaming.streams.read_log
    monkeypatch.setattr(streaming.streams, "read_log", lambda s, path, schema, n: made.append(n) or real(s, path, schema, n))
    rows = spark.range(0, 4000, 1, 4).withColumn("text", F.sha2(F.col("id").cast("string"), 256))
    last = rows.limit(1).withColumn("id", F.lit(-1).cast("long"))
    stream, out = streaming.stream_of(Views(spark, SMALL), "rows", rows, streaming.in_order(rows, "id"), last)
    seen = {}
    streaming.streams.each_batch(stream, lambda b, n: seen.update({n: ([r.id for r in b.select("id").collect()], b.rdd.getNumPartitions())}), f"{out}/checkpoint").awaitTermination()
    assert made[0] > 1
    parts = [sorted(ids) for ids, _ in (seen[n] for n in sorted(seen))]
    assert parts == [list(range(1334)), list(range(1334, 2667)), list(range(2667, 4000)), [-1]]
    tasks = {n for _, n in seen.values()}
    assert max(tasks) > 1
