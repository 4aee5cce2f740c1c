"""The tables of block pairs are exploded from few bytes of fingerprints; Spark must not take them for small ones."""

import pytest

pytest.importorskip("public_tokenizers")

from corpuspark.llm import simhash  # noqa: E402


def test_exploded_tables_are_never_broadcast(spark):
    prints = spark.range(2000).selectExpr("xxhash64(id div 2) ^ (id % 2) AS f0", "xxhash64(id div 2, 1) AS f1", "1 AS n")
    near = simhash.near_counts(prints)
    plan = lambda: near._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan() and "Broadcast" not in plan()
    assert [r.n_near for r in near.collect()] == [1] * 2000
    assert "isFinalPlan=true" in plan() and "Broadcast" not in plan()
