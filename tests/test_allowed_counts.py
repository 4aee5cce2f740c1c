"""Access is counted and checked without a row for each principal and file."""

import pytest
from conftest import SMALL, rows_of
from pyspark.sql import functions as F

from corpuspark.operators import access
from corpuspark.plans.registry import ORACLE_SQL, QUERIES

KBS = [("a", 0), ("b", 0), ("c", 1)]
#: user 1 reaches both bases of tenant 0, user 2 one of them and, by a grant, one of another tenant, user 3 none of its own.
ACCESS = [(1, 0, "a"), (1, 0, "b"), (2, 0, "b"), (2, 0, "c"), (3, 0, "c"), (2, 1, "c")]
LINKS = [(10, "a"), (10, "b"), (11, "b"), (12, "c"), (12, "a"), (13, "x"), (14, "b")]


@pytest.fixture
def tables(spark):
    return (
        spark.createDataFrame(ACCESS, "user_id long, tenant_id long, kb_id string"),
        spark.createDataFrame(KBS, "kb_id string, tenant_id long"),
        spark.createDataFrame(LINKS, "file_id long, kb_id string"),
    )


def without_pairs(monkeypatch, duck, spark, name):
    """The query equals its SQL though the table of principals and files isn't there."""
    monkeypatch.setattr(access, "allowed_files", None)
    assert rows_of(QUERIES[name](spark, SMALL).toPandas()) == rows_of(duck.execute(ORACLE_SQL[name]).df())


def test_counts_equal_pairs(monkeypatch, duck, spark, tables):
    pairs = access.allowed_files(*tables).groupBy("user_id", "tenant_id").agg(F.count("*").alias("files"), F.sum("file_id").alias("ids"))
    got = access.count_allowed(*tables)
    assert rows_of(got.toPandas()) == rows_of(pairs.toPandas())
    assert {tuple(r) for r in got.collect()} == {(1, 0, 4, 47), (2, 0, 3, 35), (2, 1, 1, 12)}
    without_pairs(monkeypatch, duck, spark, "a5_allowed_files")


def test_cleared_counts_equal_pairs(monkeypatch, duck, spark, tables):
    """A file with two sensitivities counts for each, as a join does."""
    levels = spark.createDataFrame([(10, 0), (11, 3), (11, 1), (12, 2), (14, 4)], "file_id long, sensitivity int")
    cleared = spark.createDataFrame([(1, 0, 4), (2, 0, 1), (2, 1, 1), (9, 0, 4)], "user_id long, tenant_id long, clearance int")
    pairs = access.sensitivity_filter(access.allowed_files(*tables), levels, cleared).groupBy("user_id", "tenant_id").agg(F.count("*").alias("files"))
    got = access.count_allowed(*tables, levels, cleared).drop("ids")
    assert rows_of(got.toPandas()) == rows_of(pairs.toPandas())
    assert {tuple(r) for r in got.collect()} == {(1, 0, 5), (2, 0, 2)}
    without_pairs(monkeypatch, duck, spark, "a6_sensitivity_filter")


def test_asked_files_equal_pairs(monkeypatch, duck, spark, tables):
    asked = spark.createDataFrame([(u, t, f) for u in (1, 2, 3, 4) for t in (0, 1) for f in range(9, 16)] * 2, "user_id long, tenant_id long, file_id long")
    assert rows_of(access.allowed_among(asked, *tables).toPandas()) == rows_of(access.allowed_files(*tables).toPandas())
    without_pairs(monkeypatch, duck, spark, "r24_cite")
