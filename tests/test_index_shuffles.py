"""The index of the searches: texts are shuffled once, of the active version only, whatever the tables' sizes; rows are those of a plain join."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from corpuspark.plans import retrieval
from corpuspark.plans.base import Views
from corpuspark.sources import staging


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def exchanges(plan):
    """The exchanges of a plan that aren't broadcasts and whose rows have texts."""
    inner = [plan.executedPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [plan.children().apply(i) for i in range(plan.children().size())]
    names = [plan.output().apply(i).name() for i in range(plan.output().size())]
    return (plan.nodeName() == "Exchange" and "content" in names) + sum(map(exchanges, inner))


@pytest.mark.parametrize("numbers", [1 << 22, 0])
def test_texts_are_shuffled_once(spark, monkeypatch, numbers):
    """Where neither vectors nor files can be broadcast it was twice."""
    monkeypatch.setattr(retrieval, "NUMBERS", numbers)
    found, real = {}, retrieval.staged
    monkeypatch.setattr(retrieval, "staged", lambda df, what: found.setdefault(what, df) and real(df, what))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert retrieval.Inputs(Views(spark, SMALL)).index.count()
        assert exchanges(found["index"]._jdf.queryExecution().executedPlan()) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_other_versions_are_not_shuffled(spark):
    v = Views(spark, SMALL)
    active = v.v_active.withColumnRenamed("active_version", "version")
    chunks = v.v_chunk_v1.unionByName(v.v_chunk_v2)
    kept, want = staging.among(chunks, active, "file_id", "version"), chunks.join(active, ["file_id", "version"], "left_semi")
    assert rows(want.select(*chunks.columns)) == rows(kept) and kept.count() < chunks.count()
    assert not staging.among(chunks, active.where("false"), "file_id", "version").count()


@pytest.mark.parametrize("numbers", [1 << 22, 0])
@pytest.mark.parametrize("bits", [1 << 26, 1])
def test_index_of_repeated_files(spark, monkeypatch, numbers, bits):
    """Files that are there twice, or have no id, and a filter that lets all pass."""
    monkeypatch.setattr(retrieval, "NUMBERS", numbers)
    monkeypatch.setattr(staging, "BITS", bits)
    given = Views(spark, SMALL).documents.where("doc_id < 30")
    some = given.unionByName(given.where("doc_id IN (3, 5)")).unionByName(given.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long")))
    v = Views(spark, SMALL, {"documents": some})
    x = retrieval.Inputs(v)
    docs = v.v_chunk_v1.unionByName(v.v_chunk_v2).join(v.v_active.withColumnRenamed("active_version", "version"), ["file_id", "version"])
    docs = docs.join(v.v_shown, ["file_id", "version", "chunk_order"]).join(x.files, "file_id", "left").na.fill(0, ["sensitivity"]).crossJoin(v.v_size)
    docs = docs.withColumn("vec_id", (F.col("file_id") * 31 + F.col("chunk_order")) % F.col("n_vectors")).join(v.embeddings, "vec_id").select(*x.index.columns)
    assert docs.where("file_id = 3").count() and rows(x.index) == rows(docs)
