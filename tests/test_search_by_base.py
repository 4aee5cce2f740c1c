"""Searches learn what may be read by base: same hits, and documents aren't shuffled to meet their readers."""

import random

import pytest
from pyspark.sql import functions as F

from corpuspark.operators import access, retrieval


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(3)
    links = [(f, f"k{k}") for f in range(12) for k in r.sample(range(5), r.randrange(3))]
    docs = [(f"d{n:02}", n % 12, n % 12 % 2, r.choice(["a b", "b c", "a c"]), [r.choice([0.0, 1.0]), 1.0], n % 5 > 0, n % 4) for n in range(60)]
    may = [(q, q % 2, f"k{k}", q % 4) for q in range(6) for k in r.sample(range(5), 3)]
    queries = [(q, q % 2, "a", [1.0, 0.0]) for q in range(6)]
    links = spark.createDataFrame(links, "file_id long, kb_id string")
    docs = spark.createDataFrame(docs, "doc_key string, file_id long, tenant_id long, content string, embedding array<double>, a boolean, sensitivity int")
    docs = docs.withColumn("available", F.col("a").cast("int")).drop("a").join(access.bases_of_files(links), "file_id", "left")
    bases = spark.createDataFrame(may, "query_id long, tenant_id long, kb_id string, clearance int")
    return spark.createDataFrame(queries, "query_id long, tenant_id long, query_text string, q_vec array<double>"), docs, bases, links


@pytest.mark.parametrize("bound", [1 << 18, 0])
def test_bases_find_what_files_find(tables, monkeypatch, bound):
    monkeypatch.setattr(retrieval, "READERS", bound)
    queries, docs, bases, links = tables
    files = bases.join(links, "kb_id").select("query_id", "tenant_id", "file_id", "clearance").distinct()
    got = {tuple(r) for r in retrieval.hybrid_search(queries, docs, bases, 4).collect()}
    assert got and got == {tuple(r) for r in retrieval.hybrid_search(queries, docs, files, 4).collect()}
    hits = retrieval.hybrid_search(queries, docs, bases, 4)
    chunks = docs.withColumnRenamed("doc_key", "chunk_key")
    may = retrieval.readable_files(hits, chunks, bases)
    assert retrieval.post_verify(hits, may, chunks)[0].count() == len(got)
    assert retrieval.post_verify(hits, may.where("query_id > 2"), chunks)[0].count() == sum(r[0] > 2 for r in got)


def test_documents_are_not_shuffled_to_their_readers(tables, monkeypatch):
    queries, docs, bases, _ = tables
    rows = []
    real = retrieval.over
    monkeypatch.setattr(retrieval, "over", lambda d, *how: rows.append(d) or real(d, *how))
    retrieval.hybrid_search(queries, docs.localCheckpoint(), bases, 4)
    plan = rows[0]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
