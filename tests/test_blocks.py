"""Blocked scores against plain ones: several blocks of queries, ties, tenants, readers, odd rows."""

import random

import pytest

from corpuspark.operators import blocks, retrieval

WORDS = [f"w{k}" for k in range(30)]


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(5)
    vector = lambda: [r.choice([-1.0, 0.0, 1.0]) for _ in range(3)]  # noqa: E731  (few values: many ties)
    text = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    queries = [(k, k % 3, text(k % 5), vector()) for k in range(11)] + [(11, 0, None, None), (12, 1, "w1 w1 W1", [0.0, 0.0, 0.0])]
    docs = [(f"d{k:03}", k % 9, k % 3, text(r.randrange(12)), vector(), r.randrange(2), r.randrange(4)) for k in range(200)]
    docs += [("e1", 1, 1, None, None, 1, 0), ("e2", 1, 1, "", [1.0], 1, 0)]
    allowed = [(q, t, f, c) for q, t, *_ in queries for f in range(9) if (q + f) % 3 for c in [q % 4]]
    make = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    return (
        make(queries, "query_id long, tenant_id long, query_text string, q_vec array<float>"),
        make(docs, "doc_key string, file_id long, tenant_id long, content string, embedding array<float>, available int, sensitivity int"),
        make(allowed, "query_id long, tenant_id long, file_id long, clearance int"),
    )


def cosine(a, b):
    if not a or not b or len(a) != len(b):
        return 0.0
    n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    return round(sum(x * y for x, y in zip(a, b)) / n, 6) if n else 0.0


def overlap(query, doc):
    asked = set((query or "").lower().split())
    return round(len(asked & set((doc or "").split())) / len(asked), 6) if asked else 0.0


@pytest.mark.parametrize("size", [1024, 3])
def test_the_best_of_each_query(tables, monkeypatch, size):
    monkeypatch.setattr(blocks, "BLOCK_QUERIES", size)
    monkeypatch.setattr(blocks, "ROWS", 7)
    queries, docs, allowed = tables
    q, d = queries.collect(), docs.collect()
    got = {(r.query_id, r["rank"]): (r.doc_key, r.similarity) for r in retrieval.knn_topk(queries, docs, 4).collect()}
    want = {}
    for a in q:
        best = sorted((-cosine(a.q_vec, b.embedding), b.doc_key) for b in d if b.tenant_id == a.tenant_id)[:4]
        want |= {(a.query_id, k): (key, -s) for k, (s, key) in enumerate(best)}
    assert got == want
    may = {(r.query_id, r.tenant_id, r.file_id): r.clearance for r in allowed.collect()}
    got = {(r.query_id, r["rank"]): (r.chunk_key, r.score) for r in retrieval.hybrid_search(queries, docs, allowed, 5).collect()}
    want = {}
    for a in q:
        seen = [b for b in d if b.available == 1 and may.get((a.query_id, b.tenant_id, b.file_id), -1) >= b.sensitivity]
        best = sorted((-round(cosine(a.q_vec, b.embedding) + overlap(a.query_text, b.content), 6), b.doc_key) for b in seen)[:5]
        want |= {(a.query_id, k): (key, -s) for k, (s, key) in enumerate(best)}
    assert got == want


@pytest.mark.parametrize("size", [1024, 2])
def test_the_first_scores_are_those_of_all(tables, monkeypatch, size):
    monkeypatch.setattr(blocks, "BLOCK_QUERIES", size)
    queries, docs, _ = tables
    for score, name in ((retrieval.bm25_score, "bm25"), (retrieval.lexical_overlap, "overlap")):
        all_ = {}
        for r in score(queries, docs).collect():
            all_.setdefault(r.query_id, []).append((-r[name], r.doc_key))
        want = {(q, k): (key, -s) for q, rows in all_.items() for k, (s, key) in enumerate(sorted(rows)[:3])}
        assert {(r.query_id, r["rank"]): (r.doc_key, r[name]) for r in score(queries, docs, 3).collect()} == want


def test_no_queries_and_no_documents(tables):
    queries, docs, allowed = tables
    for q, d in ((queries.limit(0), docs), (queries, docs.limit(0))):
        assert retrieval.knn_topk(q, d, 3).count() == retrieval.hybrid_search(q, d, allowed).count() == retrieval.bm25_score(q, d).count() == 0
