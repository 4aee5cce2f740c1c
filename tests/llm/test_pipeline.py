"""The pipeline's stages against the operators and brute force."""

from collections import defaultdict

import pytest
from conftest import SMALL

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_columns_and_rows_follow(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = docs.selectExpr("*", "'x' AS score", "1 AS predicted", "'y' AS row")
    seen = extra
    ids = [{r.doc_id for r in seen.select("doc_id").collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = corpus_pipeline.stored(stage(spark, seen, SMALL), name)
        assert seen.columns == extra.columns
        ids.append({r.doc_id for r in seen.select("doc_id").collect()})
        assert ids[-1] <= ids[-2]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    clean = [i for i in ids[0] if labels.get(i) == 0]
    assert sum(i in ids[1] for i in clean) >= 0.98 * len(clean)
    from test_llm_operators import roots, shingle_sets

    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in ids[2]}
    order = sorted(texts)
    sets, links = shingle_sets([texts[i] for i in order]), defaultdict(set)
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                links[i].add(j)
                links[j].add(i)
    root = roots(len(sets), links)
    assert ids[3] == {order[i] for i in range(len(order)) if root[i] == i}
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, SMALL)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids[3]


def test_odd_rows_pass(spark):
    rows = [(1, None), (2, ""), (3, "12"), (4, "the and of to"), (4, "the and of to"), (None, "the and of"), (None, "the and to")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 2, 3, 4]
    assert corpus_pipeline.drop_unknown_language(spark, docs, SMALL).where("doc_id IN (1, 2, 3)").count() == 0
    assert corpus_pipeline.drop_near_duplicates(spark, docs.where("false"), SMALL).count() == 0


def test_every_stage_takes_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "12"), (4, "the and of to"), (4, "the and of to"), (None, "the and of"), (5, "x" * 50_000), (6, "you idiot, you stupid clown, you moron " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars", "'a' AS score", "2 AS predicted", "'b' AS saved")
    whole = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("*", "'a' AS score", "2 AS predicted", "'b' AS saved")
    mixed = whole.unionByName(docs.withColumn("doc_id", docs.doc_id + 1_000_000))
    kept = corpus_pipeline.drop_toxic(spark, mixed, SMALL)
    ids = [r.doc_id for r in kept.select("doc_id").where("doc_id IS NULL OR doc_id > 1000000").collect()]
    assert kept.columns == mixed.columns and sorted(ids, key=str) == [1000001, 1000002, 1000003, 1000004, 1000004, 1000005, None]
    packed = corpus_pipeline.pack(spark, docs, SMALL)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {1, 2, 3, 4, 5, 6, None} and packed.where("doc_id = 4").count() == 2
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SMALL).count() == 0
