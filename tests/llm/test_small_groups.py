"""Small groups beside large ones: labels, languages, shards, and column names with signs in them."""

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from corpuspark.llm import compaction, embeddings, langid, toxicity

pytest.importorskip("public_tokenizers")


def test_small_labels_are_compared_whole(spark, monkeypatch):
    """150 labels of two near vectors each; the audit sees none of them and a large label needs many bits."""
    random = np.random.default_rng(4)
    rows = []
    for k in range(150):
        x = random.standard_normal(64)
        y = x + 0.023 * np.linalg.norm(x) * random.standard_normal(64)
        rows += [(2 * k, x.tolist(), f"s{k}"), (2 * k + 1, y.tolist(), f"s{k}")]
    rows += [(1000 + k, x.tolist(), "large") for k, x in enumerate(random.standard_normal((400, 64)))]
    near = {i for k in range(150) for i in (2 * k, 2 * k + 1) if np.dot(*(np.array(rows[2 * k + j][1]) / np.linalg.norm(rows[2 * k + j][1]) for j in (0, 1))) >= 0.98}
    assert len(near) > 200
    monkeypatch.setattr(embeddings, "AUDIT_QUERIES", 1)
    monkeypatch.setattr(embeddings, "seed_bits", lambda n, old=embeddings.seed_bits: old(n) and 26)
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert {r.vec_id for r in got if r.n_links} == near


def test_a_language_of_one_long_text_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_BYTES", 5_000)
    monkeypatch.setattr(langid, "PIECE", 500)
    for k in range(4):
        rows = [("aa", " ".join(f"salo{(i * 7 + k) % 13}mira" for i in range(4000))), ("bb", "der die das und")]
        model = langid.train(spark.createDataFrame(rows, "lang string, text string"))
        assert model.langs == ["aa", "bb"]
        found = langid.predict(spark.createDataFrame([(1, "salo3mira salo9mira"), (2, "und das")], "doc_id long, text string"), model)
        assert {r.doc_id: r.lang_pred for r in found.collect()} == {1: "aa", 2: "bb"}


def test_merged_shards_go(spark, tmp_path):
    schema = "doc_id long, text string"
    store = compaction.ShardStore(spark, f"file://{tmp_path}/store", fan_in=3)
    for k in range(12):
        base = store.version()
        fresh = store.write(spark.createDataFrame([(k, f"text {k}")], schema).coalesce(1))[0]
        store.commit(store.shards(base) + [s for s in fresh if s["bytes"]], base)
        store.compact(spark.createDataFrame([], schema).schema)
    assert store.read(schema).count() == 12
    live = {s["path"] for v in (store.version() - 1, store.version()) for s in store.shards(v)}
    assert len(list((tmp_path / "store/data").rglob("*.parquet"))) <= len(live)
    assert len(list((tmp_path / "store/manifest").glob("*.json"))) == 2


def test_columns_with_dots(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).withColumn("a.b", F.lit("x")).withColumn("c`d", F.lit(1))
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_unknown_language, corpus_pipeline.drop_near_duplicates):
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and out.count() > 0
    assert toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), F.lit(True)), docs.columns).count() == 60
