"""The training-data operators against brute force, round trips and held-out labels, and on odd rows."""

import base64
import hashlib
import pathlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import SMALL, rows_of
from pyspark.sql import functions as F

from corpuspark.llm import bpe, chat, compaction, embeddings, entries, jaccard, langid, licenses, packing, simhash, textscan, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "   \n ", "en", "a", 5),
    (4, "word", None, "a", 4),
    (5, "the same five words here and more of them to make it long enough", "en", "a", 60),
    (6, "the same five words here and more of them to make it long enough", "en", "b", 60),
    (6, "the same five words here and more of them to make it long enough", "en", "b", 60),
    (7, "1234 !!! 5678", "de", "c", 13),
    (8, "x" * 30_000, "fr", "d", 30_000),
    (9, "Licensed under the Apache License, Version 2.0.\nplus <|im_end|> \\ <\\| 🙂 \x1c  z", "en", None, 50),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names an operator uses."""
    rows = spark.createDataFrame(ODD, DOC)
    return rows.withColumn("score", F.lit("mine")).withColumn("lang_pred", F.lit(1)).withColumn("component", F.lit(2)).withColumn("grams", F.lit("g"))


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.mark.parametrize("name", list(entries.oracle_sql()))
def test_equals_duckdb(spark, duck, name):
    got, want = entries.queries()[name](spark, SMALL).toPandas(), duck.execute(entries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_chat_folds_events(spark):
    e = [
        (1, "a", 1, "message", "user", "hi"),
        (1, "b", 2, "message", "assistant", ""),
        (1, "b", 3, "delta", None, "he"),
        (1, "b", 4, "delta", None, "llo"),
        (1, "c", 5, "message", "user", "more"),
        (1, "d", 6, "message", "assistant", "gone"),
        (1, "b", 7, "regenerate", None, "new "),
        (1, "b", 8, "delta", None, "text"),
        (1, "e", 9, "message", "user", "later"),
        (1, "f", 10, "message", "user", "x"),
        (1, "f", 11, "delete", None, None),
        (None, "a", 1, "message", None, None),
        (2, "a", 1, "message", "us\ner\\n", chat.END),
        (2, "a", 2, "edit", None, "<\\|" + chat.START),
    ]
    log = spark.createDataFrame(e, "conv_id long, msg_id string, seq long, event string, role string, text string")
    final = chat.reconstruct(log)
    assert [(r.role, r.text) for r in final.where("conv_id = 1").orderBy("seq").collect()] == [("user", "hi"), ("assistant", "new text"), ("user", "later")]
    back = {r.conv_id: r for r in chat.read_back(chat.render(final)).collect()}
    assert back[1].loss_chars == 8 and back[1].loss_sha256 == hashlib.sha256(b"new text").hexdigest()
    assert back[2].turns_sha256 == hashlib.sha256(f"us\ner\\n\n<\\|{chat.START}\n".encode()).hexdigest()
    assert back[None].n_turns == 1
    wide = spark.createDataFrame([(2**53 + 1, "a", 1, "message", "user", "x"), (None, "a", 1, "message", "user", "y")], log.schema)
    assert {r.conv_id for r in chat.read_back(chat.render(chat.reconstruct(wide))).collect()} == {2**53 + 1, None}
    assert chat.read_back(chat.render(chat.reconstruct(log.where("false")))).count() == 0


def test_turns_become_events_and_come_back(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a" * 700), (1, 1, "assistant", "a" * 700), (1, 1, None, ""), (None, None, "user", "z"), (2, 5, "user", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "'mine' AS seq", "1 AS msg_id", "'e' AS event")
    got = {r.conv_id: r for r in chat.read_back(chat.render(chat.reconstruct(chat.as_events(turns)))).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {1: (4, 1400), None: (1, 0), 2: (1, 0)}
    told = "user\n\n" + "\n\n" + 2 * f"assistant\n{'a' * 700}\n"
    assert got[1].turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
    assert chat.as_events(turns.where("false")).count() == 0


def links_by_force(vectors, labels, threshold):
    n = len(vectors)
    ok = [v is not None and len(v) > 0 and np.isfinite(np.array(v, float)).all() and np.any(v) and lab is not None for v, lab in zip(vectors, labels, strict=True)]
    found = defaultdict(set)
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and labels[i] == labels[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                    found[i].add(j)
                    found[j].add(i)
    return found


def roots(n, links):
    root = list(range(n))
    for _ in range(n):
        after = [min([root[i], *(root[j] for j in links[i])]) for i in range(n)]
        if after == root:
            return root
        root = after
    return root


def test_embedding_links_are_all_links(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 24))
    near = [base[i % 60] + rng.standard_normal(24) * rng.choice([0.02, 0.1, 0.2, 0.22]) for i in range(240)]
    vectors = [list(map(float, v)) for v in (*base, *near, *([base[0]] * 5), base[1] * 3)]
    vectors += [None, [], [0.0] * 24, [float("nan")] * 24, [1.0, 2.0], [1.0, 2.0]]
    labels = [int(k) % 2 for k in range(len(vectors))]
    labels[3] = None
    rows = [(k, v, lab) for k, (v, lab) in enumerate(zip(vectors, labels, strict=True))]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame([*rows, rows[7]], "vec_id long, embedding array<float>, label int")).collect()}
    as_float = [None if v is None else np.array(v, np.float32) for v in vectors]
    links = links_by_force(as_float, labels, embeddings.THRESHOLD)
    root = roots(len(vectors), links)
    assert [got[i].n_links for i in range(len(vectors))] == [len(links[i]) for i in range(len(vectors))]
    assert [got[i].component_id for i in range(len(vectors))] == root
    assert all(got[i].kept == (root[i] == i) for i in range(len(vectors)))
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(empty).count() == 0


def test_links_between_tight_groups_are_not_crowded_out(spark):
    rng = np.random.default_rng(11)
    rows = []
    for label, size in ((0, 30), (1, embeddings.BLOCK)):  # within a block, and a group filling each block of a bucket
        a, b = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
        for centre in (a, 0.983 * a + np.sqrt(1 - 0.983**2) * b):
            noise = rng.standard_normal((size, 64))
            noise *= 0.002 / np.linalg.norm(noise, axis=1, keepdims=True)
            rows += [(len(rows) + i, x.astype(np.float32).tolist(), label) for i, x in enumerate(centre + noise)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    links = links_by_force([np.array(v, np.float32) for _, v, _ in rows], [label for *_, label in rows], embeddings.THRESHOLD)
    root = roots(len(rows), links)
    assert len(set(root)) == 2
    assert [got[i].n_links for i in range(len(rows))] == [len(links[i]) for i in range(len(rows))]
    assert [got[i].component_id for i in range(len(rows))] == root


def isolated_pairs(n, seed):
    """Random vectors, every tenth with a near copy: nothing but the descent leads from one to the other where no table has both."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, 48))
    near = base[::10] + 0.18 * rng.standard_normal((len(base[::10]), 48))
    return [(i, x.astype(np.float32).tolist(), "one") for i, x in enumerate(np.concatenate([base, near]))]


def test_rounds_find_what_the_start_misses(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "SEED_TABLES", 2)
    vectors = spark.createDataFrame(isolated_pairs(1500, 3), "vec_id long, embedding array<float>, label string")
    reps = vectors.transform(embeddings.classes).withColumnRenamed("vec_id", "rep").withColumn("n", F.lit(1)).withColumn("size", F.lit(1650)).cache()
    joined = lambda: embeddings.neighbour_graph(reps, embeddings.NEIGHBOURS, 0).count() / 300
    assert joined() > 0.92
    monkeypatch.setattr(embeddings, "MAX_ROUNDS", 0)
    assert joined() < 0.9


def test_a_failed_audit_leads_to_the_exact_way(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "SEED_TABLES", 1)
    monkeypatch.setattr(embeddings, "MAX_ROUNDS", 0)
    rows = isolated_pairs(400, 4)
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string"), 1).toPandas()
    links = links_by_force([np.array(v, np.float32) for _, v, _ in rows], [x for *_, x in rows], embeddings.THRESHOLD)
    assert got.sort_values("vec_id").n_links.tolist() == [len(links[i]) for i in range(len(rows))]
    assert got.recall.iloc[0] < 1


def test_vectors_of_any_size_and_label(spark):
    rows = [(1, [1e200, 0.0], "a"), (2, [1e200, 0.0], "a"), (3, [1e-200, 1e-202], "a"), (4, [1.0, 0.0], "b"), (None, [1.0, 0.0], "b"), (5, [float("inf"), 1.0], "b"), (6, [1.0, 0.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").selectExpr("*", "1 AS rep", "'x' AS component_id", "2 AS n")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 4: (0, 4, True), None: (0, None, True), 5: (0, 5, True), 6: (0, 6, True)}


def test_language_of_held_out_texts(spark, docs):
    got = entries.queries()["op3_langid"](spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 30 and (got.lang_pred == got.lang).mean() >= 0.98 and got.score.between(0, 1).all()


def test_language_of_odd_texts(odd, none, docs):
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {1, 2, 3, 7} and got[1].score == 0
    assert langid.predict(odd, model, odd.columns).columns[-3:] == ["lang_pred_", "score_", "saved"]
    assert langid.predict(none, model).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.train(none)).collect()} == {"und"}
    assert langid.has_letter(np.frombuffer("é1 ÷".encode(), np.uint8), np.array([0, 2, 3, 6]), "é1÷".__getitem__).tolist() == [True, False, False]


def ppm_bits(train, text):
    """Method C with exclusions, byte by byte: the definition."""
    seen = [defaultdict(lambda: defaultdict(int)) for _ in range(langid.ORDER + 1)]
    pad = bytes([langid.BEFORE] * langid.ORDER)
    for t in train:
        b = pad + t
        for i in range(langid.ORDER, len(b)):
            for k, of_context in enumerate(seen):
                of_context[b[i - k : i]][b[i]] += 1
    bits, b = 0.0, pad + text
    for i in range(langid.ORDER, len(b)):
        excluded = set()
        for k in range(langid.ORDER, -1, -1):
            own = {x: n for x, n in seen[k].get(b[i - k : i], {}).items() if x not in excluded}
            if not own:
                continue
            whole = sum(own.values()) + len(own)
            if b[i] in own:
                bits += np.log2(whole / own[b[i]])
                break
            bits += np.log2(whole / len(own))
            excluded |= set(own)
        else:
            bits += np.log2(256 - len(excluded))
    return bits


def flat(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def test_code_lengths_are_those_of_the_definition(monkeypatch):
    monkeypatch.setattr(langid, "CACHED_BYTES", 1 << 14)  # the table of known costs is overwritten many times
    rng = np.random.default_rng(4)
    train = [bytes(rng.choice([97, 98, 99, 32, 10, 195], rng.integers(0, 60)).tolist()) for _ in range(25)]
    texts = [bytes(rng.choice([97, 98, 99, 100, 32, 10, 0, 195], rng.integers(0, 50)).tolist()) for _ in range(40)]
    model = langid.Model.freeze({"x": np.unique(langid.grams(*flat(train)), return_counts=True)})
    coder = langid.Coder(model)
    for _ in range(2):
        assert np.allclose(coder.bits(*flat(texts))[:, 0], [ppm_bits(train, t) for t in texts], atol=1e-3)


def test_rare_grams_and_contexts_count(spark):
    rows = spark.createDataFrame([("xyz" + "ab" * 4000, "a"), ("ab" * 4000, "b")], "text string, lang string")  # xyz is seen once
    got = langid.predict(spark.createDataFrame([(1, "xyz"), (2, "ab")], "doc_id long, text string"), langid.train(rows)).collect()
    assert got[0].lang_pred == "a" and got[0].score > 0.99


def test_training_share_is_bounded(spark, docs, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_BYTES", 60_000)
    got = langid.predict(docs, langid.train(docs), ["doc_id", "lang"]).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95


def shingle_sets(texts):
    out = []
    for t in texts:
        w = [x for x in re.split(r"[ \t\n\r\f\v]+", (t or "").lower()) if x]
        out.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def test_jaccard_links_are_all_links(spark, docs):
    some = docs.orderBy("doc_id").limit(120).toPandas()
    texts, rng = list(some.text), np.random.default_rng(2)
    for k in range(60):  # chains of growing edits around the threshold
        w = texts[k].split(" ")
        for at in rng.integers(0, len(w), max(1, len(w) // 60)):
            w[at] = f"new{k}"
        texts.append(" ".join(w))
    texts += ["one two three", "one two three", "one two four", None, "", "ONE  two\nthree"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in jaccard.near_duplicates(rows.unionByName(rows.limit(3))).collect()}
    sets = shingle_sets(texts)
    links = defaultdict(set)
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                links[i].add(j)
                links[j].add(i)
    root = roots(len(sets), links)
    assert [got[i].n_links for i in range(len(sets))] == [len(links[i]) for i in range(len(sets))]
    assert [got[i].group_id for i in range(len(sets))] == root


def test_jaccard_blocks_and_odd_rows(spark, odd, none, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 7)
    body = [f"w{k}" for k in range(200)]
    texts = [" ".join([*body[:k], f"edit{k}", *body[k + 1 :]]) for k in range(60)]
    got = jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.n_links, r.group_id) for r in got} == {(59, 0)}
    found = {r.doc_id: (r.class_id, r.n_links, r.kept) for r in jaccard.near_duplicates(odd).collect()}
    assert found[5] == (5, 1, True) and found[6] == (5, 1, False) and found[1] == (1, 0, True) and len(found) == 9
    assert jaccard.near_duplicates(none).count() == 0


def test_jaccard_of_shared_and_missing_ids(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    lone = " ".join(f"c{k}" for k in range(30))
    rows = [("x", a), ("y", b), ("z", a), ("z", b), (None, a), (None, lone), (None, lone), (None, ""), (None, None), ("e", None)]
    got = sorted((r.doc_id or "", r.class_id or "", r.n_links, r.group_id or "", r.kept) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    assert got == [
        ("", "", 0, "", True),
        ("", "", 0, "", True),
        ("", "x", 2, "x", False),
        ("e", "e", 0, "e", True),
        ("x", "x", 2, "x", True),
        ("y", "y", 1, "y", True),
        ("z", "x", 3, "x", False),
    ]


def test_band_choice():
    bands, rows = jaccard.choose_bands()
    assert bands * rows <= jaccard.HASHES and 1 - (1 - 0.8**rows) ** bands >= jaccard.RECALL


def test_toxicity_of_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    got = entries.queries()["op7_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet").dropDuplicates(["doc_id"]), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() >= 0.93 and (got.predicted == got.toxic).mean() >= 0.95


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (4, 0), (None, None), (6, None)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    assert toxicity.score(odd, model).where("score BETWEEN 0 AND 1").count() == len(ODD)
    assert toxicity.score(none, model).count() == 0
    untaught = toxicity.fit(odd, labels.where("false"))
    assert {r.predicted for r in toxicity.score(odd, untaught).collect()} == {0}


def test_label_model_finds_accuracies_and_correlations(spark):
    """Planted voters: two good ones, a weak one with an almost exact copy, and one that mostly abstains; a tenth of the rows has labels."""
    rng = np.random.default_rng(0)
    n = 20_000
    y = (rng.random(n) < 0.3).astype(int)
    right = lambda p: np.where(rng.random(n) < p, 2 * y - 1, 1 - 2 * y)
    good, fair, weak = right(0.9), right(0.8), right(0.65)
    copy = np.where(rng.random(n) < 0.95, weak, -weak)
    rare = np.where(rng.random(n) < 0.1, right(0.95), 0)
    v = np.stack([good, fair, weak, copy, rare], 1).astype(np.int8)
    label = np.where(np.arange(n) % 10 == 0, np.where(rng.random(n) < 0.97, y, 1 - y), -1)
    rows = [(x.tobytes(), None if t < 0 else int(t)) for x, t in zip(v, label, strict=True)]
    patterns = spark.createDataFrame(rows, "votes binary, toxic int").groupBy("votes", "toxic").agg(F.count("*").alias("n"))
    model = toxicity.fit_label_model(patterns)
    q = model.posterior(v, label)
    assert abs(model.prior - 0.3) < 0.05 and ((q > 0.5) == y).mean() > 0.88
    assert np.abs(model.accuracy - [0.9, 0.8, 0.65, 0.64, 0.95]).max() < 0.06
    assert {(2, 3), (3, 2)} & {(i, int(p)) for i, p in enumerate(model.parent)}
    others = [c for i, c in enumerate(model.correlation) if not {i, int(model.parent[i])} == {2, 3}]
    assert max(model.correlation) > 10 * max(others)


def test_named_words_and_stems_vote(spark):
    lexicon = toxicity.Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int32))
    texts = ["You IDIOT, you clown!", "a fine day", "", "WHAT LOUD WORDS"]
    raw = [t.encode() for t in texts]
    words, shouted, doc, column, n = lexicon.counts(*flat(raw))
    assert [toxicity.NAMES[c] for c in column] == ["stupidity", "ridicule"] and doc.tolist() == [0, 0] and words.tolist() == [4, 3, 0, 3]
    votes = lexicon.votes(words, shouted, doc, column, n)
    assert votes[0, 6 + toxicity.NAMES.index("ridicule")] == 1 and votes[1, -4] == -1 and votes[3, -1] == 1


def test_terms_are_mined_from_all_labelled_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_ROWS", 50)  # bounds the classifier's sample alone
    rows = [(i, f"plain words number w{i} " + ("grumbolt here" if i % 3 == 0 else "nothing"), int(i % 3 == 0)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    got = toxicity.score(docs, model, ["doc_id", "toxic"]).toPandas()
    assert (got.predicted == got.toxic).all() and len(model.lexicon.mined) > 0


def test_bpe_equals_tiktoken(spark, odd, none):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    signs = [" ", " ", "\n", "\t", "a", "bc", "é", "1", "'s", "'", "!", " ", "\x1c", "\x85", "字", "🙂", "<|endoftext|>"]
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(400)] + [r[1] or "" for r in ODD]
    small = bpe.table_of(path, public_tokenizers.PATTERN)
    small.bits, small.room = 5, 150  # the table is overwritten and emptied many times
    small._clear()
    for _ in range(2):
        for a in range(0, len(texts), 20):
            some = texts[a : a + 20]
            data, offsets = flat([t.encode() for t in some])
            ids, at = small.ids_of(data, offsets)
            for k, t in enumerate(some):
                assert ids[at[k] : at[k + 1]].tolist() == own.encode_ordinary(t)
                assert bpe.codec(path).decode(ids[at[k] : at[k + 1]].astype("<u4").tobytes()) == t.encode()
    bpe.table_of.cache_clear()
    assert bpe.encode_documents(odd, path, public_tokenizers.PATTERN).count() == len(ODD)
    assert bpe.digest_round_trip(none, path, public_tokenizers.PATTERN).count() == 0


def test_perfect_hash_is_minimal():
    keys = [f"k{i}".encode() for i in range(5000)]
    table = bpe.PerfectHash(keys)
    assert table.find(keys) == list(range(5000)) and table.find([b"other", b""]) == [-1, -1]
    assert sorted(table.keys) == sorted(keys)


def by_definition(spark, texts):
    """SimHash of each text, counted bit by bit from the hashes of its word pairs."""
    pairs = []
    for i, t in enumerate(texts):
        w = re.split(r"\s+", t.lower(), flags=re.ASCII)
        while w and w[-1] == "" and len(w) > 1:  # as Java's split
            w.pop()
        pairs += [(i, a, b) for a, b in zip(w, w[1:], strict=False)] if len(w) > 1 else [(i, w[0], None)] * (w[0] != "")
    hashed = spark.createDataFrame(pairs, "i int, a string, b string").selectExpr("i", "a", "b", "xxhash64(a, b) AS h", "xxhash64(a) AS one")
    ballots = defaultdict(lambda: np.zeros(128))
    weights = defaultdict(int)
    for r in hashed.selectExpr("*", "xxhash64(if(b IS NULL, one, h)) AS more").collect():
        low, w = (r.one, 1) if r.b is None else (r.h, min(4, 1 + (len(r.a) + len(r.b)) // 6))
        bits = [(x & (1 << 64) - 1) >> k & 1 for x in (low, r.more) for k in range(64)]
        ballots[r.i] += w * np.array(bits)
        weights[r.i] += w
    return [sum(1 << k for k in range(128) if 2 * ballots[i][k] > weights[i]) for i in range(len(texts))]


def test_fingerprints_and_neighbours(spark, docs, monkeypatch):
    monkeypatch.setattr(simhash, "ROWS_PER_RANGE", 20)
    monkeypatch.setattr(simhash, "BUCKET_PART", 3)
    got = simhash.op9_simhash(spark, SMALL).toPandas().sort_values("doc_id").reset_index(drop=True)
    texts = [t or "" for t in docs.orderBy("doc_id").toPandas().text]
    prints = [int(x, 16) for x in got.fingerprint]
    assert prints[:60] == by_definition(spark, texts[:60])
    for i, t in enumerate(texts):
        half, nxt = len(t) // 2, texts[(i + 1) % len(texts)]
        edited = t[: len(t) - half] + nxt[:half]
        assert got.edited_sha256[i] == hashlib.sha256(edited.encode()).hexdigest() and got.n_chars[i] == len(t)
        assert got.near_next[i] == 1 - bin(prints[i] ^ prints[(i + 1) % len(texts)]).count("1") / 128
        assert got.n_near[i] == sum(bin(prints[i] ^ p).count("1") <= simhash.RADIUS for p in prints) - 1
    assert got.near_edited.mean() > got.near_next.mean() + 0.1


def test_block_tables_find_the_whole_radius(spark):
    rng = np.random.default_rng(8)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    base = [int.from_bytes(rng.bytes(16), "big") for _ in range(12)]
    prints = sorted({b ^ sum(1 << int(k) for k in rng.choice(128, n, replace=False)) for b in base for n in range(10) for _ in range(4)})
    rows = [(signed(p & (1 << 64) - 1), signed(p >> 64), i % 3 + 1) for i, p in enumerate(prints)]
    for radius in (3, 6):
        got = {(r.f0, r.f1): r.n_near for r in simhash.near_counts(spark.createDataFrame(rows, "f0 long, f1 long, n int"), radius, 5).collect()}
        for p, (f0, f1, _) in zip(prints, rows, strict=True):
            want = sum(n for q, (_, _, n) in zip(prints, rows, strict=True) if 0 < bin(p ^ q).count("1") <= radius)
            assert got.get((f0, f1), 0) == want


def test_fingerprints_of_odd_rows(spark, odd, none):
    got = simhash.fingerprints(odd.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("t")), ["doc_id", "source"], "t").collect()
    by_id = {r.doc_id: (r.f0, r.f1) for r in got}
    assert by_id[5] == by_id[6] and by_id[1] == by_id[2] == (0, 0) and len(by_id) == 9
    assert simhash.with_next(none).count() == 0 and simhash.fingerprint_documents(none).count() == 0
    one = simhash.with_next(odd.where("doc_id = 5")).first()
    assert one.next_id == 5
    wide = spark.createDataFrame([(-(2**63), "a"), (2**63 - 1, "b"), (0, "c"), (1, "d"), (None, "e"), (None, "e")], "doc_id long, text string")
    follows = {(r.doc_id, r.next_id, r.next_text) for r in simhash.with_next(wide, 1).collect()}
    least, most = -(2**63), 2**63 - 1
    assert follows == {(least, 0, "c"), (0, 1, "d"), (1, most, "b"), (most, least, "a"), (None, least, "a")}
    whole = simhash.fingerprint_documents(wide.unionByName(odd.select("doc_id", "text"))).collect()
    assert len(whole) == 6 + len(ODD) and sum(r.doc_id is None for r in whole) == 2
    nameless = simhash.fingerprint_documents(wide.where("doc_id IS NULL")).collect()
    assert [(r.n_near, r.n_chars) for r in nameless] == [(1, 1), (1, 1)]


def test_ranges_hold_equal_numbers_however_ids_lie(spark):
    crowded = spark.range(2000).selectExpr("id AS doc_id").unionByName(spark.range(1).selectExpr("1000000000000000L AS doc_id"))
    cut = simhash.ranges(crowded, 20)
    sizes = cut.transform(crowded.withColumn("place", F.col("doc_id").cast("double"))).groupBy("range").count().toPandas()["count"]
    assert len(sizes) > 50 and sizes.max() < 300


def test_packing_is_a_round_trip(spark, odd, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    args = (public_tokenizers.path("byte_bpe_50k.json"),)
    more = spark.createDataFrame([(20, "a <|endoftext|> b<|endoftext|>"), (21, "<|endoftext|>"), (22, " ' '' 's  x\u00a0 y \u3000z \x1f ")], "doc_id long, text string")
    rows = odd.where("doc_id <> 6").select("doc_id", "text").unionByName(more)
    got = packing.pack(rows, *args).toPandas()
    for r in rows.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        mine = got[got.doc_id == r.doc_id].sort_values("piece")
        assert mine.length.sum() == len(ids) and (mine.length[mine.piece > 0] == 1024).all()
        for p in mine.itertuples():
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 1024
    assert packing.pack(none, *args).count() == 0
    assert packing.pack(odd, *args).where("doc_id = 6").count() == 2
    named = packing.pack(spark.createDataFrame([("a", "x"), (None, "y")], "doc_id string, text string"), *args).toPandas()
    assert sorted(named.doc_id, key=str) == [None, "a"] or set(named.doc_id.dropna()) == {"a"}


def test_best_two_fit_uses_all_and_packs_tightly():
    rng = np.random.default_rng(5)
    for size in (1, 7, 300, 20_000):
        lengths = rng.integers(1, 1025, size)
        counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
        plan = packing.best_two_fit(counts)
        used = defaultdict(int)
        for lengths_, times in plan:
            assert sum(lengths_) <= 1024 and times > 0
            for n in lengths_:
                used[n] += times
        assert dict(used) == counts
        bins, bound = sum(t for _, t in plan), max(-(-int(lengths.sum()) // 1024), int((lengths > 512).sum()))
        assert bins <= bound * 1.02 + 2
    assert packing.best_two_fit({600: 1, 400: 1, 300: 1, 120: 1}) == [([600, 300, 120], 1), ([400], 1)]


def test_compaction_keeps_all_rows_and_versions(spark, odd, none, tmp_path):
    store = compaction.ShardStore(spark, f"file://{tmp_path}/store", target=40_000, fan_in=3)
    for k in range(7):
        base = store.version()
        store.commit(store.shards(base) + store.write(odd.withColumn("k", F.lit(k)).coalesce(1))[0], base)
        store.compact(odd.withColumn("k", F.lit(k)).schema)
    schema = odd.withColumn("k", F.lit(1)).schema
    got = store.read(schema)
    assert got.count() == 7 * len(ODD) and got.where("text IS NULL").count() == 7 and got.columns == [*odd.columns, "k"]
    assert not store.due(store.shards()) and len(store.shards()) < 7
    before = store.shards()
    with pytest.raises(Exception, match="(?i)exist"):
        store.commit([], store.version() - 1)  # a writer that lost the race
    assert store.shards() == before
    own = spark.createDataFrame([(1, 7, None), (2, 8, 1), (3, 9, 0)], "doc_id long, _arrival int, at int")
    clash = compaction.ShardStore(spark, f"file://{tmp_path}/clash")
    compaction.ingest(own, clash, F.col("at"), 2)
    assert sorted(clash.read(own.schema).collect()) == sorted(own.collect())
    empty = compaction.ShardStore(spark, f"file://{tmp_path}/none")
    compaction.ingest(none, empty, F.lit(0), 2)
    assert empty.read(none.schema).count() == 0


def test_licence_scan_of_odd_rows(odd, none):
    got = {r.doc_id: r for r in licenses.scan(odd).collect()}
    assert got[9].licence == "Apache-2.0" and got[9].dice == 1.0 and got[1].n_matches == 0 and got[8].licence is None
    assert licenses.scan(odd).count() == len(ODD) and licenses.scan(none).count() == 0


def test_licences_in_longer_texts(spark):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 900)
    rows = [
        (1, (mit + " ") * 20),  # as many words as it may have, the same distinct bigrams
        (2, "Some words before. Released under the MIT License. Some words after"),
        (3, "# head\n# Redistribution and use in source and binary\n# forms, with or without modification, are permitted\n# provided that the following conditions are met: so"),
        (None, mit),
        (4, "nothing here"),
        (4, mit),
        (5, "word " * 30_000),
    ]
    got = sorted((str(r.doc_id), r.licence or "") for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", "MIT"), ("2", "MIT"), ("3", "BSD-3-Clause"), ("4", ""), ("4", "MIT"), ("5", ""), ("None", "MIT")]


@pytest.mark.parametrize(("name", "licence"), [("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0"), ("BSD", "BSD-3-Clause"), ("MPL-2.0", "MPL-2.0")])
def test_full_texts_are_found(spark, name, licence):
    path = pathlib.Path("/usr/share/common-licenses", name)
    if not path.exists():
        pytest.skip("this system has no licence texts")
    text = path.read_text()
    assert licence in licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().licences.split(",")


def test_word_hashes_don_t_depend_on_place():
    data = np.frombuffer("ab cd ab\néé ab".encode(), np.uint8)
    counts, hashes = textscan.words(data, np.array([0, 8, len(data)]))
    assert counts.tolist() == [3, 2] or counts.sum() == 5
    assert hashes[0] == hashes[2] == hashes[4] and len(set(hashes.tolist())) == 3
