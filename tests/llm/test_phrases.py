"""Counting quotient filters and phrase mining against plain counting."""

import re
from collections import Counter

import numpy as np
import pytest

from corpuspark.llm import phrases
from corpuspark.llm.quotient import PackedGrams, QuotientFilter, from_varints, varints


@pytest.mark.parametrize(("n", "bits"), [(2, 1), (2, 15), (3, 17), (5, 13), (5, 25), (4, 31)])
def test_filters_are_lossless(n, bits):
    random = np.random.default_rng(n * bits)
    ids = [random.integers(0, min(1 << bits, 9), 4000) | (random.integers(0, 2, 4000) << (bits - 1)) for _ in range(n)]
    packing = PackedGrams(n, bits)
    assert all((a == b).all() for a, b in zip(ids, packing.unpack(packing.pack(ids)), strict=True))
    want = Counter(zip(*(x.tolist() for x in ids), strict=True))
    for quotient in (1, 8, 40):
        whole = QuotientFilter.of(packing, quotient, ids)
        assert (np.diff(whole.quotients().astype(np.int64)) >= 0).all()
        shards = [QuotientFilter.of(packing, quotient, [x[k::3] for x in ids]) for k in range(3)]
        parts = [(k, QuotientFilter.load(packing, quotient, p.dump())) for s in shards for k, p in s.ranges(3)]
        got = Counter()
        for k in {k for k, _ in parts}:
            grams, counts = QuotientFilter.merged([p for j, p in parts if j == k]).at_least(1)
            for key, count in zip(zip(*(x.tolist() for x in grams), strict=True), counts.tolist(), strict=True):
                assert key not in got  # an n-gram lies in one range
                got[key] = count
        assert got == want


def test_varints():
    values = np.array([0, 1, 127, 128, 16383, 16384, (1 << 64) - 1, 1 << 63, 5], np.uint64)
    assert from_varints(varints(values)).tolist() == values.tolist()
    assert from_varints(varints(values[:0])).tolist() == []


def brute(rows, least, top):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        some = {g: c for g, c in counts.items() if len(g) > 1 and c >= least}
        found = []
        for g, a in some.items():
            around = [h for h in some if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))]
            if any(100 * some[h] >= 100 * a for h in around):
                continue
            score, _, left, right = min((1000 * a * n[lang] // (counts[g[:k]] * counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


ROWS = [
    ("en", "The quick brown fox. THE QUICK brown fox, the quick\tbrown  dog"),
    ("en", "the quick brown fox the quick brown fox\x0bthe quick"),
    ("de", "über den Fluß über den Fluß; über den ÜBER den"),
    (None, "no language here no language here"),
    ("und", "no language"),
    ("en", None),
    ("fr", "...!?\n \t "),
    ("fr", ""),
    ("en", "x " * 3000),
    ("en", "y" * 70_000 + " z " + "y" * 70_000 + " z"),
    ("en", "the quick brown fox. THE QUICK brown fox, the quick\tbrown  dog"),
]


@pytest.mark.parametrize("way", ["broadcast", "join", "small"])
def test_equals_brute_force(spark, monkeypatch, way):
    if way == "join":
        monkeypatch.setattr(phrases, "DICTIONARY_BYTES", 0)
    if way == "small":  # many ranges, shards and buckets
        for name, value in {"GRAMS_OF_RANGE": 64, "GRAMS_AT_ONCE": 50, "WORDS_OF_BUCKET": 2, "SLICE_BYTES": 100}.items():
            monkeypatch.setattr(phrases, name, value)
    docs = spark.createDataFrame([(i, lang, text, "mine", 7) for i, (lang, text) in enumerate(ROWS)], "doc_id long, lang string, text string, word string, f int").repartition(3)
    got = phrases.collocations(docs, least=2, top=6)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(ROWS, 2, 6)


def test_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert phrases.collocations(docs).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None)], docs.schema)).count() == 0
