"""Super-k-mers against every window of every text, and on odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest

from corpuspark.llm import superkmers


def brute(rows):
    """Sorted (doc_id, n_words, n_removed, kept_sha256); rows (doc_id, text)."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    last = float("inf")
    least = {}
    for i, w in split:
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            least[g] = min(least.get(g, last), last if i is None else i)
    out = []
    for i, w in split:
        gone = {p for k in range(len(w) - 12) if least[tuple(w[k : k + 13])] < (last if i is None else i) for p in range(k, k + 13)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def texts(seed):
    r = random.Random(seed)
    some = [f"w{k}" for k in range(40)] + ["über", "ÜBER", "🙂", "a" * 90]
    passage = " ".join(r.choice(some) for _ in range(60))
    rows = []
    for i in r.sample(range(1000), 60):
        t = " ".join(r.choice(some) for _ in range(r.choice([0, 5, 12, 13, 14, 40, 200])))
        if r.random() < 0.5:
            t += r.choice([" ", "\n", "\x0b\x0c "]) + passage[r.randrange(30) :] + " " + " ".join(r.choice(some) for _ in range(9))
        rows.append((i, t))
    rows += [(2000 + k, rows[k % 7][1]) for k in range(20)]  # copies
    rows += [(3000 + k, " ".join(f"u{k}x{j}" if j % 14 == 7 else some[j % 30] for j in range(60))) for k in range(30)]  # changing words in a frame
    return rows


@pytest.mark.parametrize("how", ["plain", "hot", "overfull", "parts"])
def test_equals_brute_force(spark, monkeypatch, how):
    if how == "hot":
        monkeypatch.setattr(superkmers, "HOT", 0)
    if how == "overfull":
        monkeypatch.setattr(superkmers, "HOT", 1 << 40)
        monkeypatch.setattr(superkmers, "MOST_OF_PART", 1000)
    if how == "parts":
        monkeypatch.setattr(superkmers, "PART_BYTES", 500)
        monkeypatch.setattr(superkmers, "TASK_BYTES", 2000)
        monkeypatch.setattr(superkmers, "MOST_WINDOWS", 2)
    rows = texts(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, superkmers.without_repeats(docs).collect()), key=repr)
    assert got == brute(rows)
    assert any(n for _, _, n, _ in got)


def test_odd_rows(spark):
    long = " ".join(f"v{k % 9000}" for k in range(30_000))
    passage = " ".join(f"p{k}" for k in range(20))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "same " * 500), (5, "same " * 14), (6, long), (7, long), (7, long), (8, passage), (8, passage + " more"), (None, passage), (None, passage + " x"), (None, None), (-5, passage[:60])]
    docs = spark.createDataFrame([(i, t, "mine", 3) for i, t in rows], "doc_id int, text string, words string, key int")
    got = superkmers.without_repeats(docs)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    assert superkmers.without_repeats(docs.where("false")).count() == 0


def test_windows_of_equal_hashes_are_compared_by_their_words():
    a, b = " ".join("abcdefghijklm"), " ".join("abcdefghijkln")
    rows = [x.encode() for x in (a, b, a + " x", b)]
    found = superkmers.Bucket(np.array([len(x) for x in rows]), np.frombuffer(b"".join(rows), np.uint8))
    found.rolling = (found.rolling[0] & np.uint64(0), found.rolling[1])  # all windows have one hash
    counts, least = found.least(np.arange(4), np.array([4, 3, 2, 9]))
    assert counts.tolist() == [1, 1, 2, 1] and least.tolist() == [2, 3, 2, 2, 3]


def test_parcels():
    words = np.frombuffer(b"one two three", np.uint8)
    got = superkmers._opened(superkmers._parcel(np.array([3, 10]), np.array([-5, 7]), np.array([1 << 62, 7]), words.tobytes()))
    assert [x.tolist() for x in got] == [[3, 10], [-5, 7], [1 << 62, 7], list(b"one two three")]
