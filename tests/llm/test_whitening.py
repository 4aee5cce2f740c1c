"""Shifted CholeskyQR against eigenvectors of the covariance in exact arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest
from conftest import SMALL

from corpuspark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def exact(rows):
    """(remaining rows as whole numbers, n, S, covariance in doubles from exact sums)."""
    fit = [(i, [math.floor(1024 * c) + 100000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(fit), len(fit[0][1])
    sums = [sum(x[k] for _, x in fit) for k in range(d)]
    cov = np.array([[float(Fraction(sum((n * x[a] - sums[a]) * (n * x[b] - sums[b]) for _, x in fit), n**3)) for b in range(d)] for a in range(d)])
    return fit, n, sums, cov


def check(got, rows, components=8):
    fit, n, sums, cov = exact(rows)
    values, turned = np.linalg.eigh(cov)
    values, turned = values[::-1], turned[:, ::-1]
    k = min(components, len(values))
    by = {(r.vec_id, r.component): r for r in got}
    assert len(by) == len(got) == len(fit) * k
    y = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for _, x in fit])
    dev = {i: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for i, x in fit}
    for c in range(k):
        if values[c] < 1e-9 * values[0]:
            assert all(by[i, c + 1].whitened is None for i, _ in fit)
            continue
        want = y @ turned[:, c] / math.sqrt(values[c])
        have = np.array([by[i, c + 1].whitened for i, _ in fit])
        sign = 1 if want @ have > 0 else -1
        assert np.abs(sign * have - want).max() < 1e-8
        assert all(abs(by[i, c + 1].explained / (values[c] / values.sum()) - 1) < 1e-10 for i, _ in fit)
    assert all(r.deviation == dev[r.vec_id] and r.n == n for r in got)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_random(spark):
    random = np.random.default_rng(3)
    shape = random.normal(size=(12, 12)) * np.geomspace(1, 0.01, 12)
    rows = [(i, v) for i, v in enumerate((random.normal(size=(300, 12)) @ shape).astype(np.float32).tolist())]
    rows += [(1000, None), (1001, []), (1002, [1.0] * 11 + [None]), (1003, [float("nan")] * 12), (1004, [1.0] * 11 + [float("inf")])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(5)
    check(whitening.whitened(df).collect(), rows)


@pytest.mark.parametrize("kind", ["constant", "copies", "steep", "wide"])
def test_deficient_rank(spark, kind):
    random = np.random.default_rng(5)
    v = random.normal(size=(40, 10))
    if kind == "constant":
        v[:, 3:] = 0.5
    elif kind == "copies":
        v[:, 5:] = v[:, :5]
    elif kind == "steep":  # the rounding to whole numbers keeps some variance of each
        v *= np.geomspace(1e6, 0.05, 10)
    else:
        v = v[:4]
    rows = [(i, x) for i, x in enumerate(v.astype(np.float32).tolist())]
    df = spark.createDataFrame([(i, x, 0) for i, x in rows], SCHEMA).repartition(3)
    got = whitening.whitened(df).collect()
    if kind == "steep":
        assert got[0].identity_error < 1e-6 and len(got) == 8 * 40
    else:
        check(got, rows)


def test_given_table(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    check(whitening.whitened(df).collect(), [(r.vec_id, r.embedding) for r in df.collect()])


def test_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert whitening.whitened(none).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None, None), (2, [], 1)], SCHEMA)).count() == 0
    one = whitening.whitened(spark.createDataFrame([("a", [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0]), ("a", [5.0])], "vec_id string, embedding array<double>")).collect()
    assert sorted((r.vec_id or "", r.component) for r in one) == [(i, c) for i in ("", "a") for c in (1, 2, 3)]
    assert all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 and r.n == 2 for r in one)
    far = spark.createDataFrame([(i, [float(i), 2.0e9 * (-1) ** i]) for i in range(40)] + [(99, [1e300, 1.0])], "vec_id int, embedding array<double>")
    got = whitening.whitened(far.withColumn("component", far.vec_id)).collect()
    assert len(got) == 80 and {r.deviation for r in got} == {None}


def test_first_factor_alone_does_not_do(spark, monkeypatch):
    random = np.random.default_rng(9)
    v = (random.normal(size=(60, 6)) * np.geomspace(3e3, 3, 6)).tolist()
    df = spark.createDataFrame([(i, x, 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int").repartition(2)
    rows = [(i, x) for i, x in enumerate(v)]
    check(whitening.whitened(df).collect(), rows)
    monkeypatch.setattr(whitening, "MOST_PASSES", 1)
    with pytest.raises(AssertionError):
        check(whitening.whitened(df).collect(), rows)
