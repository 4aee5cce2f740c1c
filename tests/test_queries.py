"""Registered queries against DuckDB on the smallest tables."""

import pytest
from conftest import SMALL, rows_of

from corpuspark.plans import retrieval
from corpuspark.plans.base import ORACLE_SQL, QUERIES
from corpuspark.plans.registry import FLAGSHIP


@pytest.fixture(scope="module", autouse=True)
def shared_inputs():
    """The retrieval queries take their staged inputs from one place, as a session of searches would."""
    real, made = retrieval.Inputs, {}
    retrieval.Inputs = lambda v: made.setdefault(v.sf_dir, real(v))
    yield
    retrieval.Inputs = real


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_equals_duckdb(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    want = duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL])
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES
