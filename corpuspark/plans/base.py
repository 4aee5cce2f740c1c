"""Registration of queries over the views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuspark.sources.staging import spread, staged
from corpuspark.sources.views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Views:
    """The views of one folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str, ready: dict[str, DataFrame] | None = None):
        self.spark, self.sf_dir, self.ready = spark, sf_dir, ready or {}

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name, self.ready)


def read_often(v: Views, name: str) -> Views:
    """The views over a staged copy of the table ``name`` where each reading of it would be a shuffle, as it comes in few files."""
    table = v.spark.read.parquet(f"{v.sf_dir}/{name}.parquet")
    if name in v.ready or spread(table) is table:
        return v
    return Views(v.spark, v.sf_dir, v.ready | {name: staged(spread(table), name)})


def query(name: str, sql: str | None = None):
    """Register a function of Views under ``name``, with its DuckDB SQL if there is any."""

    def register(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return register
