"""Small tables of which each has a number (``batch=N``): the last whole one counts, and a repeated one writes the same again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def batches_in(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the finished tables ``batch=N`` in a folder, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(folder)):
        return []
    names = [s.getPath() for s in fs.listStatus(path(folder)) if s.getPath().getName().startswith("batch=")]
    return sorted(int(p.getName().split("=")[1]) for p in names if fs.exists(path(p, "_SUCCESS")))


def latest(spark: SparkSession, folder: str, schema: str, before: int | None = None) -> DataFrame:
    """The table of the last batch (before a number); empty where there is none."""
    done = [n for n in batches_in(spark, folder) if before is None or n < before]
    return spark.read.schema(schema).parquet(f"{folder}/batch={done[-1]}") if done else spark.createDataFrame([], schema)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def keep_last(spark: SparkSession, folder: str, number: int) -> None:
    """Remove the tables before the last one that a repetition of batch ``number`` would start from."""
    for old in [n for n in batches_in(spark, folder) if n < number][:-1]:
        remove(spark, f"{folder}/batch={old}")


def write_number(df: DataFrame, folder: str, number: int, *by: str) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(f"{folder}/batch={number}")
