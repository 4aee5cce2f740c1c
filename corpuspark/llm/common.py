"""Helpers that several training-data operators share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuspark.sources.staging import fresh_path


BATCH_BYTES = 4 << 20


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder, removed when the driver's JVM ends."""
    return fresh_path(spark, name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table made by ``stored`` that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_texts(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` for rows with long texts: from here on the session's Arrow batches are bounded by bytes as well as by rows, so that
    neither an executor nor its Python workers hold thousands of long texts at once. ``run`` sees columns whose names aren't plain words under
    other names, in their places."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    names = [c if re.fullmatch(r"\w+", c) else f"_{k}" for k, c in enumerate(df.columns)]
    return (df if names == df.columns else df.toDF(*names)).mapInArrow(run, schema)


def afresh(column: str):
    """The same whole number under an expression that the planner doesn't see through. A join on it deals both sides out by exchanges of
    its own, even after an aggregate by the column, and Spark may then split the many rows of one key among tasks."""
    return F.col(column).bitwiseXOR(F.lit(0))


def kind_of(df: DataFrame, column: str) -> str:
    """A column's type as schema strings name it."""
    return df.schema[column].dataType.simpleString()


def quoted(names: list[str]) -> list[str]:
    """Column names as expressions, whatever signs they have."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def unused(name: str, taken: list[str]) -> str:
    """``name``, or with underscores added until no column has it, whatever the case."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def in_fold(column: str, buckets: int, remainder: int):
    """crc32 of the id as text, modulo ``buckets``, equals ``remainder``."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(buckets)) == remainder


class IdFilter:
    """A bitmap of hashed ids as a table of at most ``MOST_BITS`` / 32768 rows of 4 KB: small enough to broadcast, whatever the ids.

    ``maybe`` keeps the rows whose id may be among them, ``surely_not`` the others. Large rows then need no shuffle to find that they
    have no partner. With more ids than the bitmap can tell apart more rows pass ``maybe``; results don't change.
    """

    LEAST_BITS, MOST_BITS, BITS_FOR_ID = 1 << 23, 1 << 29, 16

    def __init__(self, ids: DataFrame, column: str):
        n = ids.count()
        self.bits = self.LEAST_BITS
        while self.bits < min(self.MOST_BITS, n * self.BITS_FOR_ID):
            self.bits *= 2
        x = self._hashed(column)
        self.column = column
        self.bitmap = ids.groupBy(F.bitmap_bucket_number(x).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("_bitmap"))

    def _hashed(self, column: str):
        return F.pmod(F.xxhash64(column), F.lit(self.bits).cast("long"))

    def _join(self, df: DataFrame, how: str) -> DataFrame:
        x = self._hashed(self.column)
        at = F.bitmap_bit_position(x)
        byte = F.conv(F.hex(F.substring("_bitmap", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
        is_set = F.getbit(byte, (at % 8).cast("int")) == 1
        return df.join(F.broadcast(self.bitmap), (F.bitmap_bucket_number(x) == F.col("_bucket")) & is_set, how)

    def maybe(self, df: DataFrame) -> DataFrame:
        return self._join(df, "left_semi")

    def surely_not(self, df: DataFrame) -> DataFrame:
        return self._join(df, "left_anti")
