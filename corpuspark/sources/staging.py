"""Intermediate tables in the cluster's shared folder: they keep plans small and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, removed at the driver's end. Where that is unset a temporary folder will do on a
    single machine only; elsewhere it is an error, as executors would not see each other's files."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-corpuspark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder and read it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of ids, keys and at most a query's vector; some 20 MB at most.
FEW = 1 << 16


def few(df: DataFrame, name: str = "few") -> DataFrame:
    """Staged rows that are to be broadcast where they are at most ``FEW``, so that a large table that they meet isn't shuffled."""
    rows = staged(df, name)
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else rows


BITS = 1 << 26  # 8 MB
PART = 1 << 15  # bits of a row


def among(df: DataFrame, keys: DataFrame, *by: str, inside: bool = True) -> DataFrame:
    """The rows whose ``by`` (whole numbers) are among those of ``keys``, and some others whose hash is: these are told by a broadcast bitmap of
    at most ``BITS`` bits, so that ``df`` isn't shuffled, however many the keys are. Not ``inside``: all the other rows."""
    bit = F.pmod(F.xxhash64(*(F.col(c).cast("long") for c in by)), F.lit(BITS))
    bits = keys.select(bit.alias("_bit")).groupBy(F.floor(F.col("_bit") / PART).alias("_part")).agg(F.bitmap_construct_agg(F.col("_bit") % PART).alias("_bits"))
    rows = df.withColumn("_bit", bit).withColumn("_part", F.floor(F.col("_bit") / PART)).join(F.broadcast(bits), "_part", "inner" if inside else "left")
    byte = F.conv(F.hex(F.expr(f"substring(_bits, CAST(_bit % {PART} / 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    is_set = F.coalesce(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1, F.lit(False))
    return rows.where(is_set if inside else ~is_set).select(*df.columns)


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer files than cores is dealt out to all of them, as one file may be one task; any other stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
