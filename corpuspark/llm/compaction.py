"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable Parquet shards. Shards of similar size (the same power of ``FAN_IN``) that have become
``FAN_IN`` or more are merged, whole files at a time and without a shuffle, into files of about the target size. Every change is one
versioned manifest - the list of live shards - committed by an atomic rename that fails if the version exists; readers see a
version's shards and nothing else, so files of failed or repeated tasks are never visible. The rename must be atomic, as on HDFS and
local disks; on an object store without it, give the folder a committer or file system that has it. A manifest lists one line for each
file of about the target size, so ``TARGET_BYTES`` is to grow with the corpus (at 1 GB a file, 100,000 lines for 100 TB).

Defined results: all columns and all rows, nulls and repeated ones included, come back as they were; a row longer than the target is
in a file of its own size; an empty arrival adds no shard; reading a store without shards gives no rows; a lost race for a version
raises and leaves the store as the winner made it.
"""

from __future__ import annotations

import json
import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuspark.llm.common import scratch_path, table, unused

FAN_IN = 4
TARGET_BYTES = 64 << 20
LEAST_BYTES = 1 << 20
ARRIVALS = 4
MERGES_PER_JOB = 48
MAX_ROUNDS = 40


class ShardStore:
    """A folder with ``data/`` (immutable shards) and ``manifest/`` (one JSON file for each version)."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.target, self.fan_in = spark, root.rstrip("/"), target, fan_in
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def version(self) -> int:
        folder = self._path(f"{self.root}/manifest")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max([0, *(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())])

    def shards(self, version: int | None = None) -> list[dict]:
        """[{path, bytes}] of a version, the latest by default."""
        version = self.version() if version is None else version
        if not version:
            return []
        text = self.spark.read.text(f"{self.root}/manifest/{version:08d}.json", wholetext=True).first()[0]
        return json.loads(text)["shards"]

    def read(self, schema, version: int | None = None) -> DataFrame:
        paths = [s["path"] for s in self.shards(version)]
        reader = self.spark.read.schema(schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, shards: list[dict], base: int) -> int:
        """Write the manifest that follows ``base``: to a file of its own first, then renamed; an existing version is never replaced."""
        fs, path = self._fs, self._path
        target, draft = path(f"{self.root}/manifest/{base + 1:08d}.json"), path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        fs.mkdirs(target.getParent())
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps({"version": base + 1, "shards": shards}).encode()))
        finally:
            out.close()
        jvm = self.spark._jvm
        never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf).rename(draft, target, never)
        return base + 1

    def _written(self, folder: str) -> list[dict]:
        found = self._fs.listStatus(self._path(folder))
        return [{"path": s.getPath().toString(), "bytes": s.getLen()} for s in found if s.getPath().getName().endswith(".parquet")]

    def write(self, rows: DataFrame, by: str | None = None) -> list[list[dict]]:
        """New shards of ``rows``, not yet in any manifest; one list for each value of ``by`` in order, a column that isn't kept."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        writer = rows.write
        (writer.partitionBy(by) if by else writer).parquet(folder)
        if not by:
            return [self._written(folder)]
        parts = [s.getPath() for s in self._fs.listStatus(self._path(folder)) if s.isDirectory()]
        number = lambda p: int(p.getName().split("=")[1])
        return [self._written(p.toString()) for p in sorted(parts, key=number)]

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / LEAST_BYTES, self.fan_in)) + 1) if size >= LEAST_BYTES else 0

    def due(self, shards: list[dict]) -> list[list[dict]]:
        """Runs to merge: shards of one tier, once they are ``fan_in`` or more, filled up to the target size. Those near it are done."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if s["bytes"] < self.target // 2:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        runs = []
        for _, members in sorted(tiers.items()):
            if len(members) < self.fan_in:
                continue
            run: list[dict] = []
            for s in sorted(members, key=lambda s: (s["bytes"], s["path"])):
                if run and sum(x["bytes"] for x in run) + s["bytes"] > self.target:
                    runs.append(run)
                    run = []
                run.append(s)
            runs.append(run)
        return [r for r in runs if len(r) > 1]

    def compact(self, schema) -> int:
        """Merge until no tier is due; returns the version reached. One task for each new file, no shuffle."""
        for _ in range(MAX_ROUNDS):
            base = self.version()
            shards = self.shards(base)
            runs = self.due(shards)
            if not runs:
                self.vacuum()
                return base
            fresh = []
            for a in range(0, len(runs), MERGES_PER_JOB):
                parts = [self.spark.read.schema(schema).parquet(*(s["path"] for s in r)).coalesce(1) for r in runs[a : a + MERGES_PER_JOB]]
                fresh += self.write(reduce(DataFrame.unionAll, parts))[0]
            merged = {s["path"] for r in runs for s in r}
            self.commit([s for s in shards if s["path"] not in merged] + fresh, base)
            self.vacuum()
        raise RuntimeError("compaction did not settle")

    def vacuum(self) -> None:
        """Delete the shards that no version lists but ones before the latest two, then the manifests of those. Shards that no manifest has
        listed yet stay: an append may be about to."""
        version = self.version()
        folder = self._path(f"{self.root}/manifest")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        old = sorted(v for v in (int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()) if v < version - 1)
        live = {s["path"] for v in (version - 1, version) if v > 0 for s in self.shards(v)} if old else set()
        for v in old:
            for s in self.shards(v):
                if s["path"] not in live:
                    self._fs.delete(self._path(s["path"]), False)
            self._fs.delete(self._path(f"{self.root}/manifest/{v:08d}.json"), False)


def ingest(docs: DataFrame, store: ShardStore, arrival, arrivals: int) -> None:
    """Write docs once, as ``arrivals`` arrivals by the column ``arrival`` (numbers from 0; rows without one come first); append and
    compact after each."""
    by = unused("_arrival", docs.columns)
    batches = store.write(docs.withColumn(by, F.coalesce(F.greatest(F.lit(0), F.least(arrival.cast("int"), F.lit(arrivals - 1))), F.lit(0))), by)
    for shards in batches:
        base = store.version()
        store.commit(store.shards(base) + [s for s in shards if s["bytes"]], base)
        store.compact(docs.schema)


def op4_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as it comes back from the last manifest; ``settled``: no tier of that manifest is still due."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    store = ShardStore(spark, scratch_path(spark, "shards"))
    ingest(docs, store, F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)), ARRIVALS)
    settled = not store.due(store.shards())
    return store.read(docs.schema).select("doc_id", F.sha2("text", 256).alias("text_sha256"), "lang", "source", "n_chars", F.lit(settled).alias("settled"))


QUERIES = {"op4_compaction": op4_compaction}
ORACLE_SQL = {"op4_compaction": "SELECT doc_id, sha256(text) AS text_sha256, lang, source, n_chars, true AS settled FROM documents"}
