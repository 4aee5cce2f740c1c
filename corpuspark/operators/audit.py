"""Tamper-evident audit chains and quotas."""

from __future__ import annotations

import hashlib
import ipaddress
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuspark.sources.staging import staged

#: The keys of a payload, in the order of their names.
PAYLOAD = ("action", "detail", "hit_chunk_ids", "ip", "kb_ids", "query_text", "request_id", "result", "tenant_id", "user_agent", "user_id")
ARRAYS, IDS = ("hit_chunk_ids", "kb_ids"), ("tenant_id", "user_id")


@F.pandas_udf(T.StringType())
def canonical_ip(ips: pd.Series) -> pd.Series:
    """The canonical form of an address; text that is none stays."""

    def one(x):
        try:
            return None if x is None else str(ipaddress.ip_address(x))
        except ValueError:
            return x

    return ips.map(one)


def canonical_payload(rows: DataFrame) -> Column:
    """Compact JSON of the payload columns, keys sorted, arrays sorted, ids as text; columns that ``rows`` lacks are null.

    ``detail`` may be a struct whose fields are in the order of their names; the time stamp is no part of it.
    """

    def value(name: str) -> Column:
        if name not in rows.columns:
            return F.lit(None).cast("string").alias(name)
        c = F.col(name)
        if name in ARRAYS:
            c = F.sort_array(c.cast("array<string>"))
        elif name in IDS:
            c = c.cast("string")
        elif name == "ip":
            c = canonical_ip(c)
        return c.alias(name)

    return F.to_json(F.struct(*map(value, PAYLOAD)), {"ignoreNullFields": "false"})


def row_hash(previous: Column, payload: Column) -> Column:
    """SHA-256 of the previous row's hash (hex, empty for none), a bar and the payload."""
    return F.sha2(F.concat(F.coalesce(previous, F.lit("")), F.lit("|"), payload), 256)


def build_chain(rows: DataFrame) -> DataFrame:
    """Add prev_hash and row_hash, chained by id within each tenant (null: the global chain).

    Each hash needs the one before, so a tenant is one stream of (tenant, id, payload) with constant state, never held whole.
    """

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = object(), None
        for batch in batches:
            before, after = [], []
            for tenant, payload in zip(batch.tenant_key, batch.payload, strict=True):
                if tenant != key:
                    key, last = tenant, None
                before.append(last)
                last = hashlib.sha256(f"{last or ''}|{payload}".encode()).hexdigest()
                after.append(last)
            yield pd.DataFrame({"id": batch.id, "tenant_key": batch.tenant_key, "prev_hash": before, "row_hash": after})

    tenant_key = F.coalesce(F.col("tenant_id").cast("string"), F.lit("")).alias("tenant_key")
    slim = rows.select("id", tenant_key, canonical_payload(rows).alias("payload")).repartition("tenant_key").sortWithinPartitions("tenant_key", "id")
    hashes = slim.mapInPandas(chain, "id long, tenant_key string, prev_hash string, row_hash string")
    return rows.join(hashes.drop("tenant_key"), "id")


CHECKED = "tenant_key string, id long, mismatch boolean, no_hash boolean, broken boolean, restart boolean, first boolean, pending boolean, edge string, part int, tail string, hashed boolean"


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tenant_key, id, mismatch, prev_hash, row_hash) of one range in order, each against the one before it; what the ranges before
    decide is left open: ``edge`` has the link of a tenant's first row here, ``pending`` marks its first hash without a link. Each tenant's last
    hash here follows as a row without id."""
    part, tenant, above, hashed = TaskContext.get().partitionId(), None, None, False
    names = [c.split()[0] for c in CHECKED.split(", ")]

    def tail() -> pa.RecordBatch:
        row = dict.fromkeys(names) | {"tenant_key": tenant, "part": part, "tail": above, "hashed": hashed}
        kinds = {"tenant_key": pa.string(), "id": pa.int64(), "edge": pa.string(), "part": pa.int32(), "tail": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array([row[k]], kinds.get(k, pa.bool_())) for k in names], names)

    for batch in batches:
        keys = batch.column(0)
        of = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]]) if len(of) else [0]
        links, hashes = (np.array(batch.column(k).to_pylist(), dtype=object) for k in (3, 4))
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            first = np.zeros(b - a, bool)
            if keys[a].as_py() != tenant:
                if tenant is not None:
                    yield tail()
                tenant, above, hashed, first[0] = keys[a].as_py(), None, False, True
            link, own = links[a:b], hashes[a:b]
            there, free = own != None, link == None  # noqa: E711
            before = np.concatenate([[above], own[:-1]])
            broken = there & ~free & (before != None) & (link != before)  # noqa: E711
            begun = hashed | (np.cumsum(there) - there > 0)
            rows = b - a
            columns = {
                "tenant_key": keys.slice(a, rows),
                "id": batch.column(1).slice(a, rows),
                "mismatch": batch.column(2).slice(a, rows),
                "no_hash": pa.array(~there),
                "broken": pa.array(broken.astype(bool)),
                "restart": pa.array(there & free & begun),
                "first": pa.array(first),
                "pending": pa.array(there & free & ~begun),
                "edge": pa.array(np.where(first & there, link, None), pa.string()),
                "part": pa.array(np.full(rows, part, np.int32)),
                "tail": pa.nulls(rows, pa.string()),
                "hashed": pa.nulls(rows, pa.bool_()),
            }
            yield pa.RecordBatch.from_arrays([columns[k] for k in names], names)
            above, hashed = own[-1], hashed or bool(there.any())
    if tenant is not None:
        yield tail()


TAILS = "tenant_key string, last string, started boolean"


def chain_findings(rows: DataFrame, tails: DataFrame | None = None, ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings: tenant_key, id, mismatch, broken, gap; tails: tenant_key, last, started) of rows (tenant_key, id, prev_hash, row_hash, expected)
    and the ``tails`` of what came before.

    The log is cut into ranges of (tenant, id), so a tenant with most of the rows is as many tasks as it needs. Within a range each row meets
    the one before it; between ranges only a tenant's last hash and whether it had any are exchanged.
    """
    there = F.col("row_hash").isNotNull()
    slim = rows.select("tenant_key", "id", (there & (F.col("expected") != F.col("row_hash"))).alias("mismatch"), "prev_hash", "row_hash")
    dealt = slim.repartitionByRange(*([ranges] if ranges else []), "tenant_key", "id").sortWithinPartitions("tenant_key", "id")
    checked = staged(dealt.mapInArrow(_checked, CHECKED), "checked")
    ends = checked.where("id IS NULL").select("tenant_key", "part", "tail", "hashed")
    if tails is not None:
        ends = ends.unionByName(tails.select("tenant_key", F.lit(-1).alias("part"), F.col("last").alias("tail"), F.col("started").alias("hashed")))
    ends = staged(ends, "ends")  # a row a tenant and range
    order = Window.partitionBy("tenant_key").orderBy("part")
    known = ends.select("tenant_key", "part", F.lag("tail").over(order).alias("above"), F.max("hashed").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("begun"))
    no = F.lit(False)
    flags = ["tenant_key", "id", "mismatch", "broken", (F.col("no_hash") | F.col("restart")).alias("gap")]
    inner = checked.where("id IS NOT NULL AND NOT first AND NOT pending").select(*flags)
    edges = checked.where("id IS NOT NULL AND (first OR pending)").join(known, ["tenant_key", "part"])
    edges = edges.withColumn("broken", F.col("broken") | F.coalesce(F.col("edge") != F.col("above"), no)).withColumn("restart", F.col("restart") | (F.col("pending") & F.coalesce("begun", no)))
    last = ends.groupBy("tenant_key").agg(F.max_by(F.struct("tail"), "part").alias("end"), F.max("hashed").alias("started"))
    return inner.unionByName(edges.select(*flags)), last.select("tenant_key", F.col("end.tail").alias("last"), F.coalesce("started", no).alias("started"))


def verify_chain(chained: DataFrame, ranges: int | None = None) -> DataFrame:
    """One report for each tenant: mismatches (a field changed), breaks (a link changed), gaps, ends and first bad ids."""
    key = F.coalesce(F.concat(F.lit("="), F.col("tenant_id").cast("string")), F.lit("")).alias("tenant_key")
    rows = chained.select(key, "id", "prev_hash", "row_hash", row_hash(F.col("prev_hash"), canonical_payload(chained)).alias("expected"))
    findings, _ = chain_findings(rows, ranges=ranges)
    n = lambda c: F.count(F.when(F.col(c), 1))
    report = findings.groupBy("tenant_key").agg(
        F.count("*").alias("rows"),
        n("mismatch").alias("mismatches"),
        n("broken").alias("breaks"),
        n("gap").alias("gaps"),
        F.min("id").alias("head_id"),
        F.max("id").alias("tail_id"),
        F.min(F.when(F.col("mismatch"), F.col("id"))).alias("first_mismatch_id"),
        F.min(F.when(F.col("broken"), F.col("id"))).alias("first_break_id"),
    )
    tenant = F.when(F.col("tenant_key") != "", F.expr("substring(tenant_key, 2)")).cast(chained.schema["tenant_id"].dataType).alias("tenant_id")
    return report.select(tenant, "*").drop("tenant_key").withColumn("verified", (F.col("mismatches") == 0) & (F.col("breaks") == 0))


def anchor_chain(chained: DataFrame) -> DataFrame:
    """Count, ends and last hash of each tenant's hashed rows."""
    return chained.where("row_hash IS NOT NULL").groupBy("tenant_id").agg(
        F.count("*").alias("rows"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.max_by("row_hash", "id").alias("tail_hash")
    )


MAX_DOCS, MAX_BYTES = 1000, 5 << 30


def quota_limits(tenants: DataFrame, quotas: DataFrame) -> DataFrame:
    """Limits of each tenant, else the defaults; 0 is unlimited."""
    return tenants.select("tenant_id").distinct().join(quotas, "tenant_id", "left").select(
        "tenant_id",
        F.coalesce(F.col("max_docs").cast("long"), F.lit(MAX_DOCS).cast("long")).alias("max_docs"),
        F.coalesce(F.col("max_bytes").cast("long"), F.lit(MAX_BYTES).cast("long")).alias("max_bytes"),
    )


def usage(counters: DataFrame, files: DataFrame, period: str) -> DataFrame:
    """Documents and bytes of a month by tenant: the counter, else the files created in the month."""
    counted = counters.where(F.col("period") == period).select("tenant_id", F.col("docs").alias("c_docs"), F.col("bytes").alias("c_bytes"))
    month = files.where(F.date_trunc("month", F.col("created_date").cast("timestamp")) == F.to_timestamp(F.lit(period + "-01")))
    created = month.groupBy("tenant_id").agg(F.count("*").alias("f_docs"), F.sum("size_bytes").alias("f_bytes"))
    both = counted.join(created, "tenant_id", "full")
    return both.select("tenant_id", F.coalesce("c_docs", "f_docs").alias("docs"), F.coalesce("c_bytes", "f_bytes").alias("bytes"))


def check_quota(used: DataFrame, limits: DataFrame) -> DataFrame:
    """ok, or which limit is reached; documents come before bytes."""
    over = lambda have, most: (F.col(most) > 0) & (F.coalesce(F.col(have), F.lit(0)) >= F.col(most))
    reason = F.when(over("docs", "max_docs"), "docs").when(over("bytes", "max_bytes"), "bytes").otherwise("ok")
    return limits.join(used, "tenant_id", "left").select("tenant_id", reason.alias("reason"))


def admit_uploads(uploads: DataFrame, limits: DataFrame) -> DataFrame:
    """Uploads (tenant_id, period, seq, bytes) with ``admitted``: a rejected one uses nothing, so each tenant-month is one stream in order."""

    def admit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, docs, size = None, 0, 0
        for batch in batches:
            out = []
            for t, p, b, most_docs, most_bytes in zip(batch.tenant_id, batch.period, batch.bytes, batch.max_docs, batch.max_bytes, strict=True):
                if (t, p) != key:
                    key, docs, size = (t, p), 0, 0
                ok = not (most_docs and docs >= most_docs) and not (most_bytes and size + b > most_bytes)
                docs, size = docs + ok, size + b * ok
                out.append(bool(ok))
            yield batch[["tenant_id", "period", "seq", "bytes"]].assign(admitted=out)

    rows = uploads.join(limits, "tenant_id").select("tenant_id", "period", "seq", "bytes", "max_docs", "max_bytes")
    ordered = rows.repartition("tenant_id", "period").sortWithinPartitions("tenant_id", "period", "seq")
    return ordered.mapInPandas(admit, "tenant_id long, period string, seq long, bytes long, admitted boolean")


SEQS_PER_PART = 65_536


def meter_walk(events: DataFrame) -> DataFrame:
    """(tenant_id, period, docs, bytes, least_docs, least_bytes): the sums of a tenant-month's events and their least prefix sums, 0 at most.

    Prefixes are taken within parts of ``SEQS_PER_PART`` numbers, then over the parts, so that a tenant with many events is many tasks.
    """
    part = F.floor(F.col("seq") / SEQS_PER_PART).alias("part")
    steps = events.select("tenant_id", "period", "seq", part, F.col("doc_delta").cast("long").alias("d"), (F.col("doc_delta") * F.col("bytes")).cast("long").alias("b"))
    key = ["tenant_id", "period"]
    so_far = Window.partitionBy(*key, "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    inside = steps.withColumns({"pd": F.sum("d").over(so_far), "pb": F.sum("b").over(so_far)})
    parts = inside.groupBy(*key, "part").agg(F.sum("d").alias("d"), F.sum("b").alias("b"), F.min("pd").alias("pd"), F.min("pb").alias("pb"))
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    placed = parts.select(*key, "d", "b", (base("d") + F.col("pd")).alias("pd"), (base("b") + F.col("pb")).alias("pb"))
    least = lambda c: F.least(F.lit(0), F.min(c)).cast("long")
    return placed.groupBy(*key).agg(F.sum("d").alias("docs"), F.sum("b").alias("bytes"), least("pd").alias("least_docs"), least("pb").alias("least_bytes"))


def meter_from(walk: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """Documents and bytes of each tenant-month after a walk that starts at what is ``used`` (nothing by default), never below 0: a running
    sum from u, clamped at 0, ends at u + S - min(0, u + its least prefix sum)."""
    key = ["tenant_id", "period"]
    if used is None:
        start = walk.withColumns({"u_docs": F.lit(0).cast("long"), "u_bytes": F.lit(0).cast("long")})
    else:
        start = walk.join(used.select(*key, F.col("docs").alias("u_docs"), F.col("bytes").alias("u_bytes")), key, "full").na.fill(0)
    end = lambda c: (F.col(f"u_{c}") + F.col(c) - F.least(F.lit(0), F.col(f"u_{c}") + F.col(f"least_{c}"))).alias(c)
    return start.select(*key, end("docs"), end("bytes"))


def meter(events: DataFrame) -> DataFrame:
    """Documents and bytes of each tenant-month after its events (+1 or -1, bytes), never below 0."""
    return meter_from(meter_walk(events))
