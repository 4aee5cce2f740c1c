"""Embedding whitening by shifted CholeskyQR.

A first pass counts the vectors and sums their entries in whole numbers, so that rows are centred exactly. Gram passes follow: each
task multiplies its own centred rows, already orthogonalised by triangular solves with the factors so far, and the small d x d matrices are
summed in two levels. The Cholesky factor of each Gram matrix (the first one shifted, so that it exists whatever the condition) joins
the factors; three passes make the rows orthonormal to double precision. The singular values and right vectors of the
composed R are those of the centred rows: its whitening components. No row is moved or kept; what the driver and the tasks hold is d x d.

Defined results: rows whose vector is null or empty, or holds null or non-finite entries, go; so do rows with an entry of 2**40 or more in
size, which no 64-bit arithmetic of whole numbers would hold, and vectors of another length than the most rows have (ties: the
longest). Null ids and repeated ids stay, each row for itself. With fewer than eight dimensions there are as many components. A component
without variance has a null ``whitened``; ``explained`` and ``identity_error`` are null where nothing varies. Equal eigenvalues have some
orthonormal vectors of their space; of a vector's two signs that with the positive largest entry counts. ``deviation`` is null where it passes
64 bits. An empty table gives no rows; columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuspark.llm.common import kind_of, map_texts, stored, table

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
LARGEST = float(1 << 50)  # of a scaled entry
BUCKETS = 64
BLOCK_BYTES = 4 << 20
MOST_PASSES = 8
SETTLED = 1e-12
EPS = np.finfo(np.float64).eps


def vectors(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the rows with a valid vector of that width, their whole-numbered entries)."""
    lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls are nan
    starts = np.cumsum(lengths) - lengths
    rows = np.flatnonzero(lengths == width)
    scaled = entries[starts[rows, None] + np.arange(width)] * SCALE
    fit = (np.abs(scaled) < LARGEST).all(1)  # false for nan
    return rows[fit], np.floor(scaled[fit]).astype(np.int64) + OFFSET


def _widths(column: pa.Array) -> list[int]:
    found = pc.list_value_length(column).fill_null(0).unique().to_pylist()
    return [w for w in found if w]


class Centre:
    """Number and sums of the fit list; takes the mean off without rounding before the last step."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n x - S)**2, exact; null from 2**63 on."""
        d = x - self.whole
        if not d.size or float(self.n) ** 2 * float(np.abs(d).max() + 1) ** 2 * x.shape[1] < 2.0**62:
            return pa.array(((self.n * d - self.rest) ** 2).sum(1), pa.int64())
        exact = [sum((self.n * a - b) ** 2 for a, b in zip(row, self.rest.tolist(), strict=True)) for row in d.tolist()]
        return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


PARTS = "key long, block int, bucket int, sums binary"


def _parts(key: int, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The matrix by blocks of rows, marked for the first level of summing."""
    rows = max(1, BLOCK_BYTES // max(1, values[0].nbytes))
    bucket = TaskContext.get().partitionId() % BUCKETS
    for k, a in enumerate(range(0, len(values), rows)):
        yield pa.RecordBatch.from_pylist([{"key": key, "block": k, "bucket": bucket, "sums": values[a : a + rows].tobytes()}], _SCHEMA)


_SCHEMA = pa.schema([("key", pa.int64()), ("block", pa.int32()), ("bucket", pa.int32()), ("sums", pa.binary())])


def _summed(parts: DataFrame, kind: type) -> DataFrame:
    """One row for each key and block: the sum over all tasks, at first by buckets of tasks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist())
        for (key, block, bucket), group in groupby(rows, key=lambda r: (r["key"], r["block"], r["bucket"])):
            total = None
            for r in group:
                one = np.frombuffer(r["sums"], kind)
                total = one.copy() if total is None else total + one
            yield pa.RecordBatch.from_pylist([{"key": key, "block": block, "bucket": bucket, "sums": total.tobytes()}], _SCHEMA)

    at = ["key", "block", "bucket"]
    once = parts.repartition(*at).sortWithinPartitions(*at).mapInArrow(run, PARTS)
    return once.withColumn("bucket", F.lit(0)).repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(run, PARTS)


def _matrix(summed: DataFrame, width: int) -> np.ndarray:
    """The one matrix of that many columns."""
    rows = summed.orderBy("block").collect()
    return np.concatenate([np.frombuffer(r["sums"], np.float64) for r in rows]).reshape(-1, width) if rows else np.zeros((width, width))


def centre(rows: DataFrame) -> Centre | None:
    """Width, number and sums of the fit list of ``rows`` (embedding); None where it is empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for width in _widths(batch.column(0)):
                _, x = vectors(batch.column(0), width)
                sums = np.stack([np.full(width, len(x)), (x & 0xFFFFF).sum(0), (x >> 20).sum(0)]).astype(np.int64)
                held[width] = held[width] + sums if width in held else sums
        for width, sums in held.items():
            yield from _parts(width, np.ascontiguousarray(sums.T))

    found = stored(_summed(map_texts(rows, run, PARTS), np.int64), "sums")
    first = found.where("block = 0").select("key", F.conv(F.concat(*(F.hex(F.substring("sums", k, 1)) for k in range(8, 0, -1))), 16, 10).cast("long").alias("n"))
    widest = first.where("n > 0").orderBy(F.desc("n"), F.desc("key")).first()
    if widest is None:
        return None
    parts = found.where(F.col("key") == widest["key"]).orderBy("block").collect()
    sums = np.concatenate([np.frombuffer(r["sums"], np.int64) for r in parts]).reshape(-1, 3).tolist()
    return Centre(widest["n"], [low + (high << 20) for _, low, high in sums])


def solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """rows times the inverse of the upper triangular ``factor``, by forward substitution along the columns of all rows at once."""
    out = np.empty_like(rows)
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def gram(rows: DataFrame, at: Centre, change: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum over the fit list of the products of the changed centred rows with themselves."""
    d = len(at.sums)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            _, x = vectors(batch.column(0), d)
            y = change(at.centred(x))
            total += y.T @ y
        yield from _parts(0, total)

    return _matrix(_summed(map_texts(rows, run, PARTS), np.float64), width)


def components(rows: DataFrame, at: Centre, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns, shares of the trace) of the covariance, the greatest ``most``."""
    d, factors, composed = len(at.sums), [], np.eye(len(at.sums))

    def orthogonalised(y: np.ndarray) -> np.ndarray:
        for factor in factors:
            y = solved(y, factor)
        return y

    for _ in range(MOST_PASSES):
        g = gram(rows, at, orthogonalised, d)
        values, turned = np.linalg.eigh(g)
        if not values[-1] > 0:  # nothing varies
            break
        # Rows whose Gram matrix is the identity are orthonormal. Directions without variance never get there.
        root = np.sqrt(np.maximum(values, 0))[:, None] * turned.T @ composed
        spread = np.linalg.svd(root, compute_uv=False)
        rank = int((spread > 4 * d * EPS * spread[0]).sum())
        settled = bool(factors) and int((np.abs(values - 1) <= SETTLED * d).sum()) >= rank
        if settled:  # what is left of the Gram matrix is the last factor, by its root, as it may be singular
            composed = root
            break
        shift = 0.0 if factors and values[0] > 1e-2 else 11 * (at.n * d + d * (d + 1)) * EPS / 2 * values[-1]
        factors.append(np.linalg.cholesky(g + min(shift, values[-1]) * np.eye(d)).T)
        composed = factors[-1] @ composed
    _, sigma, right = np.linalg.svd(composed) if factors else (None, np.zeros(d), np.eye(d))
    sigma = np.where(sigma > 4 * d * EPS * sigma[0], sigma, 0.0)
    right = right * np.where(right[np.arange(d), np.abs(right).argmax(1)] < 0, -1.0, 1.0)[:, None]
    total = float((sigma**2).sum())
    k = min(most, d)
    share = sigma[:k] ** 2 / total if total else np.full(k, np.nan)
    return sigma[:k] ** 2 / at.n, right[:k].T.copy(), share


def whitened(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each remaining row and component."""
    schema = f"vec_id {kind_of(embeddings, 'vec_id')}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = embeddings.select("embedding")
    at = centre(fit)
    if at is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    values, directions, share = components(fit, at, most)
    k, some = len(values), values > 0
    scaled = directions / np.sqrt(np.where(some, values, np.nan))
    error = None
    if some.any():
        spread = gram(fit, at, lambda y: y @ scaled[:, some], int(some.sum())) / at.n
        error = float(np.abs(spread - np.eye(len(spread))).max())
    explained = pa.array([None if np.isnan(v) else float(v) for v in share], pa.float64())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = vectors(batch.column(1), len(at.sums))
            if not len(rows):
                continue
            turned = (at.centred(x) @ scaled).ravel()
            each, of = np.repeat(np.arange(len(rows)), k), np.tile(np.arange(k), len(rows))
            columns = [
                batch.column(0).take(pa.array(rows[each])),
                pa.array(of + 1, pa.int32()),
                pa.array(np.full(len(of), at.n), pa.int64()),
                at.deviations(x).take(pa.array(each)),
                pa.array(turned, mask=np.isnan(turned)),
                explained.take(pa.array(of)),
                pa.array([error] * len(of), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_texts(embeddings.select("vec_id", "embedding"), run, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_whitening": op11_whitening}
#: SQL has no eigenvectors; tests compare with the covariance in exact fractions and with its definition.
ORACLE_SQL: dict = {}
