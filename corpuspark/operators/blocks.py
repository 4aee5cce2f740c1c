"""Scores of a batch of queries against all documents by products of matrices.

The queries are cut into blocks of bounded size; each block is broadcast as a matrix (vectors, or which of its tokens each query has). The
documents pass once in Arrow batches, a few hundred rows at a time: their matrix times that of the queries gives the scores, and each task
keeps the best ``k`` of each query. So no row for a query and a document exists, unless the caller wants all scores, and at most ``k``
rows of a query leave a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspark.functions.expr import tokens

BLOCK_QUERIES = 1024
BLOCK_BYTES = 16 << 20
ROWS = 1024
BATCH_BYTES = 4 << 20
DIGITS = 6


def rounded(x: np.ndarray) -> np.ndarray:
    """Half away from zero at ``DIGITS`` digits, as the column function does."""
    scale = 10.0**DIGITS
    return np.sign(x) * np.floor(np.abs(x) * scale + 0.5) / scale


class QueryBlock:
    """Some queries: ids, tenants, vectors as rows of one matrix, and which tokens of ``vocabulary`` each asks for."""

    def __init__(self, rows: list, schema):
        of = {f.name: [r[f.name] for r in rows] for f in schema}
        self.ids = pa.array(of["query_id"])
        self.tenants = np.array(of["tenant_id"], dtype=object) if "tenant_id" in of else None
        if "q_vec" in of:
            self.width = max((len(v) for v in of["q_vec"] if v), default=0)
            fit = [v is not None and len(v) == self.width and None not in v for v in of["q_vec"]]
            self.vectors = np.array([v if ok else [0.0] * self.width for v, ok in zip(of["q_vec"], fit, strict=True)], np.float64)
            self.norms = np.sqrt((self.vectors**2).sum(1))
        if "q_tokens" in of:
            asked = [dict.fromkeys(t or ()) for t in of["q_tokens"]]
            self.sizes = np.array([len(t) for t in asked], np.float64)
            number = {t: i for i, t in enumerate(dict.fromkeys(t for ts in asked for t in ts))}
            self.vocabulary = pa.array(list(number), pa.string())
            self.asks = np.zeros((len(number), len(rows)))
            for q, ts in enumerate(asked):
                self.asks[[number[t] for t in ts], q] = 1


def query_blocks(queries: DataFrame) -> Iterator[QueryBlock]:
    """The queries (query_id, and tenant_id, q_vec, query_text where they are needed) in blocks of at most ``BLOCK_QUERIES`` and about
    ``BLOCK_BYTES``: one block is on the driver at a time."""
    if "query_text" in queries.columns:
        queries = queries.withColumn("q_tokens", F.array_distinct(tokens(F.col("query_text")))).drop("query_text")
    rows, size = [], 0
    for r in queries.where("query_id IS NOT NULL").orderBy("query_id").toLocalIterator():
        rows.append(r)
        size += 8 * len(r["q_vec"] or ()) if "q_vec" in queries.columns else 0
        size += sum(40 + 8 * BLOCK_QUERIES for _ in r["q_tokens"] or ()) // 8 if "q_tokens" in queries.columns else 0
        if len(rows) == BLOCK_QUERIES or size > BLOCK_BYTES:
            yield QueryBlock(rows, queries.schema)
            rows, size = [], 0
    if rows:
        yield QueryBlock(rows, queries.schema)


def by_block(queries: DataFrame, score: Callable[[QueryBlock], DataFrame], empty: str) -> DataFrame:
    """The scores of all blocks; each reads the documents once."""
    parts = [score(b) for b in query_blocks(queries)]
    return reduce(DataFrame.unionByName, parts) if parts else queries.sparkSession.createDataFrame([], empty)


def over(docs: DataFrame, run, schema: str) -> DataFrame:
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return docs.mapInArrow(run, schema)


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def doc_vectors(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of ``width`` numbers, their norms); nulls and other lengths are rows of zeros."""
    lengths = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(lists.flatten().cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    starts, fit = np.cumsum(lengths) - lengths, np.flatnonzero(lengths == width)
    out = np.zeros((len(lengths), width))
    if width and len(fit):
        out[fit] = flat[starts[fit, None] + np.arange(width)]
    return out, np.sqrt((out**2).sum(1))


def token_counts(lists: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, token, occurrences) of the vocabulary's tokens in the rows' token lists, in order of row and token."""
    number = pc.index_in(lists.flatten(), value_set=vocabulary)
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
    known = number.is_valid().to_numpy(zero_copy_only=False)
    key = row[known] * max(1, len(vocabulary)) + number.drop_null().to_numpy(zero_copy_only=False)
    pairs, n = np.unique(key, return_counts=True)
    return pairs // max(1, len(vocabulary)), pairs % max(1, len(vocabulary)), n


def weighted(n_rows: int, row: np.ndarray, token: np.ndarray, weight: np.ndarray, asks: np.ndarray) -> np.ndarray:
    """The sparse matrix of the documents' token weights times that of the asked tokens."""
    used, place = np.unique(token, return_inverse=True)
    have = np.zeros((n_rows, len(used)))
    have[row, place] = weight
    return have @ asks[used]


def cosines(batch: pa.RecordBatch, block: QueryBlock) -> np.ndarray:
    """Rounded cosines of the rows' ``embedding`` with the queries; 0 where a norm is 0."""
    vectors, norms = doc_vectors(column(batch, "embedding"), block.width)
    both = norms[:, None] * block.norms
    return rounded(np.divide(vectors @ block.vectors.T, both, out=np.zeros_like(both), where=both != 0))


def overlaps(batch: pa.RecordBatch, block: QueryBlock) -> np.ndarray:
    """Rounded shares of the queries' tokens among the rows' distinct ``tokens``."""
    row, token, _ = token_counts(column(batch, "tokens"), block.vocabulary)
    found = weighted(batch.num_rows, row, token, np.ones(len(row)), block.asks)
    return rounded(found / np.maximum(block.sizes, 1))


class Best:
    """The best ``k`` of each query so far: greatest score, then least key."""

    def __init__(self, block: QueryBlock, k: int, key: str, score: str, carried: tuple[str, ...]):
        self.block, self.k, self.names = block, k, [key, *carried]
        self.key, self.score = key, score
        self.scores: list[np.ndarray] = [np.zeros(0)] * len(block.ids)
        self.rows: list = [None] * len(block.ids)

    def add(self, batch: pa.RecordBatch, scores: np.ndarray, may: np.ndarray) -> None:
        """``may`` (rows by queries): whether the query may see the row."""
        table = batch.select(self.names)
        for q in np.flatnonzero(may.any(0)).tolist():
            held = self.scores[q]
            least = held[-1] if len(held) == self.k else -np.inf
            at = np.flatnonzero(may[:, q] & (scores[:, q] >= least))
            if len(at) > self.k:  # all that tie with the k-th stay for the order of keys
                some = scores[at, q]
                at = at[some >= np.partition(some, len(some) - self.k)[len(some) - self.k]]
            if len(at):
                new = pa.Table.from_batches([table.take(pa.array(at))])
                rows = new if self.rows[q] is None else pa.concat_tables([self.rows[q], new])
                together = np.concatenate([held, scores[at, q]])
                order = pc.sort_indices(rows.append_column("_s", pa.array(together)), sort_keys=[("_s", "descending"), (self.key, "ascending")])[: self.k]
                self.rows[q], self.scores[q] = rows.take(order).combine_chunks(), together[order.to_numpy()]

    def batches(self) -> Iterator[pa.RecordBatch]:
        for q, rows in enumerate(self.rows):
            if rows is not None:
                ids = self.block.ids.take(pa.array([q] * rows.num_rows))
                columns = [ids, *(c.combine_chunks() for c in rows.columns), pa.array(self.scores[q])]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", *self.names, self.score])


def readable(batch: pa.RecordBatch, block: QueryBlock) -> np.ndarray:
    """Rows by queries: whether the query is among the row's ``readers`` (query_id, clearance) with a clearance that reaches the row's
    ``sensitivity``."""
    readers = column(batch, "readers")
    flat = readers.flatten()
    row = np.repeat(np.arange(len(readers)), pc.list_value_length(readers).fill_null(0).to_numpy(zero_copy_only=False))
    level = column(batch, "sensitivity").take(pa.array(row))
    ok = pc.fill_null(pc.less_equal(level, flat.field("clearance").cast(level.type)), False)
    query = pc.index_in(flat.field("query_id"), value_set=block.ids)
    some = pc.and_(ok, query.is_valid()).to_numpy(zero_copy_only=False)
    may = np.zeros((len(readers), len(block.ids)), bool)
    may[row[some], query.filter(pa.array(some)).to_numpy(zero_copy_only=False)] = True
    return may


def same_tenant(batch: pa.RecordBatch, block: QueryBlock) -> np.ndarray:
    return np.array(column(batch, "tenant_id").to_pylist(), dtype=object)[:, None] == block.tenants


def best_of(batches: Iterable[pa.RecordBatch], block: QueryBlock, k: int, key: str, score: str, carried: tuple[str, ...], scores, may) -> Iterator[pa.RecordBatch]:
    best = Best(block, k, key, score, carried)
    for batch in slices(batches):
        allowed = may(batch, block)
        if allowed.any():
            best.add(batch, scores(batch, block), allowed)
    yield from best.batches()
