"""Best-fit packing by best-two-fit.

Every text is tokenised once, in place, to pieces of at most ``capacity`` ids. Which lengths share a sequence is planned on
the histogram of lengths (at most ``capacity`` rows, whatever the corpus): fill greedily from the longest, then replace the
bin's smallest piece by two others that fit its enlarged gap more tightly, and repeat the pattern as often as the counts
allow. Pieces then take the planned places by their rank among pieces of their length; ranks come from salted groups and
prefix sums, so that a length which a third of all pieces share is no single task.

Defined results: ids are the library's own, so the string of an added token in a text is that token's id; null text counts as
empty and yields the end id alone; repeated rows are packed each; very long texts
become full sequences plus one shorter first piece; an empty table gives no rows; columns other than the named ones are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuspark.llm.bpe import CACHED_PIECES, SAFE, PieceTable
from corpuspark.llm.common import kind_of, map_texts, stored, table
from corpuspark.llm.textscan import row_slices

CAPACITY = 1024
END_ID = 2
ROWS_PER_SALT = 20_000
RUN = 200
PIECES = "piece int, start long, length long, ids_crc32 long"
SLOTS = "length long, slots array<struct<first:long,sequence:long,offset:long>>"


class Tokens:
    """Ids of whole texts as the tokenizer gives them, by way of a table of pieces; a text that holds the string of an added token,
    which the library finds before any piece, goes to the library whole."""

    def __init__(self, path: str, size: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)  # byte-level tokens are written with one character for a byte
        self.table = PieceTable(self._ids_of_pieces, size)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces that begin with a space and no other white space are encoded in runs and cut apart by their bytes: the pattern has a
        boundary before each, so a run has the ids of its pieces one after the other."""
        plain = [i for i, t in enumerate(pieces) if len(t) > 1 and t[0] == 32 and SAFE[t[1]]]
        rest = set(range(len(pieces))).difference(plain)
        begin, sizes = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        ids_of_runs, used = [], 0
        runs = [plain[a : a + RUN] for a in range(0, len(plain), RUN)]
        for run, ids in zip(runs, self._encode([b"".join(map(pieces.__getitem__, r)).decode() for r in runs]), strict=True):
            ends, at = np.cumsum([len(pieces[i]) for i in run]), np.cumsum(self.bytes_of[ids])
            cuts = np.searchsorted(at, ends)
            if len(at) and cuts[-1] == len(at) - 1 and (at[cuts] == ends).all():
                n = np.diff(cuts, prepend=-1)
                sizes[run], begin[run] = n, used + cuts + 1 - n
                ids_of_runs.append(ids)
                used += len(ids)
            else:
                rest.update(run)
        rest = sorted(rest)
        found = self._encode([pieces[i].decode() for i in rest])
        n = np.array([len(x) for x in found], np.int64)
        sizes[rest], begin[rest] = n, used + np.cumsum(n) - n
        return np.concatenate([np.zeros(0, np.uint32), *ids_of_runs, *found]), begin, sizes

    def ids_of(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        ids, at = self.table.ids_of(data, offsets)
        found = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        raw = data.tobytes()
        if any(x in raw for x in self.added):
            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                if any(x in raw[a:b] for x in self.added):
                    found[i] = np.array(self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids, np.uint32)
        return found


@lru_cache(maxsize=2)
def _tokens(path: str, size: int = CACHED_PIECES) -> Tokens:
    """One for each Python worker."""
    return Tokens(path, size)


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the pieces of a document of ``n`` ids; only the first may be shorter than ``capacity``."""
    first = n % capacity or min(n, capacity)
    yield 0, first
    for a in range(first, n, capacity):
        yield a, a + capacity


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, cached: int = CACHED_PIECES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document. No shuffle; ids don't leave the task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(path, cached)
        for batch in batches:
            for part, data, offsets in row_slices(batch):
                rows = []
                for row, ids in enumerate(tokens.ids_of(data, offsets)):
                    whole = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
                    rows += [(row, k, a, b - a, zlib.crc32(whole[4 * a : 4 * b])) for k, (a, b) in enumerate(cut(len(whole) // 4, capacity))]
                row, *columns = zip(*rows, strict=True)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), *columns], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_texts(docs.select("doc_id", "text"), run, f"doc_id {kind_of(docs, 'doc_id')}, {PIECES}")


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many such sequences) that together use up ``counts`` of pieces by length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan = []
    while (present := np.flatnonzero(left)).size:
        use, bin_, gap = left.copy(), [], capacity
        while (fits := np.flatnonzero(use[: gap + 1])).size:
            bin_.append(int(fits[-1]))
            use[bin_[-1]] -= 1
            gap -= bin_[-1]
        if gap and len(bin_) > 1:
            smallest = bin_[-1]
            use[smallest] += 1
            if pair := _best_pair(use, gap + smallest):
                if sum(pair) > smallest:
                    bin_[-1:] = pair
        wanted = {n: bin_.count(n) for n in bin_}
        times = int(min(left[n] // k for n, k in wanted.items()))
        for n, k in wanted.items():
            left[n] -= k * times
        plan.append((bin_, times))
    return plan


def _best_pair(use: np.ndarray, room: int) -> list[int] | None:
    """Two available lengths, the longer first, with the largest sum that fits ``room``."""
    lengths = np.flatnonzero(use[: room + 1])
    best, i, j = None, 0, len(lengths) - 1
    while i <= j:
        x, y = int(lengths[j]), int(lengths[i])
        if x + y > room or (i == j and use[x] < 2):
            j -= 1
            continue
        if best is None or x + y > sum(best):
            best = [x, y]
        i += 1
    return best


def slots_of(plan: list[tuple[list[int], int]]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """For each length, where its pieces go by rank: (first rank, first sequence, offset) of each run of equal slots."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for bin_, times in plan:
        offset = 0
        for n in bin_:
            found.setdefault(n, []).append((ranks.get(n, 0), sequence, offset))
            ranks[n] = ranks.get(n, 0) + times
            offset += n
        sequence += times
    return list(found.items())


def place(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces that have a length. ``cut_pieces`` is read three times: give a stored table."""
    spark = cut_pieces.sparkSession
    histogram = {r.length: r.n for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    salts = max(8, sum(histogram.values()) // ROWS_PER_SALT)
    salted = cut_pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    by_salt = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        salted.groupBy("length", "salt")
        .agg(F.count("*").alias("n"))
        .select("length", "salt", F.coalesce(F.sum("n").over(by_salt), F.lit(0)).alias("base"))
    )
    place_of = spark.createDataFrame(slots_of(best_two_fit(histogram, capacity)), SLOTS)
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    return (
        salted.withColumn("nth", F.row_number().over(within) - 1)
        .join(bases, ["length", "salt"])
        .withColumn("rank", F.col("base") + F.col("nth"))
        .join(F.broadcast(place_of), "length")  # at most `capacity` rows
        .withColumn("slot", F.expr("element_at(filter(slots, s -> s.first <= rank), -1)"))
        .select(
            "doc_id",
            "piece",
            "start",
            "length",
            "ids_crc32",
            (F.col("slot.sequence") + F.col("rank") - F.col("slot.first")).alias("sequence_id"),
            F.col("slot.offset").alias("offset"),
        )
    )


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, cached: int = CACHED_PIECES) -> DataFrame:
    """Tokenise, cut and place every document; ``cached`` bounds the memory of each worker's table of short pieces."""
    return place(stored(pieces(docs, path, capacity, end_id, cached), "pieces"), capacity)


def op10_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op10_packing": op10_packing}
ORACLE_SQL: dict = {}
