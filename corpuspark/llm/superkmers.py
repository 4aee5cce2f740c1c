"""Substring dedup by super-k-mers.

A window is ``WINDOW`` consecutive words of a document; its minimiser is the least hash of its runs of ``MINIMISER`` words. Consecutive windows with
one minimiser travel as one packed string of words (a super-k-mer) to the bucket of that hash, where equal windows meet whatever lies around
them: their words are numbered exactly, windows are sorted, and each run of equal ones gets the least document it starts in. Equal
super-k-mers of a slice are one with their least and greatest document, so that copies collapse before the shuffle. A task sends its
super-k-mers of a part (a range of buckets, sized to fit a task) as one compressed parcel.

Buckets that many different super-k-mers share (a passage with changing words around it) are known in advance by a count of minimisers
in 65,536 cells, or else by a part's bytes when they come; the windows of these are grouped by their own words, with partial aggregates, so no
task holds such a bucket. What comes back are the super-k-mers with a window that a smaller document has; only their occurrences, by a bitmap of
bounded size, are joined with them, and only the documents that lose words are shuffled.

Defined results: words are unchanged runs of what is no ASCII white space; null texts have none; texts of less than 13 words lose none;
windows that repeat within one document only stay; a document's rows with equal ids and different texts are judged each by its own text,
and don't take words from each other; repeated rows have equal results; rows without an id come after all ids, lose what any document with an id
has and take nothing from each other; ids are whole numbers; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuspark.llm.common import IdFilter, afresh, map_texts, stored, table
from corpuspark.llm.textscan import BASE, lanes, mix, row_slices, span_hashes, spans, windows_of_eight

WINDOW = 13
MINIMISER = 3
MOST_WINDOWS = 32  # of a super-k-mer: longer runs are cut
CELLS = 1 << 16
HOT = 8  # times the mean of a cell
TASK_BYTES = 24 << 20  # of super-k-mers that a task holds before it sends them
PART_BYTES, MOST_OF_PART = 12 << 20, 48 << 20
LAST = (1 << 63) - 1
LARGEST = np.uint64((1 << 64) - 1)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _rolling(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, factors): (sums[b] - sums[a]) * factors[a] is a hash of the words a to b - 1 from their hashes, the same wherever they lie."""
    if len(hashes) + 1 > len(_POWERS[0]):
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            factors = np.full(1 << int(len(hashes) + 1).bit_length(), base, np.uint64)
            factors[0] = 1
            _POWERS[k] = np.cumprod(factors)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _POWERS[0][: len(hashes)], out=sums[1:])
    return sums, _POWERS[1]


class Slice:
    """The words of some texts: hash of each, its text, and all words one after the other, a space behind each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        text = np.full(len(data) + n + 1, 32, np.uint8)  # a space before each text and one behind the last
        text[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = data
        space = _SPACE[text]
        starts, ends = spans(~space)
        self.first = np.searchsorted(starts, offsets + np.arange(n + 1))  # of each text
        self.doc = np.repeat(np.arange(n), np.diff(self.first))
        self.at = np.concatenate([[0], np.cumsum(ends - starts + 1)])
        keep = ~space
        keep[1:] |= ~space[:-1]
        text[space] = 32
        self.spaced = text[keep]
        self.hashes = span_hashes(text, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        self.rolling = _rolling(self.hashes)

    def minimisers(self) -> tuple[np.ndarray, np.ndarray]:
        """(first words of all windows, their minimisers)."""
        h, n = self.hashes, len(self.hashes) - WINDOW + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        least = np.zeros(len(h) - MINIMISER + 1, np.uint64)
        for j in range(MINIMISER):
            least = least * np.uint64(BASE) + h[j : j + len(least)]
        least, width, want = mix(least), 1, WINDOW - MINIMISER + 1
        while width < want:
            step = min(width, want - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        at = np.flatnonzero(self.doc[:n] == self.doc[WINDOW - 1 :])
        return at, least[at]

    def superkmers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first words, numbers of windows, minimisers)."""
        at, least = self.minimisers()
        if not len(at):
            return at, at, least
        new = np.ones(len(at), bool)
        new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
        run = np.flatnonzero(new)
        within = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
        first = np.flatnonzero(within % MOST_WINDOWS == 0)
        return at[first], np.diff(np.append(first, len(at))), least[first]

    def names(self, first: np.ndarray, windows: np.ndarray) -> np.ndarray:
        return _names(self.rolling, first, windows)


def _cell(minimisers: np.ndarray) -> np.ndarray:
    return (mix(minimisers + np.uint64(1)) >> np.uint64(48)).astype(np.int64)


def _numbered(docs: DataFrame) -> DataFrame:
    """(doc, key, text): ids with nulls last, and a hash of the text that tells rows of one id apart."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("key"), "text").where(F.col("text").isNotNull())


def hot_cells(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(for each cell of minimisers whether it has more than ``HOT`` times the mean of super-k-mers, bytes of all of them)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = np.zeros(CELLS, np.int64), 0
        for batch in batches:
            for _, data, offsets in row_slices(batch):
                words = Slice(data, offsets)
                first, windows, least = words.superkmers()
                total += np.bincount(_cell(least), minlength=CELLS)
                size += int((words.at[first + windows + WINDOW - 1] - words.at[first]).sum())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, CELLS)), pa.array(np.append(total[some], size))], ["cell", "n"])

    sizes = map_texts(docs.select("text").where(F.col("text").isNotNull()), run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    totals = np.zeros(CELLS + 1, np.int64)
    for cell, n in sizes.collect():  # one row a cell
        totals[cell] = n
    return totals[:CELLS] > HOT * max(1.0, totals[:CELLS].mean()), int(totals[CELLS])


def _bytes_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of bytes, one after the other."""
    edges = np.cumsum(lengths)
    return data[np.arange(edges[-1] if len(edges) else 0) + np.repeat(starts - edges + lengths, lengths)]


def _texts(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    edges = np.concatenate([[0], np.cumsum(lengths)])
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(_bytes_of(data, starts, lengths))])


def _parcel(lengths: np.ndarray, low: np.ndarray, high: np.ndarray, words: bytes) -> bytes:
    """Super-k-mers of one part as one compressed string: numbers by their bytes, which are mostly alike, then the words."""
    numbers = np.stack([lengths, low, high - low]).astype("<i8").view(np.uint8).reshape(3, -1, 8).transpose(0, 2, 1)
    return zstandard.compress(len(lengths).to_bytes(8, "little") + numbers.tobytes() + words, 1)


def _opened(parcel: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, low, high, words) of a parcel."""
    raw = zstandard.decompress(parcel)
    n = int.from_bytes(raw[:8], "little")
    numbers = np.frombuffer(raw, np.uint8, 24 * n, 8).reshape(3, 8, n).transpose(0, 2, 1)
    lengths, low, more = np.ascontiguousarray(numbers).view("<i8").reshape(3, n)
    return lengths, low, low + more, np.frombuffer(raw, np.uint8, offset=8 + 24 * n)


SHIPPED = "part long, parcel binary, bucket long, name long, low long, high long, words string"


def packed(docs: DataFrame, hot: np.ndarray, parts: int) -> DataFrame:
    """The different super-k-mers of each slice with their least and greatest document: those of ordinary buckets as parcels of a task by
    ``part``, those of hot buckets in rows of their own."""
    names = [c.split()[0] for c in SHIPPED.split(", ")]

    def rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
        kinds = {"parcel": pa.binary(), "words": pa.string()}
        return pa.RecordBatch.from_arrays([columns.get(k, pa.nulls(n, kinds.get(k, pa.int64()))) for k in names], names)

    def parcels(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        part, lengths, low, high, starts, data = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(part, kind="stable")
        part, lengths, low, high, starts = part[order], lengths[order], low[order], high[order], starts[order]
        raw, spans_ = data.tobytes(), list(zip(starts.tolist(), (starts + lengths).tolist(), strict=True))
        edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]).tolist()
        made = [_parcel(lengths[a:b], low[a:b], high[a:b], b"".join([raw[i:j] for i, j in spans_[a:b]])) for a, b in zip(edges, edges[1:], strict=False)]
        yield rows(len(made), part=pa.array(part[np.array(edges[:-1])]), parcel=pa.array(made, pa.binary()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, behind = [], 0, 0
        for batch in batches:
            for texts, data, offsets in row_slices(batch):
                words = Slice(data, offsets)
                first, windows, least = words.superkmers()
                if not len(first):
                    continue
                name = words.names(first, windows)
                doc = texts.column(0).to_numpy(zero_copy_only=False)[words.doc[first]]
                order, edge = _groups(name, least)
                low, high, one = np.minimum.reduceat(doc[order], edge), np.maximum.reduceat(doc[order], edge), order[edge]
                starts, lengths = words.at[first[one]], words.at[first[one] + windows[one] + WINDOW - 1] - 1 - words.at[first[one]]
                aside = hot[_cell(least[one])]
                if aside.any():
                    key = one[aside]
                    columns = {"bucket": least[key].view(np.int64), "name": name[key].view(np.int64), "low": low[aside], "high": high[aside]}
                    yield rows(len(key), words=_texts(words.spaced, starts[aside], lengths[aside]), **{k: pa.array(c) for k, c in columns.items()})
                stay = ~aside
                part = (_cell(least[one[stay]]) << 22 | (least[one[stay]] & np.uint64(0x3FFFFF)).astype(np.int64)) * parts >> 38  # ranges of cells, then of minimisers
                held.append((part, lengths[stay], low[stay], high[stay], starts[stay] + behind, words.spaced))
                behind += len(words.spaced)
                size += int(lengths[stay].sum())
                if size > TASK_BYTES:
                    yield from parcels(held)
                    held, size, behind = [], 0, 0
        if size:
            yield from parcels(held)

    return map_texts(docs.select("doc", "text"), run, SHIPPED)


class Bucket:
    """Super-k-mers with their words, each hashed, and the minimisers and names that follow from these."""

    def __init__(self, lengths: np.ndarray, data: np.ndarray):
        self.data, self.starts, self.lengths = data, np.cumsum(lengths) - lengths, lengths
        begin = np.zeros(len(data) + 1, bool)
        begin[1:] = data == 32
        begin[self.starts] = True
        self.begins = np.flatnonzero(begin[: len(data)])
        self.first = np.searchsorted(self.begins, self.starts)
        words = np.diff(np.append(self.first, len(self.begins)))
        self.windows = words - WINDOW + 1
        self.stops = np.append(self.begins[1:], len(data)) - 1  # a space lies between words only
        self.stops[self.first + words - 1] += 1
        hashes = span_hashes(data, self.begins, self.stops)
        self.bucket = np.full(len(lengths), LARGEST)
        for k in range(WINDOW - MINIMISER + 1):
            one = np.zeros(len(lengths), np.uint64)
            for j in range(MINIMISER):
                one = one * np.uint64(BASE) + hashes[self.first + k + j]
            self.bucket = np.minimum(self.bucket, mix(one))
        self.rolling = _rolling(hashes)
        self.name = _names(self.rolling, self.first, self.windows)

    def least(self, some: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of windows of each of ``some``, for each window the least document of any of these that has it)."""
        counts = self.windows[some]
        start = np.repeat(self.first[some] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        sums, factors = self.rolling
        h = (sums[start + WINDOW] - sums[start]) * factors[start]
        order = np.argsort(h)
        if not self._equal_where(h, start, order):
            h = self._numbers(start)
            order = np.argsort(h)
        new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
        group = np.flatnonzero(new)
        least = np.minimum.reduceat(np.repeat(low, counts)[order], group)
        out = np.empty(len(order), np.int64)
        out[order] = np.repeat(least, np.diff(np.append(group, len(order))))
        return counts, out

    def _equal_where(self, h: np.ndarray, start: np.ndarray, order: np.ndarray) -> bool:
        """Whether neighbours in order with one hash have the same bytes."""
        same = np.flatnonzero(h[order][1:] == h[order][:-1])
        a, b = start[order[same]], start[order[same + 1]]
        at, to = self.begins[a], self.begins[b]
        lengths = self.stops[a + WINDOW - 1] - at
        if (lengths != self.stops[b + WINDOW - 1] - to).any():
            return False
        eights = windows_of_eight(self.data)
        for k in range(int(lengths.max(initial=0) + 7) // 8):
            live = lengths > 8 * k
            at, to, lengths = at[live], to[live], lengths[live]
            if (lanes(eights, at, lengths, k) != lanes(eights, to, lengths, k)).any():
                return False
        return True

    def _numbers(self, start: np.ndarray) -> np.ndarray:
        """Equal numbers for windows of equal bytes only."""
        raw = self.data.tobytes()
        texts = [raw[a:b] for a, b in zip(self.begins[start].tolist(), self.stops[start + WINDOW - 1].tolist(), strict=True)]
        return np.unique(np.array(texts, object), return_inverse=True)[1]


def _names(rolling: tuple[np.ndarray, np.ndarray], first: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """A hash of each super-k-mer's words, in their order."""
    sums, factors = rolling
    return mix((sums[first + windows + WINDOW - 1] - sums[first]) * factors[first] + windows.astype(np.uint64))


def _groups(key: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order in which equal pairs of numbers lie together, where each run begins). Two different pairs may, rarely, split each other's
    runs; a super-k-mer then is two rows with the same windows, which changes no result."""
    order = np.argsort(key ^ other * np.uint64(BASE), kind="stable")
    a, b = key[order], other[order]
    edge = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return order, edge


FOUND = "bucket long, name long, least array<long>, words string, low long, high long"
_FOUND = ["bucket", "name", "least", "words", "low", "high"]


def in_buckets(rows: DataFrame) -> DataFrame:
    """Super-k-mers with a window that a document before their last one has, with the least document of each window; those of hot buckets,
    which are dealt out by name, and of parts that are too large for a task come back with their words instead."""

    def judged(lengths: np.ndarray, low: np.ndarray, high: np.ndarray, data: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = Bucket(lengths, data)
        order, edge = _groups(found.name, found.bucket)
        low, high, one = np.minimum.reduceat(low[order], edge), np.maximum.reduceat(high[order], edge), order[edge]
        counts, least = found.least(one, low)
        at = np.cumsum(counts) - counts
        hit = np.flatnonzero(np.minimum.reduceat(least, at) < high)
        if len(hit):
            n = counts[hit]
            edges = np.concatenate([[0], np.cumsum(n)])
            flat = least[np.arange(edges[-1]) + np.repeat(at[hit] - edges[:-1], n)]
            lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat))
            none, key = pa.nulls(len(hit), pa.int64()), one[hit]
            yield pa.RecordBatch.from_arrays([pa.array(found.bucket[key].view(np.int64)), pa.array(found.name[key].view(np.int64)), lists, pa.nulls(len(hit), pa.string()), none, none], _FOUND)

    def passed_on(lengths: np.ndarray, low: np.ndarray, high: np.ndarray, data: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = Bucket(lengths, data)
        columns = [pa.array(found.bucket.view(np.int64)), pa.array(found.name.view(np.int64)), pa.nulls(len(lengths), pa.list_(pa.int64())), _texts(data, found.starts, lengths), pa.array(low), pa.array(high)]
        yield pa.RecordBatch.from_arrays(columns, _FOUND)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def settle() -> Iterator[pa.RecordBatch]:
            if held:
                yield from judged(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held.clear()

        for batch in batches:
            rows = batch.filter(pc.is_null(batch.column(0)))
            if rows.num_rows:
                get = {k: rows.column(rows.schema.get_field_index(k)) for k in _FOUND if k != "least"}
                yield pa.RecordBatch.from_arrays([get["bucket"], get["name"], pa.nulls(rows.num_rows, pa.list_(pa.int64())), get["words"].cast(pa.string()), get["low"], get["high"]], _FOUND)
            shipped = batch.filter(pc.is_valid(batch.column(0)))
            for k, part in enumerate(shipped.column(0).to_pylist()):
                if part != now:
                    yield from settle()
                    now, size = part, 0
                opened = _opened(shipped.column(1)[k].as_py())
                size += len(opened[3])
                if size <= MOST_OF_PART:
                    held.append(opened)
                    continue
                for parcel in (*held, opened):
                    yield from passed_on(*parcel)
                held.clear()
        yield from settle()

    dealt = rows.repartition(F.coalesce("part", "name")).sortWithinPartitions("part")
    return map_texts(dealt, run, FOUND)


def by_window(rows: DataFrame) -> DataFrame:
    """What ``in_buckets`` finds, for super-k-mers of hot buckets: each window is grouped by its own words."""
    one = rows.groupBy("bucket", "name").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.first("words").alias("words"))
    windows = F.expr(f"posexplode(transform(sequence(1, size(w) - {WINDOW - 1}), i -> concat_ws(' ', slice(w, i, {WINDOW}))))")
    cut = one.withColumn("w", F.split("words", " ")).select("bucket", "name", "low", "high", windows.alias("i", "window"))
    cut = stored(cut.withColumn("window", F.unhex(F.substring(F.sha2("window", 256), 1, 32))), "windows")  # 128 bits stand for its words
    least = cut.groupBy("window").agg(F.min("low").alias("least"), F.count("*").alias("n"), F.max("high").alias("last")).where("least < last")
    least = least.select(F.substring("window", 1, 16).alias("same"), "least")  # dealt anew: many neighbours of one window can be split
    # Windows without a smaller document have no row here: their super-k-mer's own least one takes the place.
    met = cut.join(least, F.col("window") == F.col("same"))
    lists = met.groupBy("bucket", "name").agg(F.max("high").alias("high"), F.map_from_entries(F.collect_set(F.struct("i", "least"))).alias("at"))
    sizes = one.select(F.col("bucket").alias("b"), F.col("name").alias("m"), F.expr(f"size(split(words, ' ')) - {WINDOW - 1}").alias("windows"))
    joined = lists.join(sizes, (F.col("bucket") == F.col("b")) & (F.col("name") == F.col("m")))
    whole = joined.withColumn("least", F.expr(f"transform(sequence(0, windows - 1), i -> coalesce(at[i], {LAST}L))"))
    return whole.where("array_min(least) < high").select("bucket", "name", "least")


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc, key, bucket, name, start) of every super-k-mer, ``start`` counted in words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in row_slices(batch):
                words = Slice(data, offsets)
                first, windows, least = words.superkmers()
                of = words.doc[first]
                row = pa.array(of)
                start = pa.array(first - words.first[of])
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), pa.array(least.view(np.int64)), pa.array(words.names(first, windows).view(np.int64)), start], ["doc", "key", "bucket", "name", "start"])

    return map_texts(docs, run, "doc long, key long, bucket long, name long, start long")


def _finished(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_words, n_removed, kept_sha256) of rows (doc_id, text, starts: first words of the windows that go)."""
    for batch in batches:
        for part, data, offsets in row_slices(batch):
            words = Slice(data, offsets)
            change = np.zeros(len(words.doc) + 1, np.int64)
            for row, starts in enumerate(part.column(2)):
                if starts.is_valid:
                    at = words.first[row] + starts.values.to_numpy(zero_copy_only=False)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + WINDOW, -1)
            gone = np.cumsum(change)[:-1] > 0
            n = len(offsets) - 1
            lengths = np.diff(words.at)
            raw = words.spaced[np.repeat(~gone, lengths)].tobytes()
            ends = np.concatenate([[0], np.cumsum(np.bincount(words.doc[~gone], weights=lengths[~gone], minlength=n).astype(np.int64))]).tolist()
            digests = [hashlib.sha256(raw[a : b - 1] if b > a else b"").hexdigest() for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.bincount(words.doc, minlength=n)), pa.array(np.bincount(words.doc[gone], minlength=n)), pa.array(digests, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc, key, starts): of each document the first words of the windows that also start in a document before it."""
    numbered = _numbered(docs)
    hot, size = hot_cells(docs)
    found = stored(in_buckets(packed(numbered, hot, min(CELLS << 8, size // PART_BYTES + 1))), "found")
    aside = found.where("least IS NULL").select("bucket", "name", "low", "high", "words")
    whole = found.where("least IS NOT NULL").select("bucket", "name", "least")
    if not aside.isEmpty():
        whole = stored(whole.unionByName(by_window(aside)), "found")
    known = IdFilter(whole, "name")
    least = whole.select(F.col("bucket").alias("b"), afresh("name").alias("m"), "least")
    met = known.maybe(occurrences(numbered)).join(least, (F.col("name") == F.col("m")) & (F.col("bucket") == F.col("b")))
    starts = F.expr("filter(transform(least, (x, i) -> if(x < doc, start + i, -1L)), p -> p >= 0)")
    gone = met.select("doc", "key", starts.alias("starts")).where(F.size("starts") > 0)
    return stored(gone.groupBy("doc", "key").agg(F.flatten(F.collect_set("starts")).alias("starts")), "starts")


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row."""
    gone = repeated_windows(docs)
    known = IdFilter(gone, "key")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    some = known.maybe(keyed).withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)))
    starts = gone.select(F.col("doc").alias("d"), afresh("key").alias("k"), "starts")
    touched = some.join(starts, (F.col("doc") == F.col("d")) & (F.col("key") == F.col("k")), "left")
    rows = touched.select("doc_id", "text", "starts").unionByName(known.surely_not(keyed).select("doc_id", "text", F.lit(None).cast("array<long>").alias("starts")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(rows, _finished, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def op13_superkmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op13_superkmers": op13_superkmers}
ORACLE_SQL = {
    "op13_superkmers": r"""WITH lists AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM lists WHERE len(w) >= 13) s),
least AS (SELECT g, min(doc_id) AS first_id FROM windows GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i FROM windows JOIN least USING (g) WHERE first_id < doc_id) h, (SELECT unnest(range(0, 13)) AS j) s),
spelled AS (SELECT doc_id, generate_subscripts(w, 1) AS p, unnest(w) AS word FROM lists),
judged AS (SELECT s.doc_id, s.p, s.word, g.p IS NOT NULL AS is_gone FROM spelled s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.p = s.p),
sums AS (SELECT doc_id, count(*) AS n_words, count_if(is_gone)::BIGINT AS n_removed, string_agg(CASE WHEN NOT is_gone THEN word END, ' ' ORDER BY p) AS kept FROM judged GROUP BY doc_id)
SELECT l.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM lists l LEFT JOIN sums s ON s.doc_id = l.doc_id"""
}
