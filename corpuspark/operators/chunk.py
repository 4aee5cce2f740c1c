"""Chunking of block tables and what each chunk carries: identifiers, hashes, fingerprints, vectors, summaries, anchors, index rows."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuspark.functions.expr import hamming, strip, tokens, uuid5
from corpuspark.operators.parse import split_blocks
from corpuspark.sources.staging import few, staged

#: Delimiters by chunking method, and the question marks.
DELIMITERS = {
    "delimiter": "。！？；\n",
    "book": "\n。；！？",
    "laws": "\n。；",
    "manual": "\n。；",
    "paper": "\n。；！？",
    "resume": "\n",
    "email": "\n",
    "tag": "\n,，;；",
}
QUESTION = r"(?i)(?:^|\n)\s*(?:Q\d*\s*[:：]|问\d*\s*[:：]|Question\d*\s*[:：])"
SIZE, OVERLAP = 512, 0.1
BARRIERS = ("table", "figure")
TOKEN = regex.compile(r"\p{Han}|[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]|\s+")
CHUNKS = "file_id long, chunk_order long, content string, page int, section_path string, skip_summary boolean"


def token_spans(text: str) -> list[str]:
    """Default tokenizer: ideographs, words, single other signs and white space; joining the tokens gives the text back."""
    return TOKEN.findall(text)


def token_count(text: Column) -> Column:
    """Number of the default tokenizer's tokens, white space not counted."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(\p{IsHan}|[\p{L}\p{N}_&&[^\p{IsHan}]]+|[^\s\p{L}\p{N}_])"), F.lit(1)))


class _Greedy:
    """Chunks (content, page, section, is barrier) of one file from its blocks (text, block_type, page, section) in order, one block at a
    time. What waits is less than a chunk."""

    def __init__(self, size: int, overlap: float, tokenize: Callable[[str], list[str]]):
        self.size, self.tokenize = size, tokenize
        self.step, self.carried = max(1, int(size * (1 - overlap))), max(0, int(size * overlap))
        self.waiting: list[tuple[tuple, int]] = []

    def _released(self, keep_tail: bool) -> list[tuple]:
        if not self.waiting:
            return []
        first = self.waiting[0][0]
        text = "\n".join(b[0] for b, _ in self.waiting).strip()
        tail, room = len(self.waiting), self.carried if keep_tail else 0
        while tail and self.waiting[tail - 1][1] <= room:
            tail -= 1
            room -= self.waiting[tail][1]
        self.waiting = self.waiting[tail:] if tail else []  # what would be all of it again is not carried
        return [(text, first[2], first[3], False)] if text else []

    def add(self, block: tuple) -> list[tuple]:
        """The chunks that are whole once this block is known."""
        text, kind, page, section = block
        if not text or not text.strip():
            return []
        if kind in BARRIERS:
            return [*self._released(False), (text.strip(), page, section, True)]
        pieces = self.tokenize(text)
        if kind != "title" and len(pieces) > self.size:
            starts = range(0, max(1, len(pieces) - self.size + self.step), self.step)
            slid = ("".join(pieces[a : a + self.size]).strip() for a in starts)
            return [*self._released(False), *((t, page, section, False) for t in slid if t)]
        out = []
        if kind == "title":
            out = self._released(False)
        elif self.waiting and sum(n for _, n in self.waiting) + len(pieces) > self.size:
            out = self._released(True)
        self.waiting.append((block, len(pieces)))
        return out

    def end(self) -> list[tuple]:
        return self._released(False)


ROWS_AT_ONCE = 1000


def chunk_naive(blocks: DataFrame, size: int = SIZE, overlap: float = OVERLAP, tokenize: Callable[[str], list[str]] = token_spans) -> DataFrame:
    """Layout-aware greedy chunks: titles start one, tables and figures are their own, whole blocks overlap, long blocks slide.

    A fold over sorted blocks: files follow each other in a task, and what is kept is the open chunk of one file, so no file is ever whole.
    """
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold, order, rows = object(), None, 0, []

        def put(chunks: list[tuple]) -> None:
            nonlocal order
            for c in chunks:
                rows.append((now, order, *c))
                order += 1

        def taken() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                for file_id, _, *block in zip(*(c.to_pylist() for c in batch.slice(at, ROWS_AT_ONCE).columns), strict=True):
                    if file_id != now:
                        if fold:
                            put(fold.end())
                        now, fold, order = file_id, _Greedy(size, overlap, tokenize), 0
                    put(fold.add(tuple(block)))
                if rows:
                    yield taken()
        if fold:
            put(fold.end())
        if rows:
            yield taken()

    slim = blocks.select(F.col("file_id").cast("long").alias("file_id"), "pos", "text", "block_type", F.col("page").cast("int").alias("page"), "section_path")
    slim.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)
    return slim.repartition("file_id").sortWithinPartitions("file_id", "pos", "text", "block_type", "page", "section_path").mapInArrow(run, CHUNKS)


def chunk_one(blocks: DataFrame) -> DataFrame:
    """Each file as one chunk."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda b: b.text), "\n")
    whole = blocks.where(strip(F.col("text")) != "").groupBy("file_id").agg(strip(text).alias("content"), F.min_by("page", "pos").alias("page"))
    return whole.select("file_id", F.lit(0).cast("long").alias("chunk_order"), "content", "page", F.lit(None).cast("string").alias("section_path"), F.lit(False).alias("skip_summary"))


def chunk_delimiter(blocks: DataFrame, delimiters: str = DELIMITERS["delimiter"], size: int = SIZE, overlap: float = OVERLAP) -> DataFrame:
    return chunk_naive(split_blocks(blocks, delimiters), size, overlap)


def chunk_domain(blocks: DataFrame, method: str, size: int = SIZE, overlap: float = OVERLAP) -> DataFrame:
    """With the method's preset delimiters; methods without any chunk naively."""
    return chunk_delimiter(blocks, DELIMITERS.get(method, ""), size, overlap)


def chunk_qa(blocks: DataFrame, size: int = SIZE, overlap: float = OVERLAP, tokenize: Callable[[str], list[str]] = token_spans) -> DataFrame:
    """One chunk for each question and its answer; files with fewer than two question marks chunk naively."""
    step = max(1, int(size * (1 - overlap)))

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f, page, pairs in zip(batch.file_id, batch.page, batch.pairs, strict=True):
                texts = []
                for pair in pairs:
                    pieces = tokenize(pair)
                    texts += [pair] if len(pieces) <= size else ["".join(pieces[a : a + size]).strip() for a in range(0, len(pieces), step)]
                rows += [(f, k, t, page, None, False) for k, t in enumerate(x for x in texts if x)]
            yield pd.DataFrame(rows, columns=["file_id", "chunk_order", "content", "page", "section_path", "skip_summary"])

    mark = "\u0000"
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda b: b.text), "\n")
    joined = blocks.where(strip(F.col("text")) != "").groupBy("file_id").agg(text.alias("text"), F.min_by("page", "pos").alias("page"))
    parts = F.split(F.regexp_replace("text", f"({QUESTION})", mark + "$1"), mark)
    asked = joined.select("file_id", "page", F.filter(F.transform(F.slice(parts, 2, F.size(parts)), strip), lambda p: p != "").alias("pairs")).where(F.size("pairs") >= 2)
    plain = blocks.join(asked.select("file_id"), "file_id", "left_anti")
    return asked.mapInPandas(windows, CHUNKS).unionByName(chunk_naive(plain, size, overlap, tokenize))


def resolve_parse_config(files: DataFrame, links: DataFrame, kbs: DataFrame) -> DataFrame:
    """(file_id, method): the file's own, else that of its first base that has one, else naive."""
    of_kb = links.join(kbs.where("kb_method IS NOT NULL").select("kb_id", "kb_method"), "kb_id").groupBy("file_id").agg(F.min_by("kb_method", "kb_id").alias("kb_method"))
    return files.join(of_kb, "file_id", "left").select("file_id", F.coalesce("file_method", "kb_method", F.lit("naive")).alias("method"))


def chunk_id(file_id: Column, version: Column, order: Column) -> Column:
    return uuid5(F.concat_ws(":", file_id.cast("string"), version.cast("string"), order.cast("string")))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def _simhash_slice(texts: list[str]) -> np.ndarray:
    """Fingerprints of texts that aren't empty: votes of the distinct pairs, looked up and summed by text."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum([len(t) for t in texts])
    pair = points << np.uint64(32)
    pair[:-1] |= points[1:] + np.uint64(1)
    lone = np.zeros(len(points), bool)
    lone[ends - 1] = True  # the last character of a text begins no pair, unless it is the only one
    single = np.array([len(t) for t in texts]) == 1
    pair[ends[single] - 1] &= np.uint64(0xFFFFFFFF00000000)
    keep = ~lone
    keep[ends[single] - 1] = True
    distinct, of = np.unique(pair[keep], return_inverse=True)
    names = [chr(x >> 32) + (chr((x & 0xFFFFFFFF) - 1) if x & 0xFFFFFFFF else "") for x in distinct.tolist()]
    digests = b"".join(hashlib.blake2b(f.encode("utf-8", "surrogatepass"), digest_size=8).digest() for f in names)
    signs = 2 * np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, 64).astype(np.float32) - 1
    starts = np.concatenate([[0], np.cumsum(keep)])[ends - [len(t) for t in texts]]
    stops = np.append(starts[1:], len(of))
    votes = np.empty((len(texts), 64))
    for a, b in _runs(starts, stops, len(distinct)):  # how often each text has each pair, times the pairs' signs
        rows = b - a
        if rows == 1 and len(distinct) > VOTE_CELLS:
            own, n = np.unique(of[starts[a] : stops[a]], return_counts=True)
            votes[a] = n @ signs[own]
            continue
        key = np.repeat(np.arange(rows), stops[a:b] - starts[a:b]) * len(distinct) + of[starts[a] : stops[b - 1]]
        votes[a:b] = np.bincount(key, minlength=rows * len(distinct)).reshape(rows, -1).astype(np.float32) @ signs
    return np.packbits(votes > 0, axis=1).view(">i8").ravel()


VOTE_CELLS = 2_000_000


def _runs(starts: np.ndarray, stops: np.ndarray, width: int) -> Iterator[tuple[int, int]]:
    """Runs of texts whose tables of counts have at most ``VOTE_CELLS`` places."""
    step = max(1, VOTE_CELLS // max(1, width))
    for a in range(0, len(starts), step):
        yield a, min(a + step, len(starts))


SIMHASH_CHARS = 200_000


@F.pandas_udf(T.LongType())
def simhash64(texts: pd.Series) -> pd.Series:
    """Signed 64-bit SimHash of the character pairs (with multiplicity) of the lower-cased text without white space."""
    squeezed = [None if t is None else "".join(t.lower().split()) for t in texts]
    out: list[int | None] = [None if t is None else 0 for t in squeezed]
    part: list[int] = []
    size = 0
    full = [i for i, t in enumerate(squeezed) if t]
    for i in full:
        part.append(i)
        size += len(squeezed[i])
        if size >= SIMHASH_CHARS or i == full[-1]:
            for k, h in zip(part, _simhash_slice([squeezed[k] for k in part]).tolist(), strict=True):
                out[k] = h
            part, size = [], 0
    return pd.Series(out, index=texts.index, dtype="Int64")


def same_segment(a: Column, b: Column, radius: int = 3) -> Column:
    return hamming(a, b) <= radius


SMALL = 512
BLOCK = 2048
SIDE = 512
CELL = "place, t, v, i, j"


def _agreeing() -> list[int]:
    """The bits on which fingerprints of a bucket agree: four bands of 16 bits, then for each band its bits and one of four parts of the others."""
    bands = [0xFFFF << 16 * k for k in range(4)]
    rest = [[b for b in range(64) if not band >> b & 1] for band in bands]
    return bands + [band | sum(1 << b for b in bits[part::4]) for band, bits in zip(bands, rest, strict=True) for part in range(4)]


AGREEING = _agreeing()


def _first_of(t: int) -> list[np.uint64]:
    """The bits of the buckets of the same level that come before ``t``, and of the bands before its own: a pair that shares one counts there."""
    band, part = (t, 0) if t < 4 else divmod(t - 4, 4)
    return [np.uint64(m) for m in AGREEING[:band] + AGREEING[4 + 4 * band : 4 + 4 * band + part]]


def _near_in_cells(radius: int):
    """Sums of ``n`` of the fingerprints within the radius, for the rows (place, t, v, i, j, block, simhash, n) of cells in order. Pairs count in
    the first bucket that they share only; a cell of two blocks counts pairs across them."""
    before = [_first_of(t) for t in range(len(AGREEING))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None

        def settle(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(rows):
                return
            t, f, n, near = rows[:, 1].copy(), rows[:, 6].copy().view(np.uint64), rows[:, 7].copy(), np.zeros(len(rows), np.int64)

            def add(a: np.ndarray, b: np.ndarray) -> None:
                """Pairs of rows within the radius."""
                x, of = f[a] ^ f[b], t[a]
                first = x != 0
                for k in np.unique(of).tolist():
                    for bits in before[k]:
                        first &= (of != k) | (x & bits != 0)
                a, b = a[first], b[first]
                np.add.at(near, a, n[b])
                np.add.at(near, b, n[a])

            starts = np.append(0, np.flatnonzero((rows[1:, :5] != rows[:-1, :5]).any(1)) + 1)
            sizes = np.diff(np.append(starts, len(rows)))
            across = rows[starts, 3] != rows[starts, 4]
            small = (sizes <= 32) & ~across
            left = np.where(np.repeat(small, sizes), np.repeat(starts + sizes, sizes) - np.arange(len(rows)), 0)  # rows of a small cell from here on
            a = np.flatnonzero(left > 1)
            for d in range(1, 32):  # all small cells at once: each row and the d-th after it
                a = a[left[a] > d]
                if not len(a):
                    break
                hit = a[np.bitwise_count(f[a] ^ f[a + d]) <= radius]
                add(hit, hit + d)
            for start, size, two in zip(starts[~small].tolist(), sizes[~small].tolist(), across[~small].tolist(), strict=True):
                here = np.arange(start, start + size)
                own = rows[here, 5] == rows[start, 3]
                one, other = (here[own], here[~own]) if two else (here, here)
                for p in range(0, len(one), SIDE):
                    for q in range(0 if two else p, len(other), SIDE):
                        a, b = one[p : p + SIDE], other[q : q + SIDE]
                        i, j = np.nonzero(np.bitwise_count(f[a, None] ^ f[b]) <= radius)
                        if p == q and not two:
                            i, j = i[i < j], j[i < j]
                        add(a[i], b[j])
            some = near > 0
            yield pa.RecordBatch.from_arrays([pa.array(rows[some, 0]), pa.array(rows[some, 6]), pa.array(near[some])], ["place", "simhash", "near"])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)
            if not len(rows):
                continue
            new = np.flatnonzero((rows[:, :5] != rows[-1, :5]).any(1))
            if last is not None and (rows[0, :5] != last).any():
                yield from settle(np.concatenate(held))
                held = []
            k = int(new[-1]) + 1 if len(new) else 0  # where the last cell of this batch begins
            if k:
                yield from settle(np.concatenate([*held, rows[:k]]))
                held = []
            held.append(rows[k:])
            last = rows[-1, :5]
        if held:
            yield from settle(np.concatenate(held))

    return run


def near_duplicate_segments(chunks: DataFrame, radius: int = 3, within_file: bool = True) -> DataFrame:
    """(chunk_key, class_key, n_links) of chunks (chunk_key, file_id, simhash): the first chunk with an equal fingerprint, and how many other
    chunks lie within a Hamming radius of at most 3; in the same file, or anywhere. Chunks without a fingerprint have no row.

    Chunks of equal fingerprints are one class, so copies are never paired. Two fingerprints within the radius agree on one of four 16-bit
    bands, and on one of four parts of the other bits. A band value that more than ``SMALL`` classes share is cut by those parts, so that
    buckets stay small as the fingerprints grow in number; what more than ``BLOCK`` share even so is cut into cells of two blocks of some
    ``BLOCK`` classes. Only counts leave a cell. Fingerprints are taken once, into a staged table.
    """
    if radius > 3:
        raise ValueError("four bands find radii up to 3")
    place = F.col("file_id") if within_file else F.lit(0)
    known = staged(chunks.where("simhash IS NOT NULL").select("chunk_key", place.cast("long").alias("place"), "simhash"), "fingerprints")
    classes = staged(known.groupBy("place", "simhash").agg(F.min("chunk_key").alias("class_key"), F.count("*").alias("n")), "classes")
    bits = F.array(*(F.lit(m - (m >> 63 << 64)) for m in AGREEING))
    bucket = lambda t: F.struct(t.cast("int").alias("t"), F.col("simhash").bitwiseAND(F.element_at(bits, (t + 1).cast("int"))).alias("v"))
    banded = classes.select("place", "simhash", "n", F.inline(F.array(*(bucket(F.lit(k)) for k in range(4)))))
    sizes = banded.groupBy("place", "t", "v").agg(F.count("*").alias("size")).where("size > 1").select(F.col("place").alias("p"), F.col("t").alias("u"), F.col("v").alias("w"), "size")
    same = lambda of: (F.col("place") == of["p"]) & (F.col("t") == of["u"]) & (F.col("v") == of["w"])
    met = staged(banded.join(sizes, same(sizes)).select("place", "t", "v", "simhash", "n", "size"), "banded")
    finer = met.where(F.col("size") > SMALL).select("place", "simhash", "n", F.inline(F.array(*(bucket(4 + 4 * F.col("t") + k) for k in range(4)))))
    crowds = finer.groupBy("place", "t", "v").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK)
    crowds = few(crowds.select(F.col("place").alias("p"), F.col("t").alias("u"), F.col("v").alias("w"), F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "crowds")
    cut = finer.join(crowds, same(crowds), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("simhash"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cut.select("place", "t", "v", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "simhash", "n")
    whole = met.where(F.col("size") <= SMALL).select("place", "t", "v", *(F.lit(0).alias(c) for c in ("i", "j", "block")), "simhash", "n")
    dealt = whole.unionByName(cells).repartition(*CELL.split(", ")).sortWithinPartitions(*CELL.split(", "))
    links = dealt.mapInArrow(_near_in_cells(radius), "place long, simhash long, near long").groupBy("place", "simhash").agg(F.sum("near").alias("near"))
    of_class = classes.join(links, ["place", "simhash"], "left")
    counted = of_class.select(F.col("place").alias("p"), F.col("simhash").bitwiseXOR(F.lit(0)).alias("h"), "class_key", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    return known.join(counted, (F.col("place") == F.col("p")) & (F.col("simhash") == F.col("h"))).select("chunk_key", "class_key", "n_links")


def hash_embedding(dim: int):
    """A unit pseudo-vector that depends on the text alone."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        def one(text):
            rng = random.Random(int(hashlib.sha256((text or "").encode()).hexdigest(), 16))
            v = np.array([rng.gauss(0, 1) for _ in range(dim)])
            return v / (np.sqrt(v @ v) or 1.0)

        return texts.map(one)

    return embed


def embed_batch(rows: DataFrame, model: Callable[[list[str]], list[list[float]]], dim: int, batch: int = 16) -> DataFrame:
    """Add ``vector`` from a batch function of texts; a batch that fails takes the pseudo-vectors."""
    plain = hash_embedding(dim).func

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            out = []
            for a in range(0, len(texts), batch):
                some = texts.iloc[a : a + batch]
                try:
                    out += list(model(some.tolist()))
                except Exception:  # the model is the user's; its failure has a defined result
                    out += list(plain(some))
            yield pd.Series(out, index=texts.index)

    return rows.withColumn("vector", embed("content"))


def summary_windows(chunks: DataFrame, window: int = 8000, min_tokens: int = 1500, min_chunks: int = 5) -> DataFrame:
    """(file_id, chunk_order, window_no) of the chunks (file_id, chunk_order, n_tokens, skip_summary) of files long enough to summarise. A fold
    over sorted chunks: what is kept is one file's number and tokens so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, total = object(), 0, 0
        for batch in batches:
            numbers = []
            for f, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if f != now:
                    now, number, total = f, 0, 0
                elif total >= window:
                    number, total = number + 1, 0
                numbers.append(number)
                total += n or 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(numbers, pa.int32())], ["file_id", "chunk_order", "window_no"])

    some = chunks.where("NOT skip_summary").select(F.col("file_id").cast("long").alias("file_id"), F.col("chunk_order").cast("long").alias("chunk_order"), F.col("n_tokens").cast("long").alias("n_tokens"))
    long_ones = some.groupBy("file_id").agg(F.sum("n_tokens").alias("total"), F.count("*").alias("n")).where((F.col("total") >= min_tokens) & (F.col("n") >= min_chunks))
    kept = some.join(long_ones.select("file_id"), "file_id", "left_semi").repartition("file_id").sortWithinPartitions("file_id", "chunk_order")
    return kept.mapInArrow(run, "file_id long, chunk_order long, window_no int")


ITEMS = "array<struct<summary_text:string,source_chunk_ids:array<string>,coverage:string,heading_path:array<string>>>"


def validate_summaries(answers: DataFrame) -> DataFrame:
    """Items of model answers (file_id, answer, allowed ids): JSON arrays, fenced or not; foreign sources go, and items without sources or
    with an unknown coverage."""
    body = F.regexp_extract("answer", r"(?s)(\[.*\])", 1)
    items = answers.select("file_id", "allowed", F.inline(F.from_json(body, ITEMS)))
    known = F.filter("source_chunk_ids", lambda s: F.array_contains("allowed", s))
    return items.withColumn("source_chunk_ids", known).where((F.size("source_chunk_ids") > 0) & F.col("coverage").isin("yes", "uncertain")).drop("allowed")


def coverage_ratio(chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    """(file_id, coverage_ratio): distinct chunks that summaries cite, of those that may be summarised; 0 if there are none."""
    cited = summaries.select("file_id", F.explode("source_chunk_ids").alias("chunk_key")).groupBy("file_id").agg(F.countDistinct("chunk_key").alias("cited"))
    eligible = chunks.groupBy("file_id").agg(F.count(F.when(~F.col("skip_summary"), 1)).alias("eligible"))
    ratio = F.when(F.col("eligible") > 0, F.coalesce("cited", F.lit(0)) / F.col("eligible")).otherwise(F.lit(0.0))
    return eligible.join(cited, "file_id", "left").select("file_id", ratio.alias("coverage_ratio"))


def build_anchors(summaries: DataFrame, chunks: DataFrame) -> DataFrame:
    """One anchor for each summary: its first source with that chunk's hash and fingerprint, and the headings' path."""
    target = summaries.select("summary_key", "file_id", F.try_element_at("source_chunk_ids", F.lit(1)).alias("chunk_key"), F.nullif(F.array_join("heading_path", "/"), F.lit("")).alias("section_path"))
    hashed = chunks.select("chunk_key", content_hash(F.col("content")).alias("target_content_hash"), "simhash")
    return target.join(hashed, "chunk_key", "left").withColumnRenamed("chunk_key", "target_chunk_id")


def build_index_docs(chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    """Chunks and summaries in one staged schema, not yet available."""
    a = chunks.select(F.col("chunk_key").alias("doc_key"), "file_id", F.col("content"), "chunk_order", F.col("version").alias("chunk_version"), F.lit("chunk").alias("doc_type"))
    b = summaries.select(F.col("summary_key").alias("doc_key"), "file_id", F.col("summary_text").alias("content"), "coverage_ratio", F.lit("summary").alias("doc_type"))
    return a.unionByName(b, allowMissingColumns=True).withColumn("available", F.lit(0))


def ingest_cost(chunks: DataFrame, model: str) -> DataFrame:
    return chunks.groupBy("file_id").agg(F.count("*").alias("chunks"), F.sum("n_tokens").alias("tokens")).withColumn("model", F.lit(model))


def ingest_stats(chunks: DataFrame, summaries: DataFrame, diff: DataFrame, coverage: DataFrame) -> DataFrame:
    """By file: version, chunks, summaries, coverage and how many chunks were reused or fresh."""
    n = chunks.groupBy("file_id").agg(F.max("version").alias("version"), F.count("*").alias("chunks"))
    s = summaries.groupBy("file_id").agg(F.count("*").alias("summaries"))
    r = diff.groupBy("file_id").agg(F.count(F.when(~F.col("fresh"), 1)).alias("reused"), F.count(F.when(F.col("fresh"), 1)).alias("fresh"))
    joined = n.join(s, "file_id", "left").join(r, "file_id", "left").join(coverage, "file_id", "left")
    return joined.na.fill(0, ["summaries", "reused", "fresh"]).na.fill(0.0, ["coverage_ratio"])


