"""Byte-level BPE encoding and decoding by a two-tier lookup.

A pre-token that is itself a vocabulary entry is resolved by a minimal perfect hash over the vocabulary; any other is
merged with a heap over its linked bytes. Texts are cut before single spaces that a non-space follows (the pattern always
has a pre-token boundary there), and the ids of such short pieces are kept in a table of bounded size per worker.

Defined results: null text counts as empty and has no ids; texts of any length are whole (the heap takes n log n steps on
a pre-token of n bytes); repeated rows give repeated results; an empty table gives no rows; columns other than the named ones are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from corpuspark.llm.common import kind_of, map_texts, table
from corpuspark.llm.textscan import lanes, row_slices, span_hashes, windows_of_eight

CACHED_PIECES = 1 << 21
LONGEST_CACHED = 23  # bytes; with its length such a piece is three whole numbers
M64 = (1 << 64) - 1
# Odd 64-bit multipliers that mix a displacement into a hash.
MIX_D, MIX_H = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class PerfectHash:
    """Hash-and-displace over byte strings: n keys to exactly n slots."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.n_buckets = max(1, n // 3)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        buckets: list[list[int]] = [[] for _ in range(self.n_buckets)]
        for i, h in enumerate(hashes):
            buckets[h % self.n_buckets].append(i)
        self.keys: list[bytes] = [b""] * n
        self.index = np.zeros(n, np.int64)
        self.displace = np.zeros(self.n_buckets, np.int64)
        taken = bytearray(n)
        order = sorted(range(self.n_buckets), key=lambda b: -len(buckets[b]))
        free = None
        for b in order:
            members = buckets[b]
            if len(members) > 1:
                d = 1
                while True:
                    slots = {self._slot(hashes[i], d) for i in members}
                    if len(slots) == len(members) and not any(taken[s] for s in slots):
                        break
                    d += 1
                self.displace[b] = d
                places = [(self._slot(hashes[i], d), i) for i in members]
            elif members:
                free = free or iter([s for s in range(n) if not taken[s]])
                slot = next(free)
                self.displace[b] = -slot - 1
                places = [(slot, members[0])]
            else:
                break
            for s, i in places:
                taken[s] = 1
                self.keys[s], self.index[s] = keys[i], i

    def _slot(self, h: int, d: int) -> int:
        return (((h ^ (d * MIX_D & M64)) * MIX_H & M64) >> 32) % self.n

    def find(self, pieces: list[bytes]) -> list[int]:
        """Each piece's key number, or -1."""
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, pieces), np.uint64, len(pieces))
        d = self.displace[(h % np.uint64(self.n_buckets)).astype(np.int64)]
        mixed = ((h ^ (d.astype(np.uint64) * np.uint64(MIX_D))) * np.uint64(MIX_H)) >> np.uint64(32)
        slot = np.where(d < 0, -d - 1, (mixed % np.uint64(self.n)).astype(np.int64)).tolist()
        keys, index = self.keys, self.index
        return [int(index[s]) if keys[s] == p else -1 for s, p in zip(slot, pieces, strict=True)]


def little_endian(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class BytePairCodec:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.tokens = {int(r): base64.b64decode(t) for t, r in pairs}
        self.ids = list(self.tokens)
        self.whole = PerfectHash([self.tokens[i] for i in self.ids])
        rank = {t: i for i, t in self.tokens.items()}
        self.lengths = np.zeros(max(self.ids) + 1, np.int64)
        self.lengths[self.ids] = [len(t) for t in self.tokens.values()]
        self.starts = np.zeros(len(self.lengths), np.int64)
        self.starts[self.ids] = np.cumsum([0, *(len(t) for t in self.tokens.values())])[:-1]
        self.token_bytes = np.frombuffer(b"".join(self.tokens.values()), np.uint8)
        self.byte = [rank.get(bytes([b]), -1) for b in range(256)]
        self.byte_pair = [rank.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]
        self.shift = max(self.ids).bit_length()
        self.merged = {
            rank[t[:k]] << self.shift | rank[t[k:]]: i for t, i in rank.items() for k in range(1, len(t)) if t[:k] in rank and t[k:] in rank
        }

    def merge(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost on ties: a heap of pairs over a linked list of parts."""
        n, pairs, get, shift = len(piece), self.byte_pair, self.merged.get, self.shift
        parts = [self.byte[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_at = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]
        rank_at.append(-1)
        width = n.bit_length()
        mask = (1 << width) - 1
        heap = [r << width | i for i, r in enumerate(rank_at) if r >= 0]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i = top & mask
            r = top >> width
            if rank_at[i] != r:
                continue
            j = after[i]
            k = after[i] = after[j]
            parts[i], parts[j] = r, -1
            rank_at[i] = rank_at[j] = -1
            if k < n:
                before[k] = i
                if (s := get(r << shift | parts[k], -1)) >= 0:
                    rank_at[i] = s
                    heapq.heappush(heap, s << width | i)
            if (p := before[i]) >= 0:
                rank_at[p] = s = get(parts[p] << shift | r, -1)
                if s >= 0:
                    heapq.heappush(heap, s << width | p)
        return [p for p in parts if p >= 0]

    def encode_tokens(self, tokens: list[str]) -> list[bytes]:
        """Ids of each pre-token as little-endian unsigned 32-bit integers."""
        data = [t.encode() for t in tokens]
        found = [[self.ids[k]] if k >= 0 else self.merge(t) for t, k in zip(data, self.whole.find(data), strict=True)]
        return list(map(little_endian, found))

    def decode(self, ids: bytes) -> bytes:
        return self.decoded(np.frombuffer(ids, "<u4"))[0].tobytes()

    def decoded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all tokens, where each token ends)."""
        n = self.lengths[ids]
        return _gathered(self.token_bytes, self.starts[ids], n), np.cumsum(n)


@lru_cache(maxsize=2)
def codec(path: str) -> BytePairCodec:
    return BytePairCodec(path)


def _gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``values[start : start + length]`` one after the other."""
    ends = np.cumsum(lengths)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)]


#: Bytes that begin no character that is white space (the others are not cut before), and those of ASCII letters and digits, signs, line ends.
SAFE = np.ones(256, bool)
SAFE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0xC2, 0xE1, 0xE2, 0xE3]] = False
_WORD, _SIGN, _LINE = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LINE[[9, 10, 13]] = True


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin: at each text that isn't empty, at a space before a character that surely is no white space, at such a character
    after a single line end or tab, and at a sign after a letter or digit. The pattern has a boundary at all of these, and none of its
    tokens before one depends on what follows."""
    cut = np.zeros(len(data), bool)
    if len(data):
        this, following = data[:-1], data[1:]
        cut[:-1] = (this == 32) & SAFE[following]
        cut[1:] |= _WORD[this] & _SIGN[following]
        cut[2:] |= (_WORD | _SIGN)[data[:-2]] & _LINE[this[1:]] & SAFE[following[1:]]
    full = np.diff(offsets) > 0
    ends = offsets[1:][full] - 1
    cut[ends[data[ends] == 32]] = False  # a space at the end of a text belongs to it, whatever the next text begins with
    cut[offsets[:-1][full]] = True
    return np.flatnonzero(cut)


class PieceTable:
    """Ids of texts, piece by piece. ``encode`` gives (ids, where each piece's begin, how many) of pieces (UTF-8); those of short ones are
    kept in a two-way table by hash with all their bytes, of at most ``size`` places (36 bytes and some four ids each). Pieces are equal
    only where all their bytes are; longer ones are encoded each. A whole batch is looked up at once, without an object for a word."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]], size: int):
        self.encode = encode
        self.bits = max(4, int(size).bit_length() - 1)
        self.room = 4 << self.bits
        self._clear()

    def _clear(self) -> None:
        sets = 1 << self.bits
        self.pieces = np.zeros((3, sets), np.uint64)  # the last one's highest byte is the length: 0 marks a free place
        self.at = np.zeros(sets, np.int64)
        self.n = np.zeros(sets, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _keep(self, ids: np.ndarray) -> int:
        """Where the ids now begin."""
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)])
        self.ids[at : self.used] = ids
        return at

    def ids_of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets by text)."""
        if self.used > self.room:
            self._clear()
        starts = piece_starts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        key = span_hashes(data, starts, ends)
        length = ends - starts
        short = length <= LONGEST_CACHED
        eights = windows_of_eight(data)
        piece = np.stack([lanes(eights, starts, length, k) for k in range(3)])
        piece[2] &= np.uint64((1 << 56) - 1)
        piece[2] |= np.minimum(length, 255).astype(np.uint64) << np.uint64(56)

        def equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return (a[0] == b[0]) & (a[1] == b[1]) & (a[2] == b[2])

        slot = (key >> np.uint64(65 - self.bits)).astype(np.int64) * 2
        other = ~equal(self.pieces[:, slot], piece)
        slot[other] += 1
        missed = ~short
        missed[other] |= ~equal(self.pieces[:, slot[other]], piece[:, other])
        at, n = self.at[slot], self.n[slot].astype(np.int64)
        if missed.any():
            where = np.flatnonzero(missed)
            _, first, inverse = np.unique(key[where], return_index=True, return_inverse=True)
            new = where[first]
            alone = ~short[where] | ~equal(piece[:, where], piece[:, new[inverse]])
            alone[first] = False
            new = np.concatenate([new, where[alone]])  # long pieces and two pieces of one hash go one by one
            inverse[alone] = len(first) + np.arange(alone.sum())
            raw = data.tobytes()
            ids, begin, sizes = self.encode([raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            begin = begin + self._keep(ids)
            at[where], n[where] = begin[inverse], sizes[inverse]
            fit = np.flatnonzero(short[new])
            place, last = np.unique(slot[new[fit]] & ~np.int64(1), return_index=True)
            for values in (*self.pieces, self.at, self.n):  # the younger of two stays
                values[place + 1] = values[place]
            fit = fit[last]
            self.pieces[:, place] = piece[:, new[fit]]
            self.at[place], self.n[place] = begin[fit], sizes[fit]
        edges = np.concatenate([[0], np.cumsum(n)])
        return _gathered(self.ids, at, n), edges[np.searchsorted(starts, offsets)]


@lru_cache(maxsize=2)
def table_of(path: str, pattern: str) -> PieceTable:
    """One for each Python worker; Spark keeps workers from task to task."""
    split, encode = regex.compile(pattern).findall, codec(path).encode_tokens

    def ids_of_pieces(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        texts = [x.decode() for x in pieces]
        tokens = [[x] if x.isalpha() or x[1:].isalpha() and x[0] == " " else split(x) for x in texts]  # letters alone are one pre-token
        several = list(dict.fromkeys(t for ts in tokens for t in ts))
        known = dict(zip(several, encode(several), strict=True))
        found = [known[ts[0]] if len(ts) == 1 else b"".join(map(known.__getitem__, ts)) for ts in tokens]
        sizes = np.array([len(x) // 4 for x in found], np.int64)
        return np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes, sizes

    return PieceTable(ids_of_pieces, CACHED_PIECES)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id") -> DataFrame:
    """(id, ids binary: little-endian unsigned 32-bit) for each row's whole ``text``. No shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = table_of(path, pattern)
        for batch in batches:
            for part, data, offsets in row_slices(batch):
                ids, at = pieces.ids_of(data, offsets)
                raw, at = ids.astype("<u4").tobytes(), (4 * at).tolist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([raw[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary())], ["id", "ids"])

    return map_texts(docs.select(id_column, "text"), run, f"id {kind_of(docs, id_column)}, ids binary").withColumnRenamed("id", id_column)


def digest_round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode every text; (doc_id, n_tokens, ids_sha256, decoded_sha256) in the same pass, so that ids needn't move."""

    def digests(raw: bytes, at: list[int]) -> pa.Array:
        return pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)], pa.string())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, pieces = codec(path), table_of(path, pattern)
        for batch in batches:
            for part, data, offsets in row_slices(batch):
                ids, at = pieces.ids_of(data, offsets)
                back, ends = bpe.decoded(ids)
                of_text = np.concatenate([[0], ends])[at]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(at)), digests(ids.astype("<u4").tobytes(), (4 * at).tolist()), digests(back.tobytes(), of_text.tolist())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return map_texts(docs.select("doc_id", "text"), run, f"doc_id {kind_of(docs, 'doc_id')}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return digest_round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


QUERIES = {"op8_bpe": op8_bpe}
ORACLE_SQL: dict = {}
