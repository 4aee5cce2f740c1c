"""Whole-batch scans of UTF-8 text with numpy: letter symbols, words and their hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Symbols of ``letters``: 0 a run of anything that is no letter, 1-26 a-z, then the bytes 0x80-0xFF.
SYMBOLS = 27 + 128
SLICE_BYTES = 400_000
LONG_SPAN = 64
#: Fixed value: an odd multiplier.
BASE = 0x9E3779B97F4A7C15


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; nulls are empty."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    off = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[off[0] : off[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def row_slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """A batch in runs of rows with about ``size`` bytes of text, each with its bytes and offsets."""
    at, k = 0, batch.schema.get_field_index(column)
    _, ends = utf8(batch.column(k))
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        part = batch.slice(at, to - at)
        yield part, *utf8(part.column(k))
        at = to
    pa.default_memory_pool().release_unused()


_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = _CLASS[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_CLASS[128:] = np.arange(27, SYMBOLS)


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of each text, lower-cased (ASCII and Latin-1), runs of non-letters as one 0; every text starts with a 0."""
    n = len(offsets) - 1
    s = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
    upper = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97)]
    s[upper] += 32
    out = np.zeros(len(data) + n, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = s
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    starts = offsets[:-1] + np.arange(n)
    keep[starts] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], np.concatenate([kept[starts], kept[-1:]]).astype(np.int64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers (fixed values of a published mixer)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def windows_of_eight(values: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros behind the end."""
    padded = np.zeros(len(values) + 8, np.uint8)
    padded[: len(values)] = values
    return np.ndarray(len(values) + 1, "<u8", padded, strides=(1,))


def lanes(eights: np.ndarray, starts: np.ndarray, lengths: np.ndarray, k: int) -> np.ndarray:
    """Bytes 8k to 8k + 7 of each span as one number; bytes behind its end are 0."""
    at = np.minimum(starts + 8 * k, len(eights) - 1)
    return eights[at] & _HEADS[np.clip(lengths - 8 * k, 0, 8)]


_HEADS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of ``values`` (bytes), equal for equal spans wherever they lie. Eight bytes at a time are mixed in, so that
    spans with a common pattern have no more chance of equal hashes than others; long ones are hashed one by one."""
    lengths = ends - starts
    out = mix(lengths.astype(np.uint64) * np.uint64(BASE) + np.uint64(1))
    short, eights = np.flatnonzero(lengths <= LONG_SPAN), windows_of_eight(values)
    for k in range(LONG_SPAN // 8):
        short = short[lengths[short] > 8 * k]
        if not len(short):
            break
        out[short] = mix(out[short] * np.uint64(BASE) ^ mix(lanes(eights, starts[short], lengths[short], k) + np.uint64(k + 1)))
    for i in np.flatnonzero(lengths > LONG_SPAN).tolist():
        out[i] = xxhash.xxh3_64_intdigest(values[starts[i] : ends[i]].tobytes(), seed=LONG_SPAN)
    return out


def spans(is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], is_word.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words of each text, their hashes in order); words are runs of bytes that are no ASCII white space."""
    n = len(offsets) - 1
    out = np.full(len(data) + n, 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = data
    starts, ends = spans(~_SPACE[out])
    doc = np.searchsorted(offsets[:-1] + np.arange(n), starts, "right") - 1
    return np.bincount(doc, minlength=n), span_hashes(out, starts, ends)


def shingles(counts: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the runs of ``size`` words, offsets by text); a shorter text with words has one shingle of all of them."""
    first = np.concatenate([[0], np.cumsum(counts)])
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    start = np.repeat(first[:-1] - at[:-1], n) + np.arange(at[-1])
    length = np.repeat(np.minimum(counts, size), n)
    out = np.zeros(len(start), np.uint64)
    for j in range(size):
        some = length > j
        out[some] = out[some] * np.uint64(BASE) + hashes[start[some] + j]
    return mix(out + length.astype(np.uint64)), at
