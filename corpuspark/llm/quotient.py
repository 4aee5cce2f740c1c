"""Counting quotient filters: lossless compact counters of packed n-grams of whole numbers.

An n-gram of ids of ``bits`` bits each is one number of n * bits bits. An invertible permutation of these numbers spreads them evenly; its
high bits are the quotient, all other bits the remainder. As the permutation can be undone, quotient and remainder together are the
n-gram itself: the counts are exact and nothing is lost. A filter is the sorted run of its (quotient, remainder, count); the quotients are
kept as differences and counts as variable-length numbers, the remainders in whole bytes. Two filters of the same width merge by
their order. Runs of quotients are ranges of the permuted numbers, so shards cut their filters at the same places and each range merges alone.
"""

from __future__ import annotations

import numpy as np

from corpuspark.llm.textscan import mix

LANE_BITS = 60
ROUNDS = 4


class PackedGrams:
    """n-grams of ids below 2**bits as permuted numbers of n * bits bits, in lanes of at most 60 bits, the highest first."""

    def __init__(self, n: int, bits: int):
        self.n, self.bits = n, bits
        total = n * bits
        count = max(2, -(-total // LANE_BITS))
        self.widths = [total // count + (k < total % count) for k in range(count)]
        self.masks = [np.uint64((1 << w) - 1) for w in self.widths]

    def pack(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        """``ids``: n arrays, the first word of each n-gram, the second, and so on."""
        lanes = [np.zeros(len(ids[0]), np.uint64) for _ in self.widths]
        for lane, at, word, shift, take in self._fields():
            lanes[lane] |= ((ids[word].astype(np.uint64) >> np.uint64(shift)) & np.uint64((1 << take) - 1)) << np.uint64(at)
        return self._permuted(lanes, False)

    def unpack(self, lanes: list[np.ndarray]) -> list[np.ndarray]:
        lanes = self._permuted(list(lanes), True)
        ids = [np.zeros(len(lanes[0]), np.int64) for _ in range(self.n)]
        for lane, at, word, shift, take in self._fields():
            ids[word] |= (((lanes[lane] >> np.uint64(at)) & np.uint64((1 << take) - 1)) << np.uint64(shift)).astype(np.int64)
        return ids

    def _fields(self):
        """(lane, bit there, word, bit there, number of bits): how the words' bits lie in the lanes."""
        starts = [sum(self.widths[k + 1 :]) for k in range(len(self.widths))]
        for word in range(self.n):
            low = (self.n - 1 - word) * self.bits
            for lane, (start, width) in enumerate(zip(starts, self.widths, strict=True)):
                a, b = max(low, start), min(low + self.bits, start + width)
                if a < b:
                    yield lane, a - start, word, a - low, b - a

    def _permuted(self, lanes: list[np.ndarray], backwards: bool) -> list[np.ndarray]:
        """Each step adds (exclusive or) to one lane a function of the others, so the same steps backwards undo it."""
        steps = [(r, k) for r in range(ROUNDS) for k in range(len(lanes))]
        for r, k in reversed(steps) if backwards else steps:
            other = np.full(len(lanes[0]), r * len(lanes) + k + 1, np.uint64)
            for j, lane in enumerate(lanes):
                if j != k:
                    other = mix(other + lane)
            lanes[k] = lanes[k] ^ (other & self.masks[k])
        return lanes


def counted(lanes: list[np.ndarray], widths: list[int], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """(lanes of the distinct numbers in order, their counts)."""
    if not len(lanes[0]):
        return lanes, np.zeros(0, np.uint64)
    if sum(widths) <= 64 and counts is None:
        number = np.sort(lanes[0] << np.uint64(widths[1]) | lanes[1])
        first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        number, counts = number[first], np.diff(np.append(first, len(number))).astype(np.uint64)
        return [number >> np.uint64(widths[1]), number & np.uint64((1 << widths[1]) - 1)], counts
    if sum(widths) <= 64:
        order = np.argsort(lanes[0] << np.uint64(widths[1]) | lanes[1], kind="stable")
    else:
        order = np.lexsort(lanes[::-1])
    lanes = [x[order] for x in lanes]
    new = np.ones(len(order), bool)
    new[1:] = False
    for x in lanes:
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    counts = np.ones(len(order), np.uint64) if counts is None else counts[order]
    return [x[first] for x in lanes], np.add.reduceat(counts, first)


def varints(values: np.ndarray) -> bytes:
    """Whole numbers as runs of seven bits, the lowest first; the highest bit says that more follow."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1 << 7 * k)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(10):
        some = size > k
        if not some.any():
            break
        more = (size[some] > k + 1).astype(np.uint8) << 7
        out[at[some] + k] = ((values[some] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out.tobytes()


def from_varints(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    last = np.flatnonzero(data < 128)
    start = np.concatenate([[0], last[:-1] + 1]).astype(np.int64)
    out = np.zeros(len(last), np.uint64)
    for k in range(10):
        some = start + k <= last
        if not some.any():
            break
        out[some] |= (data[start[some] + k].astype(np.uint64) & np.uint64(127)) << np.uint64(7 * k)
    return out


class QuotientFilter:
    """A sorted run of permuted numbers with counts; ``quotient_bits`` of the first lane's highest bits are the quotient."""

    def __init__(self, packing: PackedGrams, quotient_bits: int, lanes: list[np.ndarray], counts: np.ndarray):
        self.packing, self.lanes, self.counts = packing, lanes, counts
        self.quotient_bits = min(quotient_bits, packing.widths[0])

    @classmethod
    def of(cls, packing: PackedGrams, quotient_bits: int, ids: list[np.ndarray]) -> QuotientFilter:
        return cls(packing, quotient_bits, *counted(packing.pack(ids), packing.widths))

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        a = filters[0]
        lanes = [np.concatenate(x) for x in zip(*(f.lanes for f in filters), strict=True)]
        return cls(a.packing, a.quotient_bits, *counted(lanes, a.packing.widths, np.concatenate([f.counts for f in filters])))

    def __len__(self) -> int:
        return len(self.counts)

    def quotients(self) -> np.ndarray:
        return self.lanes[0] >> np.uint64(self.packing.widths[0] - self.quotient_bits)

    def ranges(self, range_bits: int) -> list[tuple[int, QuotientFilter]]:
        """The parts with equal highest ``range_bits`` of the quotient, empty ones left out."""
        top = (self.lanes[0] >> np.uint64(self.packing.widths[0] - min(range_bits, self.quotient_bits))).astype(np.int64)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(top)) + 1, [len(top)]]) if len(top) else [0]
        of = lambda a, b: QuotientFilter(self.packing, self.quotient_bits, [x[a:b] for x in self.lanes], self.counts[a:b])
        return [(int(top[a]), of(a, b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def at_least(self, count: int) -> tuple[list[np.ndarray], np.ndarray]:
        """(ids of the n-grams with that count or more, their counts)."""
        some = self.counts >= np.uint64(count)
        return self.packing.unpack([x[some] for x in self.lanes]), self.counts[some].astype(np.int64)

    def _remainder_widths(self) -> list[int]:
        return [self.packing.widths[0] - self.quotient_bits, *self.packing.widths[1:]]

    def dump(self) -> bytes:
        """Three runs (differences of quotients, counts, remainders), the lengths of the first two before them."""
        quotients = self.quotients()
        steps = varints(np.diff(quotients, prepend=np.uint64(0)))
        counts = varints(self.counts)
        remainders = b""
        for lane, width in zip(self.lanes, self._remainder_widths(), strict=True):
            low = (lane & np.uint64((1 << width) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)
            remainders += np.ascontiguousarray(low[:, : -(-width // 8)].T).tobytes()
        return len(steps).to_bytes(8, "little") + len(counts).to_bytes(8, "little") + steps + counts + remainders

    @classmethod
    def load(cls, packing: PackedGrams, quotient_bits: int, raw: bytes) -> QuotientFilter:
        out = cls(packing, quotient_bits, [], np.zeros(0, np.uint64))
        n_steps, n_counts = int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:16], "little")
        quotients = np.cumsum(from_varints(raw[16 : 16 + n_steps]), dtype=np.uint64)
        out.counts = from_varints(raw[16 + n_steps : 16 + n_steps + n_counts])
        at = 16 + n_steps + n_counts
        for k, width in enumerate(out._remainder_widths()):
            size = -(-width // 8)
            low = np.zeros((len(quotients), 8), np.uint8)
            low[:, :size] = np.frombuffer(raw, np.uint8, size * len(quotients), at).reshape(size, len(quotients)).T
            at += size * len(quotients)
            lane = low.view("<u8").ravel().astype(np.uint64)
            out.lanes.append(lane | quotients << np.uint64(width) if k == 0 else lane)
        return out
