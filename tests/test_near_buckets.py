"""Near-duplicates anywhere: buckets that many fingerprints share are cut by further bits, with the links of brute force."""

import random

import pytest

from corpuspark.operators import chunk


def frame(spark, hashes):
    rows = [(f"c{k:05}", k % 7, h - (h >> 63 << 64)) for k, h in enumerate(hashes)]
    return spark.createDataFrame(rows, "chunk_key string, file_id long, simhash long").repartition(3)


@pytest.mark.parametrize("small, block", [(512, 2048), (8, 2048), (8, 16), (0, 3)])
def test_links_of_crowded_buckets(spark, monkeypatch, small, block):
    monkeypatch.setattr(chunk, "SMALL", small, raising=False)
    monkeypatch.setattr(chunk, "BLOCK", block)
    r = random.Random(7)
    seeds = [r.getrandbits(48) << 16 | 0xABCD for _ in range(12)] + [r.getrandbits(64) for _ in range(12)]
    hashes = [h ^ sum(1 << b for b in r.sample(range(64), r.randrange(5))) for h in seeds for _ in range(14)]
    hashes += hashes[:9]
    near = {h: sum((h ^ o).bit_count() <= 3 for o in hashes) - 1 for h in set(hashes)}
    got = chunk.near_duplicate_segments(frame(spark, hashes), within_file=False).collect()
    assert {r.chunk_key: r.n_links for r in got} == {f"c{k:05}": near[h] for k, h in enumerate(hashes)}
    assert sum(near.values()) > 1000


def test_few_pairs_of_a_crowded_band_are_compared(spark, monkeypatch):
    """1,500 fingerprints share a band and no more: they are 1.1 million pairs, of which one in a thousand or so agree on a part of the other bits."""

    def mates(radius):
        def run(batches):
            import collections

            import pyarrow as pa

            rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            sizes = collections.Counter(r[:5] for r in rows)
            columns = [[r[0] for r in rows], [r[6] for r in rows], [sizes[r[:5]] - 1 for r in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["place", "simhash", "near"])

        return run

    monkeypatch.setattr(chunk, "_near_in_cells", mates)
    r = random.Random(11)
    hashes = {r.getrandbits(48) << 16 | 0xABCD for _ in range(1500)}
    got = chunk.near_duplicate_segments(frame(spark, sorted(hashes)), within_file=False)
    assert sum(r.n_links for r in got.collect()) / 2 < 20_000
