"""Texts whose polynomial hashes modulo a power of two would be equal stay different texts."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from corpuspark.llm import bpe, jaccard, packing, textscan, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")


def _word_pair():
    """A Thue-Morse word of 1,024 letters and its complement, with a common beginning."""
    bits = [i.bit_count() % 2 for i in range(1024)]
    return ["xxxxxx" + "".join("ab"[b ^ k] for b in bits) for k in (0, 1)]


PAIR = _word_pair()


def test_span_hashes_differ():
    data = np.frombuffer("".join(PAIR).encode(), np.uint8)
    one, two = textscan.span_hashes(data, np.array([0, 1030]), np.array([1030, 2060])).tolist()
    assert one != two
    for n in range(1, 70):  # the same span anywhere, of every length around the limits of lanes
        text = np.frombuffer(b"?" + bytes(range(n)) + b"." + bytes(range(n)), np.uint8)
        a, b = textscan.span_hashes(text, np.array([1, n + 2]), np.array([n + 1, 2 * n + 2])).tolist()
        assert a == b


def test_op8_and_op10_tell_them_apart(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(PAIR)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in bpe.digest_round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()}
    assert [got[i].decoded_sha256 for i in (0, 1)] == [hashlib.sha256(t.encode()).hexdigest() for t in PAIR]
    pieces = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert len(pieces) == len({(r.doc_id, r.ids_crc32) for r in pieces}) and len({r.ids_crc32 for r in pieces}) > 1
    assert {r.ids_crc32 for r in pieces if r.doc_id == 0} != {r.ids_crc32 for r in pieces if r.doc_id == 1}


def test_op5_and_op7_tell_them_apart(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(PAIR)], "doc_id long, text string")
    assert [r.n_links for r in jaccard.near_duplicates(docs).collect()] == [0, 0]
    _, _, features = toxicity.word_features(*textscan.utf8(pa.array(PAIR)))
    doc, words = next(features)
    assert doc.tolist() == [0, 1] and words[0] != words[1]


def test_the_table_compares_bytes():
    calls = []

    def encode(pieces):
        calls.append(pieces)
        ids = np.array([int.from_bytes(p[-4:], "little") for p in pieces], np.uint32)
        return ids, np.arange(len(ids)), np.ones(len(ids), np.int64)

    table = bpe.PieceTable(encode, 16)
    texts = ["word", "other", "word", "a" * 40, "a" * 39 + "b", "a" * 40]
    for _ in range(3):
        ids, at = table.ids_of(*textscan.utf8(pa.array(texts)))
        assert ids.tolist() == [int.from_bytes(t.encode()[-4:], "little") for t in texts]
        assert at.tolist() == list(range(7))
