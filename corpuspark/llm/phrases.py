"""Phrase collocation mining by counting quotient filters.

Three passes over the texts. The first counts words; those with enough occurrences get a number within their language. The second counts
pairs of neighbouring words, the third phrases of three to five words all of whose pairs are frequent (a phrase occurs no more often than
any part of it, so nothing is lost). Each task packs its n-grams of word numbers into counting quotient filters; filters are cut into
ranges of quotients, and the sorted filters of a range are merged across tasks. A frequent phrase is one counter, in whatever number of rows
it occurs, so no task has more than its range. Scores, cuts and the dropping of parts of longer phrases are joins of the frequent phrases.

The word numbers are broadcast where they take less than ``DICTIONARY_BYTES``; else each text gets the numbers of its own words by a join.
The third pass knows frequent pairs by a bitmap of at most ``MOST_BITS`` bits; pairs that share a bit only cost some counters more.

Defined results: null texts have no words; null languages are ``und``, together with rows that say so; a piece without words and texts of
any length are whole; repeated rows count each time; ties go as the contract orders them; an empty table gives no rows; columns other
than lang and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuspark.llm.common import afresh, map_texts, stored, table
from corpuspark.llm.quotient import PackedGrams, QuotientFilter
from corpuspark.llm.textscan import mix, row_slices, spans

LEAST = 100
LONGEST = 5
TOP = 2000
SLICE_BYTES = 2_000_000
DICTIONARY_BYTES = 16 << 20
GRAMS_OF_RANGE = 1 << 23
GRAMS_AT_ONCE = 1 << 20
LEAST_BITS, MOST_BITS, BITS_FOR_PAIR = 1 << 20, 1 << 27, 16
WORDS_OF_BUCKET = 1_000_000

_PIECE = np.zeros(256, bool)
_PIECE[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_APART = _PIECE.copy()
_APART[[9, 32]] = True


class Words:
    """The words of a slice of rows: ``codes`` into ``distinct`` (bytes), the row and the piece of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        text = np.full(len(data) + n, 10, np.uint8)  # texts are pieces of their own
        text[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = data
        text[(text >= 65) & (text <= 90)] += 32
        inside = ~_APART[text]
        starts, ends = spans(inside)
        self.row = np.searchsorted(offsets[:-1] + np.arange(n), starts, "right") - 1
        self.piece = np.cumsum(_PIECE[text], dtype=np.int64)[starts]
        edges = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        buffers = [None, pa.py_buffer(edges), pa.py_buffer(text[inside])]
        encoded = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
        self.codes, self.distinct = encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray, Words]]:
    """(rows, languages, number of each row's language, words)."""
    for batch in batches:
        for part, data, offsets in row_slices(batch, size=SLICE_BYTES):
            lang = part.column(part.schema.get_field_index("lang")).dictionary_encode()
            yield part, lang.dictionary.to_pylist(), lang.indices.to_numpy(zero_copy_only=False), Words(data, offsets)


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, f) of all words, and a row without a word for each language: the number of all its words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, langs, lang_of, words in _slices(batches):
            size = max(1, len(words.distinct))
            of_word = lang_of[words.row]
            keys, n = np.unique(of_word.astype(np.int64) * size + words.codes, return_counts=True)
            all_of = np.bincount(of_word, minlength=len(langs))
            named = words.distinct.take(pa.array(keys % size)).cast(pa.large_string()).cast(pa.string())
            langs = pa.array(langs, pa.string())
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(keys // size)), named, pa.array(n, pa.int64())], ["lang", "word", "n"])
            yield pa.RecordBatch.from_arrays([langs, pa.nulls(len(langs), pa.string()), pa.array(all_of, pa.int64())], ["lang", "word", "n"])

    return map_texts(texts, run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))


def numbered(words: DataFrame) -> DataFrame:
    """(lang, word, f, id): ids from 0 within each language, nearly gapless. Large languages are numbered in several buckets at once."""
    sizes = words.groupBy("lang").agg((F.floor(F.count("*") / WORDS_OF_BUCKET) + 1).alias("buckets")).select(F.col("lang").alias("of"), "buckets")
    dealt = words.join(sizes, F.col("lang") == F.col("of")).withColumn("bucket", F.pmod(F.xxhash64("word"), F.col("buckets")))
    nth = F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(F.desc("f"), "word"))
    return dealt.select("lang", "word", "f", ((nth - 1) * F.col("buckets") + F.col("bucket")).alias("id"))


def with_vocabulary(texts: DataFrame, words: DataFrame) -> DataFrame:
    """The texts with ``vocabulary``, the numbers of their own frequent words: the way for dictionaries that are too large to broadcast."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _, words in _slices(batches):
            size = max(1, len(words.distinct))
            keys = np.unique(words.row.astype(np.int64) * size + words.codes)
            row = pa.array(keys // size)
            named = words.distinct.take(pa.array(keys % size)).cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), named], ["lang", "digest", "word"])

    keyed = texts.select("lang", F.sha2("text", 256).alias("digest"), "text")
    own = map_texts(keyed, run, "lang string, digest string, word string").distinct()
    known = words.select(F.col("lang").alias("of"), F.col("word").alias("w"), "id")
    own = own.join(known, (F.col("lang") == F.col("of")) & (F.col("word") == F.col("w"))).groupBy("lang", "digest").agg(F.collect_list(F.struct("word", "id")).alias("vocabulary"))
    own = own.select(F.col("lang").alias("of"), F.substring("digest", 1, 64).alias("d"), "vocabulary")  # dealt anew: many copies can be split
    return keyed.join(own, (F.col("lang") == F.col("of")) & (F.col("digest") == F.col("d"))).select("lang", "text", "vocabulary")


def _lookup(broadcast) -> Callable[[pa.RecordBatch], dict]:
    """The word numbers by language that hold for a slice."""
    if broadcast is not None:
        return lambda part: broadcast.value

    def own(part: pa.RecordBatch) -> dict:
        found: dict = {}
        for lang, vocabulary in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
            found.setdefault(lang, {}).update((v["word"].encode(), v["id"]) for v in vocabulary)
        return found

    return own


def _pair_marks(lang: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A number below 2**62 for each pair of words of a language."""
    of = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
    return (mix(mix(first.astype(np.uint64) + of) + second.astype(np.uint64)) >> np.uint64(2)).astype(np.int64)


def gram_counts(texts: DataFrame, languages: dict[str, tuple[int, int]], sizes: tuple[int, ...], broadcast, pairs: np.ndarray | None, least: int) -> DataFrame:
    """(lang, ids, f, mark) of the n-grams of these sizes with ``least`` occurrences or more.

    ``languages``: (bits of a word number, number of words) of each. ``pairs``: bits of the frequent pairs' marks; where given, only n-grams of
    such pairs count. ``mark`` is that of a pair, null for others.
    """
    known = _lookup(broadcast)

    def shape(lang: str, n: int) -> tuple[PackedGrams, int, int]:
        """(packing, quotient bits, range bits): the same in every task."""
        bits, words = languages[lang]
        return PackedGrams(n, bits), max(8, words.bit_length() - 4), (words // GRAMS_OF_RANGE).bit_length()

    def filters(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[QuotientFilter]] = {}
        n_held = 0

        def ranges() -> Iterator[pa.RecordBatch]:
            for (lang, n), parts in held.items():
                bits = shape(lang, n)[2]
                for k, piece in QuotientFilter.merged(parts).ranges(bits):
                    yield pa.RecordBatch.from_pylist([{"lang": lang, "n": n, "range": k, "filter": piece.dump()}], SCHEMA)
            held.clear()

        for part, langs, lang_of, words in _slices(batches):
            numbers = known(part)
            distinct = words.distinct.to_pylist()
            of_word = lang_of[words.row]
            for k, lang in enumerate(langs):
                here = np.flatnonzero(of_word == k)
                own = numbers.get(lang, {})
                if lang not in languages or not own:
                    continue
                codes, piece = words.codes[here], words.piece[here]
                used = np.unique(codes)
                id_of = np.full(len(distinct), -1, np.int64)
                id_of[used] = [own.get(distinct[c], -1) for c in used.tolist()]
                ids = id_of[codes]
                joined = (ids[:-1] >= 0) & (ids[1:] >= 0) & (piece[:-1] == piece[1:])
                if pairs is not None:
                    at = np.flatnonzero(joined)
                    slot = _pair_marks(lang, ids[at], ids[at + 1]) & (8 * len(pairs) - 1)
                    joined[at] = pairs[slot >> 3] >> (slot & 7).astype(np.uint8) & 1
                for n in sizes:
                    run = joined[: max(0, len(ids) - n + 1)].copy()
                    for j in range(1, n - 1):
                        run &= joined[j : j + len(run)]
                    at = np.flatnonzero(run)
                    if len(at):
                        packing, quotient, _ = shape(lang, n)
                        found = QuotientFilter.of(packing, quotient, [ids[at + j] for j in range(n)])
                        held.setdefault((lang, n), []).append(found)
                        n_held += len(found)
            if n_held > GRAMS_AT_ONCE:
                yield from ranges()
                n_held = 0
        yield from ranges()

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].as_py(), b.column(3)[i]) for b in batches for i in range(b.num_rows))
        for (lang, n, _), group in groupby(rows, key=lambda r: r[:3]):
            packing, quotient, _ = shape(lang, n)
            waiting, size, merged = [], 0, 0
            for *_, raw in group:
                waiting.append(QuotientFilter.load(packing, quotient, raw.as_py()))
                size += len(waiting[-1])
                if size > 2 * merged + GRAMS_AT_ONCE:
                    waiting = [QuotientFilter.merged(waiting)]
                    size = merged = len(waiting[0])
            ids, f = QuotientFilter.merged(waiting).at_least(least)
            if len(f):
                flat = pa.array(np.stack(ids, 1).ravel())
                grams = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * n), flat)
                mark = pa.array(_pair_marks(lang, *ids)) if n == 2 else pa.nulls(len(f), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(f), pa.string()), grams, pa.array(f), mark], ["lang", "ids", "f", "mark"])

    shards = map_texts(texts, filters, "lang string, n int, range long, filter binary")
    dealt = shards.repartition("lang", "n", "range").sortWithinPartitions("lang", "n", "range")
    return dealt.mapInArrow(merge, "lang string, ids array<long>, f long, mark long")


SCHEMA = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("range", pa.int64()), ("filter", pa.binary())])


def pair_bitmap(pairs: DataFrame) -> np.ndarray:
    """The bits of the pairs' marks, at most ``MOST_BITS`` of them, whatever the number of pairs."""
    bits, n = LEAST_BITS, pairs.count()
    while bits < min(MOST_BITS, n * BITS_FOR_PAIR):
        bits *= 2
    slot = F.col("mark").bitwiseAND(bits - 1)
    rows = pairs.groupBy(F.floor(slot / 32768).alias("part")).agg(F.bitmap_construct_agg(F.pmod(slot, F.lit(32768))).alias("bitmap")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(r.bitmap, np.uint8)
    return out


def frequent(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases: lang, ids, f; words: lang, word, f, id; totals: lang, n), words among the phrases as such of one word."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").where(F.col("text").isNotNull())
    counts = stored(word_counts(texts).where((F.col("f") >= least) | F.col("word").isNull()), "words")
    totals = counts.where("word IS NULL").select("lang", F.col("f").alias("n"))
    words = stored(numbered(counts.where("word IS NOT NULL")), "numbers")
    shape = words.groupBy("lang").agg(F.max("id").alias("last"), F.sum(F.octet_length("word") + F.octet_length("lang") + 8).alias("bytes")).join(totals, "lang").collect()
    languages = {r.lang: (max(1, r["last"].bit_length()), r.n) for r in shape}
    broadcast = None
    if sum(r.bytes for r in shape) <= DICTIONARY_BYTES:
        numbers: dict = {lang: {} for lang in languages}
        for r in words.select("lang", "word", "id").toLocalIterator():
            numbers[r.lang][r.word.encode()] = r.id
        broadcast = spark.sparkContext.broadcast(numbers)
    else:
        texts = stored(with_vocabulary(texts, words), "vocabularies")
    pairs = stored(gram_counts(texts, languages, (2,), broadcast, None, least), "pairs")
    longer = stored(gram_counts(texts, languages, tuple(range(3, LONGEST + 1)), broadcast, pair_bitmap(pairs), least), "phrases")
    single = words.select("lang", F.array("id").alias("ids"), "f")
    return single.unionByName(pairs.drop("mark")).unionByName(longer.drop("mark")), words, totals


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of two to five words by their weakest cut."""
    phrases, words, totals = frequent(docs, least)
    several = phrases.where(F.size("ids") > 1)
    inner = several.where(F.size("ids") > 2).select("lang", "f", F.explode(F.array(F.expr("slice(ids, 1, size(ids) - 1)"), F.expr("slice(ids, 2, size(ids) - 1)"))).alias("ids"))
    # A longer phrase around it that occurs as often has such a one of one word more in it, so these suffice.
    longest = inner.groupBy("lang", "ids").agg(F.max("f").alias("around"))
    candidates = several.join(longest, ["lang", "ids"], "left").where(F.col("around").isNull() | (100 * F.col("around") < 100 * F.col("f"))).drop("around")
    cuts = candidates.withColumn("k", F.explode(F.expr("sequence(1, size(ids) - 1)")))
    cuts = cuts.withColumn("left", F.expr("slice(ids, 1, k)")).withColumn("right", F.expr("slice(ids, k + 1, size(ids) - k)"))
    part = lambda side, f: phrases.select(F.col("lang").alias(f"{side}_of"), F.col("ids").alias(f"{side}_ids"), F.col("f").alias(f))
    for side, f in (("left", "l"), ("right", "r")):
        cuts = cuts.join(part(side, f), (F.col("lang") == F.col(f"{side}_of")) & (F.col(side) == F.col(f"{side}_ids"))).drop(side, f"{side}_of", f"{side}_ids")
    scored = cuts.join(totals, "lang").withColumn("score", F.expr("CAST(1000 * CAST(f AS DECIMAL(18, 0)) AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0)) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"))
    weakest = scored.groupBy("lang", "ids", F.col("f").alias("a"), "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rows = weakest.select("lang", "ids", "a", "n", "cut.score", "cut.l", "cut.r")
    spelled = rows.select("lang", "ids", F.posexplode("ids").alias("pos", "id")).join(words.select(F.col("lang").alias("of"), afresh("id").alias("number"), "word"), (F.col("lang") == F.col("of")) & (F.col("id") == F.col("number")))
    spelled = spelled.groupBy("lang", "ids").agg(F.concat_ws(" ", F.expr("transform(array_sort(collect_list(struct(pos, word))), x -> x.word)")).alias("phrase"))
    named = rows.join(spelled, ["lang", "ids"])
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op12_phrases": op12_phrases}
ORACLE_SQL = {
    "op12_phrases": r"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, generate_subscripts(p, 1) AS piece, unnest(p) AS piece_text
  FROM (SELECT lang, doc_id, string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents) d),
lists AS (SELECT lang, list_filter(string_split_regex(piece_text, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists WHERE len(w) > 0),
grams AS (SELECT lang, k, w[i:i + k - 1] AS g FROM starts, (SELECT unnest([1, 2, 3, 4, 5]) AS k) s WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, array_to_string(g, ' ') AS phrase, g, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidate AS (SELECT * FROM f WHERE k > 1 AND f >= 100),
alone AS (SELECT * FROM candidate c WHERE NOT EXISTS (SELECT 1 FROM candidate d WHERE d.lang = c.lang AND d.k > c.k AND 100 * d.f >= 100 * c.f AND contains(concat(' ', d.phrase, ' '), concat(' ', c.phrase, ' ')))),
cut AS (SELECT c.lang, c.phrase, c.f AS a, x.k AS place, c.g[1:x.k] AS head, c.g[x.k + 1:] AS tail FROM alone c, (SELECT unnest([1, 2, 3, 4]) AS k) x WHERE x.k < c.k),
scored AS (
  SELECT cut.lang, cut.phrase, a, p.f AS l, q.f AS r, n, (1000::HUGEINT * a * n // (p.f::HUGEINT * q.f))::BIGINT AS score,
    row_number() OVER (PARTITION BY cut.lang, cut.phrase ORDER BY 1000::HUGEINT * a * n // (p.f::HUGEINT * q.f), place) AS nth
  FROM cut JOIN f p ON p.lang = cut.lang AND p.g = head JOIN f q ON q.lang = cut.lang AND q.g = tail JOIN total t ON t.lang = cut.lang),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM scored WHERE nth = 1)
SELECT * FROM ranked WHERE rank <= 2000"""
}
