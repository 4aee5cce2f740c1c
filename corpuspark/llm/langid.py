"""Language identification by prediction by partial matching.

For each language a byte context tree of variable order, at most ``ORDER``, is counted over training texts: every byte after its
three, two, one and no preceding bytes. The statistics are then frozen. A byte costs its exact code length by PPM with escape
method C and exclusions: in the longest context that the language has seen, a seen byte costs by its count; any other first pays
for the escape to the next shorter context, where the bytes of the longer one are excluded; below order 0 the bytes that are
left are equally likely. A text's language is the one whose tree codes it in the fewest bits; the score is that language's
posterior under equal priors. Every text is taken to follow ``ORDER`` line ends.

The trees are fitted to all texts of a language up to ``TRAIN_BYTES`` of them, else to the share with the least hashes of the text
that comes to about as much; so a tree has at most that many nodes of each order. Nothing is pruned, and whole texts are coded.

Defined results: null texts and texts without a letter are ``und`` with score 0; rows with null language or text train nothing;
ties go to the alphabetically first language; repeated rows get repeated results; an empty table gives no rows; with no
training rows all texts are ``und``; columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuspark.llm.common import in_fold, map_texts, quoted, table, unused
from corpuspark.llm.textscan import row_slices

ORDER = 3
TRAIN_BYTES = 16_000_000
PIECE = 16_384  # characters of a long text that are drawn at once
UNKNOWN = "und"
#: What precedes every text.
BEFORE = 10
CACHED_BYTES = 16_000_000


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte of each text with its ``ORDER`` predecessors, as one number; the byte itself comes last."""
    codes = np.zeros(len(data), np.uint32)
    at = np.arange(len(data), dtype=np.int64) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(ORDER, 0, -1):
        before = np.full(len(data), BEFORE, np.uint32)
        near = at >= k
        before[near] = data[np.flatnonzero(near) - k]
        codes = codes << np.uint32(8) | before
    return codes << np.uint32(8) | data


def count_grams(train: DataFrame, langs: list[str]) -> DataFrame:
    """(lang: a number, gram, n) over all rows: counted in place, then one small shuffle of partial counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: i for i, x in enumerate(langs)}
        counts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part, data, offsets in row_slices(batch):
                codes, row_langs = grams(data, offsets), np.array([number[x] for x in part.column(0).to_pylist()])
                of_byte = np.repeat(row_langs, np.diff(offsets))
                for lang in np.unique(row_langs).tolist():
                    found, n = np.unique(codes[of_byte == lang], return_counts=True)
                    if lang in counts:
                        found, where = np.unique(np.concatenate([counts[lang][0], found]), return_inverse=True)
                        n = np.bincount(where, np.concatenate([counts[lang][1], n])).astype(np.int64)
                    counts[lang] = found, n
        for lang, (found, n) in counts.items():
            columns = [pa.array(np.full(len(found), lang, np.int32)), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])

    return map_texts(train.select("lang", "text"), run, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Level:
    """One order k of a tree: its grams (context and byte) with log2 counts, and its contexts with the costs of what they code."""

    grams: np.ndarray
    bits: np.ndarray  # log2 of the count of each gram
    contexts: np.ndarray
    total: np.ndarray  # log2 of the denominator if coding starts here, by context of order k
    escape: np.ndarray  # bits of an escape from here, if coding starts here
    below_total: np.ndarray  # the same one order down with this context's bytes excluded
    below_escape: np.ndarray  # 0 where nothing is left to escape from

    def find(self, keys: np.ndarray, where: str) -> tuple[np.ndarray, np.ndarray]:
        known = getattr(self, where)
        i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return i, known[i] == keys


class Tree:
    """The frozen statistics of one language."""

    def __init__(self, codes: np.ndarray, n: np.ndarray):
        order = np.argsort(codes)
        codes, n = codes[order].astype(np.uint32), n[order]
        raw = []
        for k in range(ORDER + 1):
            mask = np.uint32((1 << 8 * (k + 1)) - 1)
            own, where = np.unique(codes & mask, return_inverse=True)
            raw.append((own, np.bincount(where, n)))
        self.levels: list[Level] = []
        self.left = 0.0  # log2 of the bytes that order 0 has not seen
        for k, (own, count) in enumerate(raw):
            contexts, at = np.unique(own >> np.uint32(8), return_inverse=True)
            kinds, total = np.bincount(at).astype(float), np.bincount(at, count)
            below_total, below_escape = np.zeros(len(contexts)), np.zeros(len(contexts))
            if k:
                shorter, short_count = raw[k - 1]
                short_context = shorter >> np.uint32(8)
                all_contexts, short_at = np.unique(short_context, return_inverse=True)
                short_kinds, short_total = np.bincount(short_at).astype(float), np.bincount(short_at, short_count)
                up = np.searchsorted(all_contexts, contexts & np.uint32((1 << 8 * (k - 1)) - 1))
                seen = short_count[np.searchsorted(shorter, own & np.uint32((1 << 8 * k) - 1))]
                rest_kinds, rest = short_kinds[up] - kinds, short_total[up] - np.bincount(at, seen)
                some = rest_kinds > 0
                below_total[some] = np.log2((rest + rest_kinds)[some])
                below_escape[some] = below_total[some] - np.log2(rest_kinds[some])
            log_total = np.log2(total + kinds)
            self.levels.append(Level(own, np.log2(count), contexts, log_total, log_total - np.log2(kinds), below_total, below_escape))
            if not k:
                self.left = float(np.log2(256 - kinds[0])) if kinds[0] < 256 else 0.0

    def code_lengths(self, codes: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each gram after the others."""
        bits, todo = np.zeros(len(codes)), np.ones(len(codes), bool)
        above: np.ndarray | None = None  # the longer context's place, whose bytes are excluded; -1 where coding hasn't begun
        for k in range(ORDER, -1, -1):
            level = self.levels[k]
            own = codes & np.uint32((1 << 8 * (k + 1)) - 1)
            context, known = level.find(own >> np.uint32(8), "contexts")
            gram, seen = level.find(own, "grams")
            began = above is not None and above >= 0
            total, escape = level.total[context], level.escape[context]
            if above is not None:
                upper = self.levels[k + 1]
                total = np.where(began, upper.below_total[above], total)
                escape = np.where(began, upper.below_escape[above], escape)
            here = todo & known & seen
            bits[here] += (total - level.bits[gram])[here]
            todo &= ~here
            bits[todo & known] += escape[todo & known]
            above = np.where(known, context, -1)
        bits[todo] += self.left
        return bits


class Model:
    """Trees by language, and what a byte costs without any context or language: order 0 over all training texts."""

    def __init__(self, trees: dict[str, Tree], pooled: np.ndarray):
        self.langs, self.trees, self.pooled = sorted(trees), trees, pooled

    @classmethod
    def freeze(cls, counted: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
        plain = np.ones(256)
        for codes, n in counted.values():
            plain += np.bincount((codes & 255).astype(np.int64), n, 256)
        return cls({lang: Tree(np.asarray(codes, np.uint32), n) for lang, (codes, n) in counted.items()}, np.log2(plain.sum()) - np.log2(plain))

    def costs(self, codes: np.ndarray) -> np.ndarray:
        """Bits of each gram's byte, one column for each language and one for no language."""
        return np.stack([*(self.trees[x].code_lengths(codes) for x in self.langs), self.pooled[codes & 255]], 1)


class Coder:
    """Code lengths of texts; the costs of recent grams are kept in a direct-mapped table of bounded size."""

    def __init__(self, model: Model):
        self.model, width = model, len(model.langs) + 1
        self.shift = 32 - max(10, min(20, int(np.log2(CACHED_BYTES / (4 * width + 4)))))
        self.keys = np.zeros(1 << (32 - self.shift), np.uint32)
        self.known = np.zeros((len(self.keys), width), np.float32)
        self.known[:] = model.costs(np.zeros(1, np.uint32))

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text, one column for each language and one for no language."""
        codes = grams(data, offsets)
        slot = (codes * np.uint32(0x9E3779B1)) >> np.uint32(self.shift)
        cost = self.known[slot]
        if len(missed := np.flatnonzero(self.keys[slot] != codes)):
            new, where = np.unique(codes[missed], return_inverse=True)
            found = self.model.costs(new).astype(np.float32)
            cost[missed] = found[where]
            at, first = np.unique((new * np.uint32(0x9E3779B1)) >> np.uint32(self.shift), return_index=True)
            self.keys[at], self.known[at] = new[first], found[first]
        sums = np.zeros((len(offsets) - 1, cost.shape[1]))
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            sums[full] = np.add.reduceat(cost, offsets[full], axis=0, dtype=np.float64)
        return sums


def train(docs: DataFrame) -> Model:
    """Trees of the languages of ``docs`` (text, lang). What reaches the driver is at most ``TRAIN_BYTES`` grams a language."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''").select("lang", "text")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}  # one row a language
    langs = sorted(sizes)
    if not langs:
        return Model({}, np.full(256, 8.0))
    large = [x for x in langs if sizes[x] > TRAIN_BYTES]
    if large:
        share = F.lit(1.0)
        for x in large:
            share = F.when(F.col("lang") == x, TRAIN_BYTES / sizes[x]).otherwise(share)
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share * 1_000_000)
    counted = count_grams(rows, langs).toArrow()
    missed = [langs.index(x) for x in large if langs.index(x) not in set(counted.column("lang").unique().to_pylist())]
    if missed:  # a few long texts, of which the draw took none: pieces of them
        few = docs.where(F.col("lang").isin([langs[i] for i in missed])).where("text IS NOT NULL").select("lang", "text")
        piece = few.select("lang", F.posexplode(F.sequence(F.lit(0), F.floor(F.length("text") / PIECE).cast("int"))).alias("k", "at"), "text")
        piece = piece.select("lang", F.xxhash64("text", "k").alias("drawn"), F.substring("text", F.col("at") * PIECE + 1, F.lit(PIECE)).alias("text")).where("text <> ''")
        for i in missed:
            own = piece.where((F.col("lang") == langs[i]) & (F.pmod("drawn", F.lit(1_000_000)) < TRAIN_BYTES / sizes[langs[i]] * 1_000_000))
            least = piece.where(F.col("lang") == langs[i]).orderBy("drawn").limit(1)
            drawn = (own.unionByName(least) if own.isEmpty() else own).select("lang", "text")
            counted = pa.concat_tables([counted, count_grams(drawn, langs).toArrow()])
    lang, codes, n = (counted.column(c).to_numpy() for c in ("lang", "gram", "n"))
    return Model.freeze({langs[i]: (codes[lang == i], n[lang == i]) for i in np.unique(lang).tolist()})


def has_letter(data: np.ndarray, offsets: np.ndarray, text_of) -> np.ndarray:
    """Which texts have a letter; ``text_of`` gives a text, where its bytes don't tell."""
    lower = data | 32
    plain = np.concatenate([[0], np.cumsum((lower >= 97) & (lower <= 122))])
    high = np.concatenate([[0], np.cumsum(data >= 128)])
    some, maybe = np.diff(plain[offsets]) > 0, np.diff(high[offsets]) > 0
    for i in np.flatnonzero(~some & maybe):
        some[i] = any(map(str.isalpha, text_of(i)))
    return some


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of docs, then lang_pred, score and saved: bits that the language saves against order 0 without a language, by
    which text in no known language shows. Underscores are added to a name that ``keep`` has. No shuffle."""
    keep = keep or ["doc_id"]
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded: see ``train``
    names = [*keep, *(unused(x, keep) for x in ("lang_pred", "score", "saved"))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, coder = shipped.value.langs, Coder(shipped.value)
        for batch in batches:
            k = batch.schema.get_field_index("text")
            for part, data, offsets in row_slices(batch):
                ok = has_letter(data, offsets, lambda i, part=part: part.column(k)[int(i)].as_py()) & bool(langs)
                best, score, saved = np.zeros(len(ok), np.int64), np.zeros(len(ok)), np.zeros(len(ok))
                if langs:
                    bits = coder.bits(data, offsets)
                    best = bits[:, :-1].argmin(1)
                    least = bits[:, :-1].min(1)
                    score = 1 / np.exp2(np.maximum(least[:, None] - bits[:, :-1], -1000)).sum(1)
                    saved = bits[:, -1] - least
                pred = [langs[b] if o else UNKNOWN for b, o in zip(best, ok, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keep)], pa.array(pred, pa.string()), pa.array(np.where(ok, score, 0.0)), pa.array(np.where(ok, saved, 0.0))], names
                )

    rows = docs.select(*quoted(keep), *([] if "text" in keep else ["text"]))
    kinds = (T.StringType(), T.DoubleType(), T.DoubleType())
    schema = T.StructType([*rows.schema.fields[: len(keep)], *(T.StructField(n, t) for n, t in zip(names[-3:], kinds, strict=True))])
    return map_texts(rows, run, schema)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = in_fold("doc_id", 4, 2)
    model = train(docs.where(~held_out))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_langid": op3_langid}
ORACLE_SQL: dict = {}
