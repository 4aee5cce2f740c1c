"""Document fingerprints by SimHash, with DataFrame functions only.

Terms are pairs of adjacent lower-cased words; a term weighs 1 to 4 by its length and once for each occurrence. Each
term's 128 hash bits vote with its weight; a fingerprint bit is set if the votes for it exceed half of all weight. Votes
are summed two to a long (32 bits each), so a fingerprint is 64 sums of one hash aggregate that needs no shuffle of words.

``near_counts`` finds all fingerprints within the Hamming radius by permuted block tables: of eight blocks of 16 bits, two
fingerprints that differ in at most six bits agree on two whole blocks, so a table for each pair of blocks (28 tables, keys of 32
bits) misses none. Large buckets are compared in pairs of parts of bounded size, without emitting pairs. A radius of six is what
one changed word in about two hundred makes on average; an edit of one word in a hundred differs by about nine bits.

Defined results: null text counts as empty; a text without words has the zero fingerprint; a single word is its own term;
equal texts have equal fingerprints; repeated rows of an id follow each other in the order of their text; the document after the
last is the first; a single document is its own next one; rows without an id stand outside the order and are followed by the
first document (by an empty text if no row has an id); an empty table gives no rows; columns other than the named ones are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuspark.llm.common import afresh, stored, table, text_or_empty

BITS = 128
RADIUS = 6
BLOCKS = 8
ROWS_PER_RANGE = 500
MOST_RANGES = 1_000_000
NAMELESS_RANGES = 10_000
BUCKET_PART = 128
LANES = "4294967297L"  # the lowest bit of each half of a long


def terms(text: str) -> Column:
    """Array of (h, w): 64-bit hash and weight of each pair of adjacent words of the column named ``text``."""
    pair = "transform(sequence(1, size({w}) - 1), i -> struct(xxhash64({w}[i - 1], {w}[i]) AS h, least(4, 1 + int((length({w}[i - 1]) + length({w}[i])) / 6)) AS w))"
    one = "array(struct(xxhash64({w}[0]) AS h, 1 AS w))"
    words = f"split({text}, '\\\\s+')"
    return F.expr(
        f"transform(array({words}), ws -> CASE WHEN size(ws) > 1 THEN {pair.format(w='ws')} WHEN ws[0] <> '' THEN {one.format(w='ws')} END)[0]"
    )


def votes() -> list[Column]:
    """64 sums of two lanes each over the exploded columns h and w, and the weight of all."""
    sums = []
    for half, h in enumerate(("h", "xxhash64(h)")):
        sums += [F.expr(f"sum((shiftrightunsigned({h}, {k}) & {LANES}) * w)").alias(f"v{half}_{k}") for k in range(32)]
    return [*sums, F.expr("sum(w)").alias("weight")]


def fingerprint_bits(half: int) -> Column:
    """The long of 64 bits whose votes exceed half of the weight."""
    bit = lambda votes, at: f"if(2 * ({votes}) > weight, shiftleft(1L, {at}), 0L)"
    parts = [bit(f"v{half}_{k} & 4294967295L", k) for k in range(32)] + [bit(f"shiftrightunsigned(v{half}_{k}, 32)", k + 32) for k in range(32)]
    return F.coalesce(F.expr(" | ".join(parts)), F.lit(0).cast("long"))


def as_text(high: str, low: str) -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(c)), 16, "0") for c in (high, low)))


def fingerprints(texts: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, f0, f1) of each row's ``column``; without a shuffle where the rows are already partitioned by some of ``keys``."""
    return (
        texts.select(*keys, terms(column).alias("terms"))
        .select(*keys, F.explode_outer("terms").alias("t"))
        .select(*keys, F.col("t.h").alias("h"), F.col("t.w").cast("long").alias("w"))
        .groupBy(*keys)
        .agg(*votes())
        .select(*keys, fingerprint_bits(0).alias("f0"), fingerprint_bits(1).alias("f1"))
    )


def likeness(a: str, b: str) -> Column:
    """The share of equal bits of the fingerprints (a0, a1) and (b0, b1)."""
    return F.expr(f"1 - (bit_count({a}0 ^ {b}0) + bit_count({a}1 ^ {b}1)) / {BITS}.0D")


def ranges(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> Bucketizer | None:
    """A cut of the ids into ranges of about equal numbers of documents, however the ids lie: bounds are the ids that a hash picks, at
    most about ``MOST_RANGES`` longs. None where there are no ids."""
    n = docs.where("doc_id IS NOT NULL").count()
    every = max(rows_per_range, n // MOST_RANGES)
    picked = docs.where("doc_id IS NOT NULL").where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    bounds = sorted({float(r.doc_id) for r in picked.select("doc_id").distinct().collect()})  # ids that are equal as doubles share a range
    return Bucketizer(splits=[-float("inf"), *bounds, *([float("inf")] if bounds else [0.0, float("inf")])], inputCol="place", outputCol="range") if n else None


def with_next(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(range, nth, doc_id, text, next_id, next_text): every document beside the following one.

    Each range of ids is ordered for itself; the first document of a range also closes the range before it. Only the ranges' first ids
    are ordered together. Rows without an id get negative ranges and their own order only to be told apart.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    named, nameless = rows.where("doc_id IS NOT NULL"), rows.where("doc_id IS NULL")
    cut = ranges(docs, rows_per_range)
    if cut is None:
        lone = nameless.select(F.lit(-1).cast("long").alias("range"), F.monotonically_increasing_id().alias("nth"), "doc_id", "text")
        return lone.select("*", F.col("doc_id").alias("next_id"), F.lit("").alias("next_text"))
    # As a whole number: of a double, Spark deals out a normalised form, and would deal the rows out again for what is grouped by it.
    in_range = lambda df: cut.transform(df.withColumn("place", F.col("doc_id").cast("double"))).drop("place").withColumn("range", F.col("range").cast("long"))
    ranged = in_range(named)
    firsts = in_range(docs.where("doc_id IS NOT NULL").select("doc_id")).groupBy("range").agg(F.min("doc_id").alias("first_id"))
    closes = firsts.select("first_id", F.lag("range").over(Window.orderBy("range")).alias("before"), F.max("range").over(Window.partitionBy(F.lit(1))).alias("last"))
    closes = closes.select("first_id", F.coalesce("before", "last").alias("range"), F.col("before").isNull().alias("is_first"))  # one row a range
    ghosts = stored(
        named.join(F.broadcast(closes), F.col("doc_id") == F.col("first_id")).groupBy("range", "doc_id", "is_first").agg(F.min("text").alias("text")), "firsts"
    )
    order = Window.partitionBy("range").orderBy("ghost", "doc_id", "text")
    # Rows without an id go to ranges of their own by hash. Everything is in its range before the one exchange, so that what follows needs none.
    salted = nameless.withColumn("range", -1 - F.pmod(F.xxhash64("text"), F.lit(NAMELESS_RANGES)))
    first = ghosts.where("is_first").select(F.lit(True).alias("outside"), F.col("doc_id").alias("first_id"), F.col("text").alias("first_text"))  # one row
    ordered = (
        ranged.unionByName(salted)
        .withColumn("ghost", F.lit(0))
        .unionByName(ghosts.select("doc_id", "text", "range", F.lit(1).alias("ghost")))
        .select(
            "range",
            F.row_number().over(order).cast("long").alias("nth"),
            "doc_id",
            "text",
            "ghost",
            F.lead("doc_id").over(order).alias("lead_id"),
            F.lead("text").over(order).alias("lead_text"),
            F.col("doc_id").isNull().alias("no_id"),
        )
        .where("ghost = 0")
        .join(F.broadcast(first), F.col("no_id") == F.col("outside"), "left")
    )
    nxt = lambda a, b: F.when(F.col("no_id"), F.col(a)).otherwise(F.col(b))
    return ordered.select("range", "nth", "doc_id", "text", nxt("first_id", "lead_id").alias("next_id"), nxt("first_text", "lead_text").alias("next_text"))


def near_counts(prints: DataFrame, radius: int = RADIUS, part_size: int = BUCKET_PART) -> DataFrame:
    """(f0, f1, n_near) of distinct fingerprints (f0, f1, n): documents of other fingerprints within ``radius``, if any."""
    agree = BLOCKS - radius  # so many whole blocks at least
    if agree < 1:
        raise ValueError(f"{BLOCKS} blocks find radii below {BLOCKS}")
    size = BITS // BLOCKS
    per_half = 64 // size
    block = lambda p, k: f"(shiftrightunsigned({p}f{k // per_half}, {k % per_half * size}) & {(1 << size) - 1}L)"
    choices = list(combinations(range(BLOCKS), agree))
    key = lambda ks: " | ".join(f"shiftleft({block('', k)}, {i * size})" for i, k in enumerate(ks))
    if agree * size > 63:
        key = lambda ks: f"xxhash64({', '.join(block('', k) for k in ks)})"
    tables = ", ".join(f"struct({t} AS t, {key(ks)} AS block)" for t, ks in enumerate(choices))
    keyed = prints.withColumn("b", F.explode(F.expr(f"array({tables})"))).select("b.t", "b.block", "f0", "f1", "n")
    crowded = keyed.groupBy("t", "block").agg(F.count("*").alias("size")).where("size > 1")
    crowded = crowded.select(afresh("t").alias("of_t"), afresh("block").alias("of_block"), "size")  # names of its own: a large bucket can be split
    parts = F.ceil(F.col("size") / part_size).cast("int")
    # Never broadcast: Spark takes the exploded tables for no larger than the fingerprints that they come from.
    placed = keyed.hint("merge").join(crowded, (F.col("t") == F.col("of_t")) & (F.col("block") == F.col("of_block")))
    placed = placed.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("f0", "f1"), "parts").cast("int"))
    cells = (
        placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .groupBy("t", "block", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
        .agg(F.collect_list(F.struct("f0", "f1", "n", "part")).alias("members"))
    )
    # A pair is counted in the table of its first agreeing blocks alone.
    same = lambda k: f"({block('x.', k)} = {block('y.', k)})"
    whole = " + ".join(f"if({same(k)}, {1 << k}, 0)" for k in range(BLOCKS))
    first = {}
    for mask in range(1 << BLOCKS):
        ks = tuple(k for k in range(BLOCKS) if mask >> k & 1)[:agree]
        first[mask] = choices.index(ks) if len(ks) == agree else -1
    table_of = f"element_at(array({', '.join(str(first[m]) for m in range(1 << BLOCKS))}), 1 + {whole})"
    apart = f"bit_count(x.f0 ^ y.f0) + bit_count(x.f1 ^ y.f1) BETWEEN 1 AND {radius}"
    near = f"aggregate(members, 0L, (s, y) -> s + if({apart} AND (i = j OR x.part <> y.part) AND t = {table_of}, y.n, 0L))"
    found = cells.select(F.explode(F.expr(f"transform(members, x -> struct(x.f0 AS f0, x.f1 AS f1, {near} AS n_near))")).alias("x"))
    return found.where("x.n_near > 0").groupBy("x.f0", "x.f1").agg(F.sum("x.n_near").alias("n_near"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, their likeness and that to the next document, and how many others are near."""
    sides = with_next(docs.select("doc_id", "text"), ROWS_PER_RANGE).withColumn("n_chars", F.length("text").cast("long")).withColumn("half", F.expr("int(n_chars div 2)"))
    edited = F.expr("concat(left(text, int(n_chars) - half), left(next_text, half))")
    both = (
        sides.withColumn("edited", edited)
        .select("range", "nth", "doc_id", "next_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.expr("lower(text)").alias("a"), F.expr("lower(edited)").alias("b"))
        .select("range", "nth", "doc_id", "next_id", "n_chars", "edited_sha256", F.explode(F.expr("array(struct(0 AS kind, a AS text), struct(1 AS kind, b AS text))")).alias("v"))
        .select("range", "nth", "doc_id", "next_id", "n_chars", "edited_sha256", "v.kind", "v.text")
    )
    keys = ["range", "nth", "doc_id", "next_id", "n_chars", "edited_sha256", "kind"]
    votes_of = fingerprints(both, keys, "text")
    side = lambda k, f: F.max(F.when(F.col("kind") == k, F.col(f)))
    rows = stored(
        votes_of.groupBy(*keys[:-1]).agg(side(0, "f0").alias("f0"), side(0, "f1").alias("f1"), side(1, "f0").alias("e0"), side(1, "f1").alias("e1")).drop("range"),
        "fingerprints",
    )
    following = rows.select(F.col("doc_id").alias("next_id"), "nth", F.col("f0").alias("n0"), F.col("f1").alias("n1"))
    following = following.where("next_id IS NOT NULL").groupBy("next_id").agg(F.min_by(F.struct("n0", "n1"), "nth").alias("next"))
    following = following.select(afresh("next_id").alias("following_id"), "next.n0", "next.n1")
    prints = stored(rows.groupBy("f0", "f1").agg(F.count("*").alias("n")), "prints")
    near = prints.join(near_counts(prints, RADIUS, BUCKET_PART), ["f0", "f1"], "left")
    # Names of their own: the many documents of one fingerprint, or before one document, can be split.
    near = near.select(afresh("f0").alias("p0"), afresh("f1").alias("p1"), (F.col("n") - 1 + F.coalesce("n_near", F.lit(0))).alias("n_near"))
    none = F.lit(0).cast("long")  # the fingerprint of an empty text
    return (
        rows.join(following, F.col("next_id") == F.col("following_id"), "left")
        .withColumns({"n0": F.coalesce("n0", none), "n1": F.coalesce("n1", none)})
        .join(near, (F.col("f0") == F.col("p0")) & (F.col("f1") == F.col("p1")))
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            as_text("f1", "f0").alias("fingerprint"),
            as_text("e1", "e0").alias("edited_fingerprint"),
            likeness("f", "e").alias("near_edited"),
            likeness("f", "n").alias("near_next"),
            "n_near",
        )
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op9_simhash": op9_simhash}
ORACLE_SQL: dict = {}
