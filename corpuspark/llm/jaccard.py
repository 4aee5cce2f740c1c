"""N-gram Jaccard join by MinHash banding.

Every text's set of word five-grams gets a MinHash signature; band and row counts follow from the target recall at the
threshold. Texts with equal sets are one class, so that copies, however many, are compared once. Classes that share a band hash
are joined by star edges to the first of the bucket, so buckets of any size give linearly many rows. Within each connected set
of candidates every pair of classes is then compared on the full n-gram sets; large candidate sets are cut into pairs of blocks
of bounded size, each a task's small piece of work.

Defined results: words are runs of non-white-space of the lower-cased text; a text of one to four words has a single n-gram
of all of them; null texts and texts without words link with nothing; texts with equal sets link with each other; repeated rows
of an id are one document; an id with several texts has the links of all of them, each text's counted, and the least of their
classes and groups; rows without an id are one document for each different set (and one for all without words), which takes
class_id and group_id from the ids it is grouped with and is kept if there are none and it is the group's first; ties of
similarity don't matter; an empty table gives no rows; columns other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuspark.llm.common import IdFilter, afresh, kind_of, map_texts, stored, table
from corpuspark.llm.components import cells, components, links_of_cell
from corpuspark.llm.textscan import mix, row_slices, shingles, words

GRAM = 5
THRESHOLD = (4, 5)  # 0.8 as a fraction: comparisons stay in whole numbers
RECALL = 0.9999
HASHES = 192
BLOCK_SETS = 256
BLOCK_GRAMS = 400_000


def choose_bands(threshold: float = THRESHOLD[0] / THRESHOLD[1], recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding of ``hashes`` values that finds a pair at the threshold with that probability."""
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            return bands, rows
    raise ValueError("too few hashes for this recall")


def gram_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct five-gram hashes, sorted."""
    grams, at = shingles(*words(data, offsets), GRAM)
    return [np.unique(grams[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, grams, digest of the set, bands) for every text with words. No shuffle."""
    bands, rows = choose_bands()
    random = np.random.default_rng(7)
    times = (random.integers(0, 1 << 31, bands * rows, np.uint32) << np.uint32(1)) | np.uint32(1)
    plus = random.integers(0, 1 << 32, bands * rows, np.uint32)
    weights = random.integers(0, 1 << 63, (bands, rows), np.uint64) | np.uint64(1)

    def minima(grams: np.ndarray) -> np.ndarray:
        x = (grams >> np.uint64(32)).astype(np.uint32)
        out = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
        for a in range(0, len(x), 512):
            np.minimum(out, (x[a : a + 512, None] * times + plus).min(0), out=out)
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in row_slices(batch):
                sets = gram_sets(data, offsets)
                some = [i for i, s in enumerate(sets) if len(s)]
                if not some:
                    continue
                signature = np.stack([minima(sets[i]) for i in some]).reshape(len(some), bands, rows).astype(np.uint64)
                keys = mix((signature * weights).sum(2) + np.arange(bands, dtype=np.uint64)).view(np.int64)
                ends = pa.array(np.arange(len(some) + 1, dtype=np.int32) * bands)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(some)),
                        pa.array([len(sets[i]) for i in some], pa.int64()),
                        pa.array([set_digest(sets[i]) for i in some], pa.binary()),
                        pa.ListArray.from_arrays(ends, pa.array(keys.ravel())),
                    ],
                    ["doc_id", "grams", "digest", "bands"],
                )

    texts = docs.select("doc_id", F.lower("text").alias("text")).where(F.col("text").isNotNull())
    return map_texts(texts, run, f"doc_id {kind_of(docs, 'doc_id')}, grams long, digest binary, bands array<long>")


def set_digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def candidate_sets(classes: DataFrame) -> DataFrame:
    """(node, component): classes (rep, bands) connected by shared band hashes."""
    keyed = classes.select("rep", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most")
    shared = shared.select(afresh("key").alias("bucket"), "least")  # a name of its own: the join of a large bucket can be split
    return components(keyed.join(shared, F.col("key") == F.col("bucket")).where("rep > least"), "rep", "least")


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs, a few thousand n-grams at a time."""
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    grams = np.concatenate(sets)
    order = np.argsort(grams, kind="stable")
    first = np.ones(len(grams), bool)
    first[1:] = grams[order][1:] != grams[order][:-1]
    number = np.cumsum(first) - 1
    several = np.bincount(number)[number] > 1  # a gram of one set adds to no pair
    who, (_, column) = owner[order][several], np.unique(number[several], return_inverse=True)
    out = np.zeros((len(sets), len(sets)), np.float32)
    ends = np.searchsorted(column, np.arange(0, column[-1] + 4097, 4096)) if len(column) else [0]
    for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        has = np.zeros((len(sets), 4096), np.float32)
        has[who[a:b], column[a:b] - 4096 * k] = 1
        out += has @ has.T
    return out.astype(np.int64)


def _links_of_cell(rows: list[tuple], across: bool) -> list[tuple[int, int, int]]:
    """``links_of_cell`` of the rows (block, rep, n, grams)."""
    rows = list({r[1]: r for r in rows}.values())
    ids = np.array([r[1] for r in rows])
    if len(ids) < 2:
        return []
    sets = [np.frombuffer(r[3], np.uint64) for r in rows]
    sizes, weight, block = np.array([len(s) for s in sets]), np.array([r[2] for r in rows]), np.array([r[0] for r in rows])
    both = _intersections(sets)
    linked = THRESHOLD[1] * both >= THRESHOLD[0] * (sizes[:, None] + sizes - both)
    return links_of_cell(ids, weight, block, linked, across)


def verified_links(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(rep, least, links) by cell from classes (component, rep, digest, first_id, n, grams): each pair of a component is compared once."""
    sized = candidates.groupBy("component").agg(F.count("*").alias("n_classes"), F.sum("grams").alias("n_grams")).where("n_classes > 1")
    n_blocks = F.ceil(F.greatest(F.col("n_classes") / BLOCK_SETS, F.col("n_grams") / BLOCK_GRAMS)).cast("int")
    todo = candidates.join(sized, "component").withColumn("blocks", n_blocks).select("component", "rep", "digest", F.col("first_id").alias("doc_id"), "n", "blocks")
    todo = stored(todo, "classes")
    wanted = IdFilter(todo, "doc_id")  # texts without candidates stay where they are

    def with_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in row_slices(batch):
                sets = gram_sets(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array([f(x) for x in sets], pa.binary()) for f in (set_digest, np.ndarray.tobytes)], ["digest", "grams"])

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        for _, cell in groupby(rows(), key=lambda r: r[:3]):
            cell = list(cell)
            if found := _links_of_cell([r[3:] for r in cell], cell[0][1] != cell[0][2]):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["rep", "least", "links"])

    texts = wanted.maybe(docs.select("doc_id", "text")).select(F.lower("text").alias("text"))
    sets = map_texts(texts, with_sets, "digest binary, grams binary").join(todo.drop("doc_id"), "digest")
    return cells(sets, F.col("rep"), "rep", "n", "grams").mapInArrow(link, "rep long, least long, links long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, class_id, n_links (other documents at or above the threshold), group_id, kept."""
    signed = stored(signatures(docs), "signatures")
    members = signed.select("doc_id", "digest").distinct()
    of_set = members.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    sets = signed.groupBy("digest").agg(F.first("grams").alias("grams"), F.first("bands").alias("bands"))
    classes = stored(of_set.join(sets, "digest").withColumn("rep", F.monotonically_increasing_id()), "classes")
    candidates = candidate_sets(classes).withColumnRenamed("node", "rep").join(classes.drop("bands"), "rep")
    found = stored(verified_links(docs, candidates), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    linked = stored(components(found, "rep", "least").withColumnRenamed("node", "rep").join(classes.select("rep", "digest", "first_id"), "rep"), "groups")
    firsts = linked.groupBy("component").agg(F.min("first_id").alias("group_id"), F.min("digest").alias("group_digest"))
    groups = linked.select("rep", "component").join(firsts.select(afresh("component").alias("of"), "group_id", "group_digest"), F.col("component") == F.col("of"))
    of_class = classes.join(links, "rep", "left").join(groups.drop("component", "of"), "rep", "left")
    of_class = of_class.select(
        F.expr("substring(digest, 1, 16)").alias("set"),  # a name of its own, as above: many copies of one text can be split
        "first_id",
        (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.when(F.col("group_digest").isNull(), F.col("first_id")).otherwise(F.col("group_id")).alias("group_id"),
        F.coalesce("group_digest", "digest").alias("group_digest"),
    )
    of_text = members.join(of_class, F.col("digest") == F.col("set"))
    named = of_text.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("first_id").alias("class_id"), F.sum("n_links").alias("n_links"), F.min("group_id").alias("group_id"))
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct()
    with_id = ids.join(named, "doc_id", "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("group_id", "doc_id").alias("group_id"),
    )
    with_id = with_id.withColumn("kept", F.col("doc_id") == F.col("group_id"))
    first = F.col("group_id").isNull() & (F.col("digest") == F.col("group_digest"))
    nameless = of_text.where("doc_id IS NULL").select("doc_id", F.col("first_id").alias("class_id"), "n_links", "group_id", first.alias("kept"))
    blank = docs.where("doc_id IS NULL").where(~F.coalesce(F.col("text").rlike("[^ \\t\\n\\r\\f\\x0b]"), F.lit(False))).limit(1)
    blank = blank.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("group_id"), F.lit(True).alias("kept"))
    return with_id.unionByName(nameless).unionByName(blank)


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op5_jaccard": op5_jaccard}
ORACLE_SQL: dict = {}
