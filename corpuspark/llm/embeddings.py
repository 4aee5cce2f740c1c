"""Embedding near-dedup by NN-descent.

Vectors are compared only within a label (and dimension). Equal vectors are one class. Each class keeps a list of its nearest
others. The lists start from a few tables of random sign hashes, which miss many pairs; rounds of local joins then compare the
neighbours of each vector, in either direction, with one another and keep the best, as long as there are fresh neighbours and
lists still change. Every comparison also keeps its threshold edges, as star edges (to the least id that near pairs of the block
connect). A list that is full of near neighbours is saturated: others may be near as well. It is enlarged by setting the component
that its near neighbours form aside: its places go to vectors outside, until the nearest of those is below the threshold. So no list
holds the n^2 edges of a dense group, and none ends before the threshold.

All pairs of a component of threshold edges are then compared exactly, in double precision, in cells of two bounded blocks. An
audit compares a bounded query set with all vectors. While it finds missing links the lists are built again, twice as long and from
other tables; labels in which the last lists still miss some are compared whole, in cells. ``recall``, a column of the result, is
what the audit found of the lists that were used.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those with a null label, link with
nothing and are their own components; vectors of different dimensions don't link; labels may be of any type; repeated rows of a
vec_id are one vector, the least if they differ, and get one row; rows without a vec_id are one row that links with nothing; links
need cosine >= the threshold; an empty table gives no rows; columns other than the named ones are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuspark.llm.common import discard, stored, table
from corpuspark.llm.components import cells, components, links_of_cell

THRESHOLD = 0.98
MARGIN = 0.005  # of half-precision similarities, which only propose candidates
NEIGHBOURS = 8
SEED_TABLES = 4
SEED_BUCKET = 24
MOST_SEED_BITS = 40
LEAST_CHANGE = 0.1  # of the places of all lists, by which a round counts as changing them
MAX_ROUNDS = 24  # only the audit's doubled lists come after these
BLOCK = 192
AUDIT_QUERIES = 2_048
AUDIT_RECALL = 0.9999
ROUNDING = 1e-12  # links this close to the threshold may differ by the order of a sum; the audit doesn't ask for them


def classes(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, vector) of the usable vectors, normalised, as bytes of doubles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, units, dims = [], [], []
            for i, v in enumerate(batch.column(2)):
                if not v.is_valid or not len(v):
                    continue
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
                most = np.abs(x).max()  # NaN where a component is
                if np.isfinite(most) and most > 0:
                    x = x / most  # so that no square over- or underflows
                    keep.append(i)
                    units.append((x / np.sqrt(x @ x)).tobytes())
                    dims.append(len(x))
            if keep:
                at = pa.array(keep)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(dims, pa.int32()), pa.array(units, pa.binary())],
                    ["vec_id", "label", "dim", "vector"],
                )

    usable = vectors.where("label IS NOT NULL AND vec_id IS NOT NULL").select("vec_id", F.col("label").cast("string").alias("label"), "embedding")
    return usable.mapInArrow(run, "vec_id long, label string, dim int, vector binary")


def seed_bits(label_size: int) -> int:
    """Sign bits that make buckets of about ``SEED_BUCKET`` in a label of that size; a small label is one bucket, compared whole."""
    if label_size <= 2 * SEED_BUCKET:
        return 0
    return max(2, min(MOST_SEED_BITS, math.ceil(math.log2(label_size / SEED_BUCKET))))


def _blocks(batches: Iterable[pa.RecordBatch], key_columns: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, half-precision vectors) of at most ``size`` rows of equal key; rows come sorted by their first columns."""

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    for _, group in groupby(rows(), key=lambda r: r[:key_columns]):
        block = []
        for r in group:
            block.append(r)
            if len(block) == size:
                yield _as_arrays(block)
                block = []
        if len(block) > 1:
            yield _as_arrays(block)


def _as_arrays(block: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r[-2] for r in block]), np.frombuffer(b"".join(r[-1] for r in block), np.float16).reshape(len(block), -1).astype(np.float32)


def _proposals(key_columns: int, size: int, best_of: int):
    """Each row's most similar others of its block, and the block's star edges, whose ``sim`` is null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, v in _blocks(batches, key_columns, size):
            s = v @ v.T
            s[ids[:, None] == ids] = -2
            k = min(best_of, len(ids) - 1)
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            src, sim = np.repeat(ids, k), np.take_along_axis(s, best, 1).ravel()
            ok = sim > -2
            yield pa.RecordBatch.from_arrays([pa.array(src[ok]), pa.array(ids[best.ravel()][ok]), pa.array(sim[ok])], ["src", "dst", "sim"])
            near = s >= THRESHOLD - MARGIN
            if near.any():
                found = [(i, least) for i, least, _ in links_of_cell(ids, np.ones(len(ids), np.int64), np.zeros(len(ids)), near, False) if i != least]
                if found:
                    src, dst = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.nulls(len(src), pa.float32())], ["src", "dst", "sim"])

    return run


EDGES = "src long, dst long, sim float"
KEYS = ["label", "dim", "t", "key"]


def seeds(reps: DataFrame, seed: int, best_of: int) -> DataFrame:
    """Proposed edges and star edges among vectors of equal sign hashes, in blocks of neighbours along another random direction. Each label has
    as many bits as its own ``size`` needs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array(batch.column(2).to_pylist())
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                some = batch.take(pa.array(at))
                v = np.frombuffer(b"".join(some.column(3).to_pylist()), np.float64).reshape(len(at), dim)
                half = pa.array([x.tobytes() for x in v.astype(np.float16)], pa.binary())
                random = np.random.default_rng([int(dim), seed])
                own = np.array([seed_bits(n) for n in some.column(4).to_pylist()], np.int64)
                bits = int(own.max())
                for t in range(SEED_TABLES):
                    along = random.standard_normal((dim, MOST_SEED_BITS + 1))
                    side = v @ along[:, : bits + 1]
                    key = ((side[:, 1:] > 0) @ (1 << np.arange(bits, dtype=np.int64))) & ((1 << own) - 1)
                    yield pa.RecordBatch.from_arrays(
                        [some.column(1), some.column(2), pa.array(np.full(len(at), t, np.int32)), pa.array(key), pa.array(side[:, 0]), some.column(0), half],
                        ["label", "dim", "t", "key", "along", "rep", "half"],
                    )

    keyed = reps.select("rep", "label", "dim", "vector", "size").mapInArrow(run, "label string, dim int, t int, key long, along double, rep long, half binary")
    in_blocks = keyed.repartition(*KEYS).sortWithinPartitions(*KEYS, "along").select(*KEYS, "rep", "half")
    return in_blocks.mapInArrow(_proposals(4, BLOCK, best_of), EDGES)


def nearest(edges: DataFrame, apart: DataFrame | None, k: int) -> DataFrame:
    """(src, dst, sim, fresh): the ``k`` most similar neighbours of each node that are not of its component of ``apart`` (node, component).
    An edge that was there before isn't fresh."""
    once = edges.repartition("src").groupBy("src", "dst").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))  # one exchange serves all
    if apart is not None:
        of = lambda name: apart.select(F.col("node").alias(name), F.col("component").alias(f"{name}_in"))
        once = once.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
        once = once.where("src_in IS NULL OR dst_in IS NULL OR src_in <> dst_in").drop("src_in", "dst_in")
    best = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return once.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).drop("nth")


def local_join(graph: DataFrame, halves: DataFrame, turn: int, best_of: int) -> DataFrame:
    """Proposed edges and star edges among the neighbours, in either direction, of each node that has a fresh one. A hub's many neighbours
    meet in bounded blocks, dealt out anew in each turn."""
    back = graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "fresh")
    around = graph.select("src", "dst", "fresh").unionByName(back).repartition("src").groupBy("src", "dst").agg(F.max("fresh").alias("fresh"))
    of_src = Window.partitionBy("src")
    active = around.withColumns({"n": F.count("*").over(of_src), "any": F.max("fresh").over(of_src)}).where("any = 1 AND n > 1")
    part = F.pmod(F.xxhash64("dst", F.lit(turn)), F.ceil(F.col("n") / BLOCK)).cast("int")
    met = active.select("src", F.col("dst").alias("rep"), part.alias("part")).join(halves, "rep")
    return met.repartition("src", "part").sortWithinPartitions("src", "part").select("src", "part", "rep", "half").mapInArrow(_proposals(2, BLOCK, best_of), EDGES)


def neighbour_graph(reps: DataFrame, k: int, seed: int, known: DataFrame | None = None) -> DataFrame:
    """(node, component) of the threshold edges that NN-descent finds, and of those that are ``known``, in the same form."""
    halves = stored(reps.select("rep", "vector").mapInArrow(_halve, "rep long, half binary"), "halves")
    proposed = stored(seeds(reps, seed, k), "proposed")
    apart, graph = known, None
    for turn in range(MAX_ROUNDS + 1):
        found = proposed.where("sim IS NULL").select("src", "dst")
        met = found if apart is None else found.join(apart.withColumnRenamed("node", "src"), "src", "left").join(
            apart.select(F.col("node").alias("dst"), F.col("component").alias("other")), "dst", "left"
        ).where("component IS NULL OR other IS NULL OR component <> other").select("src", "dst")
        if not met.isEmpty():  # saturated lists: what is near by now is set aside, so that other vectors get a place
            if apart is not None:  # what is known is an edge for each node
                met = met.unionByName(apart.select(F.col("node").alias("src"), F.col("component").alias("dst")))
            apart = stored(components(stored(met.distinct(), "stars"), "src", "dst"), "apart")
        fresh = proposed.where("sim IS NOT NULL").withColumn("fresh", F.lit(1))
        old = None if graph is None else graph.withColumn("fresh", F.lit(0))
        after = stored(nearest(fresh if old is None else old.unionByName(fresh), apart, k), "graph")
        discard(proposed)
        if graph is not None:
            discard(graph)
        graph = after
        new, places = graph.agg(F.coalesce(F.sum("fresh"), F.lit(0)), F.count("*")).first()
        if turn == MAX_ROUNDS or new <= LEAST_CHANGE * places:
            break
        proposed = stored(local_join(graph, halves, turn, k), "proposed")
    discard(graph)
    return apart if apart is not None else graph.select(F.col("src").alias("node"), F.col("dst").alias("component")).where("false")


def _halve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        half = [np.frombuffer(v, np.float64).astype(np.float16).tobytes() for v in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(half, pa.binary())], ["rep", "half"])


def exact_links(reps: DataFrame, candidates: DataFrame) -> DataFrame:
    """(rep, least, links) by cell: all pairs of each candidate component, compared in double precision."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        for _, cell in groupby(rows(), key=lambda r: r[:3]):
            cell = list(cell)
            if len(cell) < 2:
                continue
            ids, weight, block = (np.array([r[c] for r in cell]) for c in (4, 5, 3))
            v = np.frombuffer(b"".join(r[6] for r in cell), np.float64).reshape(len(cell), -1)
            if found := links_of_cell(ids, weight, block, v @ v.T >= THRESHOLD, cell[0][1] != cell[0][2]):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["rep", "least", "links"])

    members = candidates.withColumnRenamed("node", "rep")
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    full = members.join(sizes, "component").join(reps.select("rep", "n", "vector"), "rep")
    return cells(full, F.col("rep"), "rep", "n", "vector").mapInArrow(run, "rep long, least long, links long")


def audit(reps: DataFrame, links: DataFrame) -> tuple[float, list[tuple[str, int]]]:
    """The share of all links of a bounded, hash-chosen query set that ``links`` (rep, links) has, and the (label, dim) that miss some."""
    asked = reps.orderBy(F.xxhash64("rep"), "rep").limit(AUDIT_QUERIES).select("rep", "label", "dim", "n", "vector").collect()  # at most AUDIT_QUERIES rows
    by_label: dict = {}
    for r in asked:
        by_label.setdefault((r.label, r.dim), []).append((r.rep, np.frombuffer(r.vector, np.float64)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True), key=lambda r: r[1:3])
            for key, group in groupby(rows, key=lambda r: r[1:3]):
                if key not in by_label:
                    continue
                group = list(group)
                ids, weight = np.array([r[0] for r in group]), np.array([r[3] for r in group])
                own = np.array([q for q, _ in by_label[key]])
                v = np.frombuffer(b"".join(r[4] for r in group), np.float64).reshape(len(group), -1)
                linked = (np.stack([x for _, x in by_label[key]]) @ v.T >= THRESHOLD + ROUNDING) & (own[:, None] != ids)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(linked @ weight)], ["rep", "links"])

    all_ = reps.select("rep", "label", "dim", "n", "vector").mapInArrow(run, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("all"))
    rows = all_.join(links, "rep", "left").select("rep", "all", F.least("all", F.coalesce("links", F.lit(0))).alias("found")).collect()  # at most AUDIT_QUERIES
    of = {r.rep: (r.label, r.dim) for r in asked}
    whole = sum(r["all"] for r in rows)
    return sum(r.found for r in rows) / whole if whole else 1.0, sorted({of[r.rep] for r in rows if r.found < r["all"]})


def near_duplicates(vectors: DataFrame, attempts: int = 2) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept, recall."""
    once = classes(vectors).groupBy("vec_id").agg(F.min(F.struct("vector", "label", "dim")).alias("v"))
    usable = stored(once.select("vec_id", "v.label", "v.dim", "v.vector"), "vectors")
    grouped = usable.groupBy("label", "dim", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    grouped = stored(grouped, "grouped")
    sizes = grouped.groupBy("label", "dim").agg(F.count("*").alias("size")).select(F.concat("label", F.lit("")).alias("of_label"), F.col("dim").alias("of_dim"), "size")
    reps = stored(grouped.join(sizes, (F.col("label") == F.col("of_label")) & (F.col("dim") == F.col("of_dim"))).drop("of_label", "of_dim"), "classes")
    whole = lambda found: stored(found.groupBy("rep").agg(F.sum("links").alias("links")), "links")
    candidates = None
    for attempt in range(attempts):
        candidates = neighbour_graph(reps, NEIGHBOURS << attempt, attempt, candidates)
        found = stored(exact_links(reps, candidates), "found")
        links = whole(found)
        recall, missing = audit(reps, links)
        if recall >= AUDIT_RECALL:
            break
    else:  # the exact way for the rest: labels that the lists don't exhaust are compared whole
        wanted = reps.sparkSession.createDataFrame(missing, "label string, dim int")
        first = reps.join(wanted, ["label", "dim"]).groupBy("label", "dim").agg(F.min("rep").alias("component"))
        all_of = reps.join(first, ["label", "dim"]).select(F.col("rep").alias("node"), "component")
        rest = candidates.join(all_of.select("node"), "node", "left_anti")
        found = stored(exact_links(reps, rest.unionByName(all_of)), "found")
        links = whole(found)
    groups = components(found, "rep", "least").select(F.col("node").alias("rep"), F.col("component").alias("component_id"))
    of_class = reps.join(links, "rep", "left").join(groups, "rep", "left")
    of_class = of_class.select(F.sha1("vector").alias("print"), *(F.col(c).alias(f"of_{c}") for c in ("label", "dim", "vector")), "rep", "n", "links", "component_id")
    same = (F.sha1("vector") == F.col("print")) & (F.col("label") == F.col("of_label")) & (F.col("dim") == F.col("of_dim")) & (F.col("vector") == F.col("of_vector"))
    of_vector = usable.join(of_class, same).select(
        "vec_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")
    )
    return (
        vectors.select("vec_id")
        .distinct()
        .join(of_vector, "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
        .withColumn("recall", F.lit(float(recall)))
    )


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


QUERIES = {"op2_embeddings": op2_embeddings}
ORACLE_SQL: dict = {}
