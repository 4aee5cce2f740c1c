"""Connected components, and exact comparison of all pairs within candidate components.

Components come from alternating large and small stars: edges stay distributed, rounds grow with the log of a component.
Pairs are compared in cells of two blocks of bounded size; a cell returns counts and star edges, never its pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from corpuspark.llm.common import afresh, discard, stored

MAX_ROUNDS = 40
EDGES_PER_FILE = 500_000


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and all its neighbours v. Partial minima keep a hub from being one task; the minima are dealt out
    under a name of their own, so that the join of a hub's edges can be split."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(afresh("u").alias("hub"), "m")
    return edges.join(least, F.col("u") == F.col("hub")).select("u", "v", F.least("u", "m").alias("m"))


def _kept(edges: DataFrame, files: int | None) -> tuple[DataFrame, tuple]:
    """The edges as a stored table of about so many files, with their number and a mark of which they are, from the same pass."""
    seen = Observation()
    counted = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").bitwiseAND((1 << 40) - 1)).alias("mark"))
    return stored(counted.coalesce(files) if files else counted, "edges"), (seen.get["n"], seen.get["mark"])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node of an edge between different nodes; component is its least node."""
    down = lambda df: df.where("u > v").select("u", "v").distinct()
    now, mark = _kept(down(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))), None)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _with_least(down(large))
        moved = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        before, old = mark, now
        now, mark = _kept(down(moved), max(1, mark[0] // EDGES_PER_FILE))
        discard(old)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components: not settled after {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def cells(members: DataFrame, rep: Column, *columns: str) -> DataFrame:
    """Place members (component, blocks, columns) in cells (component, i, j), sorted, so that any two meet in one.

    ``blocks`` is the number of blocks of the component; a member goes to one block by the hash of ``rep``.
    """
    block = F.pmod(F.xxhash64(rep), "blocks").cast("int")
    return (
        members.withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", *columns)
        .repartition("component", "i", "j")
        .sortWithinPartitions("component", "i", "j")
    )


def links_of_cell(ids: np.ndarray, weight: np.ndarray, block: np.ndarray, linked: np.ndarray, across: bool) -> list[tuple[int, int, int]]:
    """(id, the least id it is connected with here, weight of the linked ones) for the ids that have links in this cell.

    ``across``: the cell has two blocks, and only pairs with one member of each count.
    """
    np.fill_diagonal(linked, False)
    if across:
        linked &= block[:, None] != block
    least = ids.copy()
    while True:  # least ids spread along links
        spread = np.minimum(least, np.where(linked, least, np.iinfo(np.int64).max).min(1))
        if (spread == least).all():
            break
        least = spread
    rows = zip(ids.tolist(), least.tolist(), (linked @ weight).tolist(), linked.any(1).tolist(), strict=True)
    return [(i, m, n) for i, m, n, some in rows if some]
