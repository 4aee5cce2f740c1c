"""Retrieval of a whole batch of queries: lexical and vector scores, summary navigation, fusion, verification, presentation.

Hit tables have query_id, rank (from 0), chunk_key, file_id, content, score and, where they come from summaries, weight.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuspark.functions.expr import bigrams, cosine, hamming, strip, tokens
from corpuspark.operators.blocks import best_of, by_block, column, cosines, over, overlaps, readable, rounded, same_tenant, slices, token_counts, weighted
from corpuspark.operators.chunk import simhash64
from corpuspark.sources.staging import few, spread, staged

READERS = 1 << 18  # of 16 bytes or so
DIGITS = 6  # scores are rounded before ranking, so that ties are ties on every engine


def _by_rank(score: str = "score", *ties: str) -> Window:
    return Window.partitionBy("query_id").orderBy(F.desc(score), *ties)


def _first(rows: DataFrame, order: Window, k: int) -> DataFrame:
    """The first ``k`` rows of each query with their ``rank`` from 0. The row number is compared as it is, so that Spark cuts each task's rows
    to ``k`` a query before it shuffles them."""
    nth = rows.drop("rank").withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= k)
    return nth.withColumn("rank", F.col("_nth") - 1).drop("_nth")


def _tokenised(docs: DataFrame, distinct: bool) -> DataFrame:
    """(doc_key, tokens), dealt out to all cores."""
    found = tokens(F.col("content"))
    return spread(docs.select("doc_key", "content")).select("doc_key", (F.array_distinct(found) if distinct else found).alias("tokens"))


def _pairs(batch, block, scores: np.ndarray, some: np.ndarray, name: str) -> pa.RecordBatch:
    row, query = np.nonzero(some)
    return pa.RecordBatch.from_arrays([block.ids.take(pa.array(query)), column(batch, "doc_key").take(pa.array(row)), pa.array(scores[row, query])], ["query_id", "doc_key", name])


def _kinds(queries: DataFrame, docs: DataFrame) -> str:
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_key {docs.schema['doc_key'].dataType.simpleString()}"


def lexical_overlap(queries: DataFrame, docs: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, doc_key, overlap): the share of a query's distinct tokens that the document has, of all pairs with a common token or of the
    ``k`` best documents of each query (ties: least key), then with ``rank``. Nothing is shuffled but those."""
    schema = f"{_kinds(queries, docs)}, overlap double"

    def score(block) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches):
            some = lambda batch, block: overlaps(batch, block) > 0
            if k:
                yield from best_of(batches, shared.value, k, "doc_key", "overlap", (), overlaps, some)
                return
            for batch in slices(batches):
                found = overlaps(batch, shared.value)
                yield _pairs(batch, shared.value, found, found > 0, "overlap")

        return over(_tokenised(docs, True), run, schema)

    found = by_block(queries.select("query_id", "query_text"), score, schema)
    return _first(found, _by_rank("overlap", "doc_key"), k) if k else found


def _statistics(terms: DataFrame, shared) -> tuple[float, float, np.ndarray]:
    """(documents, mean size, documents with each token that the block asks for)."""

    def run(batches):
        n, sized, total, df = 0, 0, 0, np.zeros(len(shared.value.vocabulary), np.int64)
        for batch in slices(batches):
            lists = column(batch, "tokens")
            _, token, _ = token_counts(lists, shared.value.vocabulary)
            df += np.bincount(token, minlength=len(df))
            n, sized = n + batch.num_rows, sized + batch.num_rows - lists.null_count
            total += pc.sum(pc.list_value_length(lists)).as_py() or 0
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-3, -2, -1, *some.tolist()], pa.int64()), pa.array([n, sized, total, *df[some].tolist()], pa.int64())], ["token", "n"])

    rows = dict(map(tuple, over(terms, run, "token long, n long").groupBy("token").agg(F.sum("n")).collect()))  # no more than the block's tokens
    df = np.zeros(len(shared.value.vocabulary))
    for token, n in rows.items():
        if token >= 0:
            df[token] = n
    return rows.get(-3, 0), rows.get(-1, 0) / max(1, rows.get(-2, 0)), df


def bm25_score(queries: DataFrame, docs: DataFrame, k: int | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_key, bm25) by Okapi BM25 with the smoothed inverse document frequency, of all pairs with a common token or of the ``k``
    best documents of each query (ties: least key), then with ``rank``.

    One pass counts the documents of the asked tokens, one scores: weights of a few hundred documents times the matrix of asked tokens.
    Only the counts and the results are shuffled.
    """
    schema = f"{_kinds(queries, docs)}, bm25 double"

    def score(block) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(block)
        terms = _tokenised(docs, False)
        n_docs, mean, df = _statistics(terms, shared)
        idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))

        def parts(batch, block):
            lists = column(batch, "tokens")
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            row, token, tf = token_counts(lists, block.vocabulary)
            weight = idf[token] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[row] / mean))
            return rounded(weighted(len(lists), row, token, weight, block.asks)), weighted(len(lists), row, token, np.ones(len(row)), block.asks) > 0

        def run(batches):
            if k:
                yield from best_of(batches, shared.value, k, "doc_key", "bm25", (), lambda *a: parts(*a)[0], lambda *a: parts(*a)[1])
                return
            for batch in slices(batches):
                yield _pairs(batch, shared.value, *parts(batch, shared.value), "bm25")

        return over(terms, run, schema)

    found = by_block(queries.select("query_id", "query_text"), score, schema)
    return _first(found, _by_rank("bm25", "doc_key"), k) if k else found


def knn_topk(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The ``k`` most similar documents of each query within its tenant, exactly; ``docs`` is filtered beforehand. Vectors of another length
    than the queries' and those without one count as zero: their similarity is 0."""
    schema = f"{_kinds(queries, docs)}, similarity double"

    def score(block) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches):
            yield from best_of(batches, shared.value, k, "doc_key", "similarity", (), cosines, same_tenant)

        return over(spread(docs.select("doc_key", "tenant_id", "embedding")), run, schema)

    found = by_block(queries.select("query_id", "tenant_id", "q_vec"), score, schema)
    return _first(found, _by_rank("similarity", "doc_key"), k)


def hybrid_search(queries: DataFrame, docs: DataFrame, allowed: DataFrame, n: int = 24) -> DataFrame:
    """Hits by lexical overlap plus cosine among documents (doc_key, file_id, tenant_id, content, embedding, available, sensitivity): those of
    files that the query may read (query_id, tenant_id, file_id, clearance), available, and no more sensitive than its clearance. What may be
    read can also be told by base (query_id, tenant_id, kb_id, clearance) if the documents have their file's ``bases``: then they meet the
    readers of each set of bases, which is broadcast up to ``READERS`` readers in all, and aren't shuffled.

    Documents without any common token still compete with their vector score. Documents meet the readers of their file, not each query; both
    scores are products of matrices, and each task passes on at most ``n`` rows of a query.
    """
    mine = docs.where("available = 1")
    by_base = "kb_id" in allowed.columns
    place = ["tenant_id", "bases" if by_base else "file_id"]
    if by_base:  # files in the same bases have the same readers
        sets = mine.select(*place).distinct().withColumn("kb_id", F.explode("bases"))
        allowed = sets.join(allowed, ["tenant_id", "kb_id"]).select("query_id", *place, "clearance").distinct()
    schema = f"{_kinds(queries, docs)}, score double"

    def score(block) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(block)
        asking = F.col("query_id").between(block.ids[0].as_py(), block.ids[-1].as_py())
        readers = allowed.where(asking).groupBy(*place).agg(F.collect_list(F.struct("query_id", "clearance")).alias("readers"))  # a block's
        if by_base:
            readers = staged(readers, "readers")
            pairs = readers.select(F.size("readers").alias("n")).agg(F.sum("n")).first()[0] or 0
            readers = F.broadcast(readers) if pairs <= READERS else readers
        rows = mine.join(readers, place).select("doc_key", "embedding", "sensitivity", "readers", F.array_distinct(tokens(F.col("content"))).alias("tokens"))

        def run(batches):
            both = lambda batch, block: rounded(cosines(batch, block) + overlaps(batch, block))
            yield from best_of(batches, shared.value, n, "doc_key", "score", (), both, readable)

        return over(rows, run, schema)

    found = by_block(queries.select("query_id", "query_text", "q_vec"), score, schema)
    top = _first(found, _by_rank("score", "doc_key"), n)
    texts = mine.select("doc_key", "file_id", "content")
    return texts.join(few(top, "top"), "doc_key").select("query_id", "rank", F.col("doc_key").alias("chunk_key"), "file_id", "content", "score")


def select_center(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, summary_key, chunk_key): among the still visible sources (query_id, query_text, summary_key, pos, chunk_key) the one that
    shares most distinct character pairs with the query; earlier ones win ties."""
    alive = chunks.select("chunk_key", "content").join(few(wanted, "wanted"), "chunk_key")
    shared = F.size(F.array_intersect(bigrams(F.col("query_text")), bigrams(F.col("content"))))
    nth = F.row_number().over(Window.partitionBy("query_id", "summary_key").orderBy(F.desc("shared"), "pos"))
    return alive.withColumn("shared", shared).withColumn("nth", nth).where("nth = 1").select("query_id", "summary_key", "chunk_key")


def relocate_anchor(anchors: DataFrame, chunks: DataFrame, radius: int = 8) -> DataFrame:
    """(summary_key, chunk_key, distance): the visible chunk of the same file whose fingerprint is nearest, within the radius. Only chunks of
    files that have an anchor here are fingerprinted."""
    near_by = chunks.select("file_id", "chunk_key", "content").join(few(anchors.select("file_id").distinct()), "file_id", "left_semi")
    near_by = near_by.select("file_id", "chunk_key", simhash64("content").alias("simhash"))
    pairs = anchors.select("summary_key", "file_id", F.col("simhash").alias("wanted")).join(near_by, "file_id")
    near = pairs.withColumn("distance", hamming(F.col("wanted"), F.col("simhash"))).where(F.col("distance") <= radius)
    return near.groupBy("summary_key").agg(F.min(F.struct("distance", "chunk_key")).alias("m")).select("summary_key", "m.chunk_key", "m.distance")


def resolve_anchors(wanted: DataFrame, anchors: DataFrame, chunks: DataFrame, radius: int = 8) -> DataFrame:
    """(query_id, summary_key, chunk_key, validity): valid by a living source, relocated by fingerprint, else stale. ``anchors`` are a table
    or a function that makes that of some (summary_key)."""
    asked = wanted.select("query_id", "summary_key").distinct()
    center = staged(select_center(wanted, chunks), "center").withColumnRenamed("chunk_key", "center")
    lost = few(asked.join(center, ["query_id", "summary_key"], "left_anti").select("summary_key").distinct(), "lost")
    sought = anchors(lost) if callable(anchors) else anchors.join(lost, "summary_key", "left_semi")
    moved = relocate_anchor(staged(sought, "anchors"), chunks, radius).select("summary_key", F.col("chunk_key").alias("moved"))
    joined = asked.join(center, ["query_id", "summary_key"], "left").join(moved, "summary_key", "left")
    validity = F.when(F.col("center").isNotNull(), "valid").when(F.col("moved").isNotNull(), "relocated").otherwise("stale")
    return joined.select("query_id", "summary_key", F.coalesce("center", "moved").alias("chunk_key"), validity.alias("validity"))


def chunk_windows(chunks: DataFrame, before: int = 2, after: int = 4) -> DataFrame:
    """(file_id, chunk_order, window_text) of every chunk: its neighbours by order, from one sort of each file."""
    return _framed(chunks.select("file_id", "chunk_order", "content"), before, after)


def _framed(rows: DataFrame, before: int, after: int) -> DataFrame:
    """``rows`` with window_text instead of content: the contents, nulls left out, of the rows of the file within that range of orders."""
    frame = Window.partitionBy("file_id").orderBy("chunk_order").rangeBetween(-before, after)
    near = F.collect_list(F.when(F.col("content").isNotNull(), F.struct("chunk_order", "content"))).over(frame)
    text = F.array_join(F.transform(F.sort_array("_near"), lambda x: x.content), "\n")
    return rows.withColumn("_near", near).withColumn("window_text", F.when(F.size("_near") > 0, text)).drop("content", "_near")


def read_window(centers: DataFrame, chunks: DataFrame, before: int = 2, after: int = 4) -> DataFrame:
    """Add window_text to centers (id columns, file_id, chunk_order): the neighbouring visible chunks in order; centers without any go.

    Centers and the chunks of their files are sorted together once and read through a range frame.
    """
    near = chunks.select("file_id", "chunk_order", "content").join(few(centers.select("file_id").distinct()), "file_id", "left_semi")
    both = centers.withColumn("_center", F.lit(True)).unionByName(near, allowMissingColumns=True)
    return _framed(both, before, after).where(F.col("_center") & F.col("window_text").isNotNull()).drop("_center")


def gate_scores(centers: DataFrame, vectors: DataFrame, before: int, after: int) -> DataFrame:
    """(query_id, summary_key, best): the greatest cosine of the query with a chunk of the window."""
    wanted = centers.withColumn("wanted", F.explode(F.sequence(F.col("chunk_order") - before, F.col("chunk_order") + after)))
    near = vectors.select("file_id", F.col("chunk_order").alias("wanted"), "embedding")
    best = F.max(F.round(cosine(F.col("q_vec"), F.col("embedding")), DIGITS))
    return near.join(few(wanted, "windows"), ["file_id", "wanted"]).groupBy("query_id", "summary_key").agg(best.alias("best"))


def soft_gate(centers: DataFrame, vectors: DataFrame, theta: float = 0.2, before: int = 2, after: int = 4) -> DataFrame:
    """(query_id, summary_key, span): windows whose best cosine reaches ``theta``; those that fail try again with twice the span."""
    if theta < 0:
        return centers.select("query_id", "summary_key", F.lit(1).alias("span"))
    first = gate_scores(centers, vectors, before, after).where(F.col("best") >= theta).select("query_id", "summary_key", F.lit(1).alias("span"))
    failed = centers.join(first, ["query_id", "summary_key"], "left_anti")
    second = gate_scores(failed, vectors, 2 * before, 2 * after).where(F.col("best") >= theta).select("query_id", "summary_key", F.lit(2).alias("span"))
    return first.unionByName(second)


def summary_search(queries: DataFrame, summaries: DataFrame, allowed: DataFrame, k: int = 5) -> DataFrame:
    """The best summaries of each query, found and filtered like other documents."""
    return hybrid_search(queries, summaries, allowed, k)


def path_a(queries, summaries, sources, anchors, chunks, vectors, allowed, k: int = 5, theta: float = 0.2, radius: int = 8) -> tuple[DataFrame, DataFrame]:
    """(hits, reasons): summaries, their anchors, the windows around those, gated. ``weight`` is the summary's coverage, 1 if that is 0 or null."""
    found = summary_search(queries, summaries, allowed, k).select("query_id", "rank", F.col("chunk_key").alias("summary_key"), "file_id", "score")
    found = staged(found, "found")  # at most k rows a query, as what follows
    keys = few(found.select("query_id", "summary_key", "rank", "score"), "found-keys")
    wanted = sources.select("summary_key", "pos", "chunk_key").join(keys.drop("rank", "score"), "summary_key").join(queries.select("query_id", "query_text"), "query_id")
    resolved = found.select("query_id", "summary_key").join(resolve_anchors(wanted, anchors, chunks, radius), ["query_id", "summary_key"], "left")
    resolved = few(resolved, "resolved")
    placed = chunks.select("chunk_key", "file_id", "chunk_order").join(resolved, "chunk_key").join(queries.select("query_id", "q_vec"), "query_id")
    placed = staged(placed, "placed")
    passed = staged(soft_gate(placed, vectors, theta), "passed")
    spans = placed.drop("q_vec").join(passed, ["query_id", "summary_key"])
    windows = [read_window(spans.where(F.col("span") == s), chunks, 2 * s, 4 * s) for s in (1, 2)]
    coverage = F.col("coverage_ratio")
    weight = F.when(coverage.isNull() | (coverage == 0), 1.0).otherwise(coverage)
    covered = staged(summaries.select(F.col("doc_key").alias("summary_key"), "coverage_ratio").join(keys, "summary_key"), "covered")
    hits = windows[0].unionByName(windows[1]).join(covered, ["query_id", "summary_key"])
    hits = hits.select("query_id", "rank", "chunk_key", "file_id", F.col("window_text").alias("content"), "score", weight.alias("weight"))
    state = resolved.join(passed, ["query_id", "summary_key"], "left")
    reading = allowed.select("query_id").distinct().withColumn("reads", F.lit(True))
    reason = F.when(F.coalesce("validity", F.lit("stale")) == "stale", "anchor_stale").when(F.col("span").isNull(), "relevance_fail")
    per_query = state.groupBy("query_id").agg(F.count("*").alias("total"), F.count("span").alias("completed"), F.array_join(F.array_sort(F.collect_set(reason)), ",").alias("why"))
    all_queries = queries.select("query_id").join(per_query, "query_id", "left").join(reading, "query_id", "left")
    degraded = F.when(F.col("reads").isNull(), "no_files").otherwise(degraded_reason())
    return hits, all_queries.select("query_id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("completed", F.lit(0)).alias("completed"), degraded.alias("degraded"))


def degraded_reason() -> Column:
    total, completed, why = F.coalesce("total", F.lit(0)), F.col("completed"), F.col("why")
    return (
        F.when(total == 0, "no_summary")
        .when((completed > 0) & (why == ""), "none")
        .when(completed > 0, F.concat(F.lit("partial:"), why))
        .when(why != "", F.split(why, ",")[0])
        .otherwise("empty")
    )


def rrf_merge(a: DataFrame, b: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two hit lists: sums of weight / (k + rank), ranks from 0, duplicates in a list counted once at their first
    rank, the first list's hit kept; ties in the order in which the lists name the hits."""

    def firsts(hits: DataFrame, tag: str) -> DataFrame:
        weight = F.coalesce("weight", F.lit(1.0)) if "weight" in hits.columns else F.lit(1.0)
        rows = hits.select("query_id", "rank", "chunk_key", "file_id", "content", weight.alias("weight"), F.lit(tag).alias("tag"))
        return rows.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "chunk_key").orderBy("rank"))).where("nth = 1")

    order = F.struct("tag", "rank")
    merged = (
        firsts(a, "a")
        .unionByName(firsts(b, "b"))
        .groupBy("query_id", "chunk_key")
        .agg(
            F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 9).alias("score"),
            F.min_by(F.struct("file_id", "content"), order).alias("hit"),
            F.array_join(F.sort_array(F.collect_set("tag")), "").alias("path"),
            F.min(order).alias("first"),
        )
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "first", "chunk_key")) - 1
    return merged.select("query_id", rank.alias("rank"), "chunk_key", "hit.file_id", "hit.content", "score", "path")


def apply_rerank(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """Hits in the order of given relevance (query_id, chunk_key, relevance); unscored hits go, queries without any score stay as they are."""
    scored = hits.join(scores, ["query_id", "chunk_key"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "rank")) - 1
    reordered = scored.withColumn("new_rank", rank).drop("rank", "relevance").withColumnRenamed("new_rank", "rank").withColumn("reranked", F.lit(True))
    same = hits.join(scores.select("query_id").distinct(), "query_id", "left_anti").withColumn("reranked", F.lit(False))
    return reordered.unionByName(same)


def score_threshold(hits: DataFrame, threshold: float | None) -> DataFrame:
    return hits.where(F.col("score") >= threshold) if threshold else hits


def post_verify(hits: DataFrame, allowed: DataFrame, visible: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, violations): hits must be visible chunks (chunk_key, file_id, tenant_id) of a file that the query may read (query_id, tenant_id,
    file_id); the ids of others are reported by query."""
    seen = visible.select("chunk_key", F.col("file_id").alias("in_file"), F.col("tenant_id").alias("owner"))
    seen = staged(seen.join(few(hits.select("chunk_key").distinct()), "chunk_key", "left_semi"), "seen")  # no more than there are hits
    owned = hits.join(seen, "chunk_key", "left")
    may = allowed.select(F.col("query_id").alias("q"), F.col("tenant_id").alias("t"), F.col("file_id").alias("f")).distinct().withColumn("ok", F.lit(True))
    checked = owned.join(may, (F.col("query_id") == F.col("q")) & (F.col("owner") == F.col("t")) & (F.col("in_file") == F.col("f")), "left")
    bad = checked.where("ok IS NULL").groupBy("query_id").agg(F.sort_array(F.collect_set("chunk_key")).alias("dropped"))
    return checked.where("ok").select(*hits.columns), bad


def readable_files(hits: DataFrame, visible: DataFrame, allowed: DataFrame) -> DataFrame:
    """(query_id, tenant_id, file_id, clearance) of the files of the hits' chunks that the query may read, where that is told by base."""
    of = visible.select("chunk_key", "tenant_id", "file_id", "bases").join(few(hits.select("query_id", "chunk_key").distinct()), "chunk_key")
    of = of.select("query_id", "tenant_id", "file_id", F.explode("bases").alias("kb_id"))
    return of.join(allowed, ["query_id", "tenant_id", "kb_id"]).select("query_id", "tenant_id", "file_id", "clearance").distinct()


def cut(hits: DataFrame, k: int) -> DataFrame:
    """The first ``k`` hits of each query by their present order."""
    ordered = hits.withColumn("_order", F.col("rank"))
    return _first(ordered, Window.partitionBy("query_id").orderBy("_order"), k).drop("_order")


def final_topk(hits: DataFrame, allowed: DataFrame, visible: DataFrame, reranked: bool, k: int = 8) -> DataFrame:
    """Cut then verify; after a rerank verify then cut."""
    if reranked:
        return cut(post_verify(hits, allowed, visible)[0], k)
    return post_verify(cut(hits, k), allowed, visible)[0]


def route_stats(queries: DataFrame, a: DataFrame, b: DataFrame, reasons: DataFrame) -> DataFrame:
    """By query: hits of both paths, which path failed, and the completed share of path A."""
    n = lambda hits, name: hits.groupBy("query_id").agg(F.count("*").alias(name))
    joined = queries.select("query_id").join(n(a, "path_a"), "query_id", "left").join(n(b, "path_b"), "query_id", "left").na.fill(0)
    degraded = F.when((F.col("path_a") > 0) & (F.col("path_b") > 0), "none").when(F.col("path_b") > 0, "b_only").when(F.col("path_a") > 0, "a_only").otherwise("both_empty")
    rate = F.when(F.col("total") > 0, F.round(F.col("completed") / F.col("total"), 3))
    return joined.join(reasons.select("query_id", "total", "completed"), "query_id", "left").select("query_id", "path_a", "path_b", degraded.alias("degraded"), rate.alias("completed_rate"))


def hit_view(hits: DataFrame, chars: int = 600) -> DataFrame:
    return hits.select("query_id", "rank", "chunk_key", "file_id", F.substring("content", 1, chars).alias("snippet"), F.round("score", 4).alias("score"))


def build_citation(hits: DataFrame, chars: int = 120) -> DataFrame:
    return hit_view(hits, chars)


def build_context(hits: DataFrame, limit: int = 8, chars: int = 1500, snippet: int = 300) -> DataFrame:
    """(query_id, context, refs): the first ``limit`` hits, blank ones skipped afterwards, numbered, cut with an ellipsis."""
    text = strip(F.col("content"))
    some = cut(hits, limit).withColumn("text", text).where("text <> ''")
    some = some.withColumn("text", F.when(F.length("text") > chars, F.concat(F.substring("text", 1, chars), F.lit("…"))).otherwise(F.col("text")))
    some = some.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    item = F.struct("n", F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.col("text")).alias("part"), "file_id", "chunk_key", F.substring("text", 1, snippet).alias("snippet"))
    listed = some.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    refs = F.transform("items", lambda x: F.struct(x.n.alias("index"), x.file_id.alias("file_id"), x.chunk_key.alias("chunk_key"), x.snippet.alias("snippet")))
    return listed.select("query_id", F.array_join(F.transform("items", lambda x: x.part), "\n\n").alias("context"), refs.alias("refs"))


def build_prompt(questions: DataFrame, contexts: DataFrame, history: DataFrame, turns: int = 8) -> DataFrame:
    """(query_id, prompt): the last non-empty turns (query_id, id, role, content), the context, the question. Only turns of the questions are
    dealt out."""
    asked = few(questions.select("query_id").distinct(), "asked")
    last = history.join(asked, "query_id", "left_semi").where("content <> ''").withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("id")))).where(F.col("nth") <= turns)
    line = F.concat("role", F.lit(": "), "content", F.lit("\n")).alias("line")
    told = last.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", line))), lambda x: x.line), "").alias("told"))
    joined = questions.join(contexts, "query_id", "left").join(told, "query_id", "left")
    none = F.lit("")
    return joined.select("query_id", F.concat(F.coalesce("told", none), F.lit("\n"), F.coalesce("context", none), F.lit("\n\n"), "query_text").alias("prompt"))


def cite(requests: DataFrame, chunks: DataFrame, allowed: DataFrame) -> DataFrame:
    """Chunks asked for (user_id, tenant_id, chunk_key) that lie in files allowed to the user in that tenant."""
    found = requests.join(chunks.select("chunk_key", "file_id", "content"), "chunk_key")
    return found.join(allowed, ["user_id", "tenant_id", "file_id"], "left_semi")


def search(queries, chunks, vectors, summaries, sources, anchors, allowed, mode: str = "hybrid", k: int = 8, rerank: Callable[[DataFrame], DataFrame] | None = None, threshold: float | None = None, radius: int = 8) -> DataFrame:
    """The composition: both paths (``hybrid``) or one of them (``summary``, ``embedding``), fusion, optional rerank and threshold, verification,
    top k. ``rerank`` gives relevances (query_id, chunk_key, relevance) for the fused hits. ``allowed`` is what each query may read, as from
    ``access.authorised_files`` or, if summaries and vectors have their files' ``bases``, ``access.authorised_bases``; queries that may read
    nothing have no rows."""
    if mode not in ("hybrid", "summary", "embedding"):
        raise ValueError(f"no such mode: {mode}")
    empty = queries.select("query_id", F.lit(0).alias("rank"), F.lit("").alias("chunk_key"), F.lit(0).cast("long").alias("file_id"), F.lit("").alias("content"), F.lit(0.0).alias("score")).where("false")
    shown = vectors.where("available = 1")
    a = path_a(queries, summaries, sources, anchors, chunks, shown, allowed, radius=radius)[0] if mode in ("hybrid", "summary") else empty
    docs = vectors.withColumnRenamed("chunk_key", "doc_key")
    b = hybrid_search(queries, docs, allowed) if mode in ("hybrid", "embedding") else empty
    merged = staged(rrf_merge(a, b), "merged")
    if rerank:
        merged = apply_rerank(merged, rerank(merged))
    if "kb_id" in allowed.columns:
        allowed = readable_files(merged, chunks, allowed)
    return final_topk(score_threshold(merged, threshold), allowed, chunks, rerank is not None, k)
