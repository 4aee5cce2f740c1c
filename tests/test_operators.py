"""Operators on small fixtures with exact results."""

import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuspark.operators import access, audit, chunk, metrics, parse, retrieval, versions
from corpuspark.operators.parse import _html_blocks

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
BLOCK = "file_id long, pos int, text string, block_type string, page int, section_path string"


def blocks(spark, *rows):
    return spark.createDataFrame([(1, k, text, kind, 1, None) for k, (text, kind) in enumerate(rows)], BLOCK)


def contents(df):
    return [r.content for r in df.orderBy("file_id", "chunk_order").collect()]


def test_markdown_blocks_and_chunks(spark):
    docs = spark.createDataFrame([(1, "# Rivers\nthey run\n\n## Deltas\nthey end"), (2, "   "), (3, "x\r\ny\x0bz")], "file_id long, text string")
    found = parse.parse_markdown(docs)
    rows = [(r.block_type, r.level, r.section_path, r.text) for r in found.where("file_id = 1").orderBy("pos").collect()]
    assert rows == [("title", 1, "Rivers", "# Rivers"), ("text", None, "Rivers", "they run"), ("title", 2, "Deltas", "## Deltas"), ("text", None, "Deltas", "they end")]
    assert [r.text for r in found.where("file_id = 2").collect()] == [""]
    assert [r.text for r in found.where("file_id = 3").collect()] == ["x\ny\nz"]
    assert contents(chunk.chunk_naive(found.where("file_id = 1"))) == ["# Rivers\nthey run", "## Deltas\nthey end"]


def test_html_blocks():
    found = _html_blocks("<h1>T1</h1><script>no</script><p>hello <b>world</b></p><h2>S</h2><ul><li>a<p>in</p></li></ul><table><tr><th>x</th></tr><tr><td>1</td></tr></table>")
    assert [(b["block_type"], b["text"], b["section_path"]) for b in found] == [
        ("title", "T1", "T1"),
        ("text", "hello world", "T1"),
        ("title", "S", "T1 / S"),
        ("text", "a in", "T1 / S"),
        ("text", "in", "T1 / S"),
        ("table", "x\n1", "T1 / S"),
    ]
    assert _html_blocks("") == [] and _html_blocks(None) == []


def test_html_lists_hold_their_inner_lists():
    texts = lambda html: [b["text"] for b in _html_blocks(html)]
    assert texts("<ul><li>outer<ul><li>inner</li></ul></li><li>next</li></ul>") == ["outer inner", "inner", "next"]
    assert texts("<ul><li>one<li>two<ol><li>three<li>four</ol>five</ul>") == ["one", "two three four five", "three", "four"]
    assert texts("<table><tr><td><ul><li>cell</ul></td></tr></table><p>a<p>b") == ["cell", "cell", "a", "b"]


def test_sentences_split_to_chunks(spark):
    text = "山高。水长！风轻？云淡"
    assert contents(chunk.chunk_delimiter(blocks(spark, (text, "text")), size=3)) == ["山高", "水长", "风轻", "云淡"]


def carried(sizes, size, budget):
    """Chunks of prose blocks as lists of block numbers: a full chunk passes on whole blocks from its end that fit the budget, never itself."""
    chunks, now = [], []
    for i, n in enumerate(sizes):
        if n > size:
            chunks += [now] * bool(now) + [[i]]
            now = []
            continue
        if now and sum(sizes[k] for k in now) + n > size:
            chunks.append(now)
            fits = [k for k in range(len(now)) if sum(sizes[j] for j in now[k:]) <= budget]
            now = now[min(fits) :] if fits and min(fits) > 0 else []
        now = [*now, i]
    return chunks + [now] * bool(now)


def folded(blocks, size, overlap):
    fold = chunk._Greedy(size, overlap, str.split)
    return [c for b in blocks for c in fold.add(b)] + fold.end()


def test_a_large_file_is_never_whole(spark):
    """20,000 blocks of one file and one of another, in batches of a few rows: the fold keeps less than a chunk."""
    blocks = spark.range(20_001).selectExpr("IF(id = 20000, 2L, 1L) AS file_id", "id AS pos", "'text' AS block_type", "concat('word', id % 7, ' a b') AS text", "1 AS page", "CAST(NULL AS STRING) AS section_path")
    got = chunk.chunk_naive(blocks.repartition(7), 300, 0.0).orderBy("file_id", "chunk_order").collect()
    assert [r.chunk_order for r in got if r.file_id == 1] == list(range(len(got) - 1)) and got[-1].content == "word1 a b"
    assert "\n".join(r.content for r in got[:-1]) == "\n".join(f"word{k % 7} a b" for k in range(20_000))
    fold = chunk._Greedy(300, 0.1, str.split)
    most = 0
    for k in range(5000):
        fold.add((f"word{k} a b", "text", 1, None))
        most = max(most, sum(n for _, n in fold.waiting))
    assert most <= 300


@SLOW
@given(st.lists(st.integers(1, 12), min_size=1, max_size=25), st.integers(4, 12), st.sampled_from([0.0, 0.1, 0.3, 0.5]))
def test_chunks_carry_whole_blocks(sizes, size, overlap):
    sizes = [min(n, size) for n in sizes]
    made = [(" ".join(f"b{i}w{k}" for k in range(n)), "text", 1, None) for i, n in enumerate(sizes)]
    found = folded(made, size, overlap)
    assert [c[0].split("\n") for c in found] == [[made[i][0] for i in c] for c in carried(sizes, size, int(size * overlap))]


def test_blocks_that_all_fit_the_overlap_are_not_carried():
    words = [" ".join("b" * 2), " ".join("b" * 2), " ".join("c" * 98)]
    found = folded([(w, "text", 1, None) for w in words], 100, 0.1)
    assert [c[0] for c in found] == ["b b\nb b", words[2]]


def test_tables_are_chunks_of_their_own(spark):
    found = chunk.chunk_naive(blocks(spark, ("one", "text"), ("a\tb", "table"), ("two", "text"), ("three", "text"))).orderBy("chunk_order").collect()
    assert [(r.content, r.skip_summary) for r in found] == [("one", False), ("a\tb", True), ("two\nthree", False)]


def test_long_blocks_slide(spark):
    found = contents(chunk.chunk_naive(blocks(spark, (" ".join("abcdefghij"), "text")), size=8, overlap=0.25))
    assert found[0] == "a b c d" and found[-1].endswith("j")


def test_question_and_answer(spark):
    text = "preface\nQ1: where to?\nto the sea\n问2：几时？\n明天"
    assert contents(chunk.chunk_qa(blocks(spark, (text, "text")))) == ["Q1: where to?\nto the sea", "问2：几时？\n明天"]
    plain = blocks(spark, ("no marks here", "text"))
    assert contents(chunk.chunk_qa(plain)) == contents(chunk.chunk_naive(plain))


def test_simhash_follows_its_definition(spark):
    import hashlib
    from collections import Counter

    def by_counts(text):
        squeezed = re.sub(r"\s+", "", text.lower())
        pairs = Counter(map("".join, zip(squeezed, squeezed[1:], strict=False))) if len(squeezed) > 1 else Counter(squeezed)
        ones = Counter()
        for pair, n in pairs.items():
            number = int(hashlib.blake2b(pair.encode(), digest_size=8).hexdigest(), 16)
            ones.update({k: n for k in range(64) if number & 1 << k})
        value = sum(1 << k for k, n in ones.items() if 2 * n > pairs.total())
        return value - (value >> 63 << 64)

    texts = ["", "x", " \n", "Good  Morning", "高山 流水", "a\U0001f642b", "over the hills and far away " * 9, "y"]
    got = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select(chunk.simhash64("t").alias("h")).collect()
    assert [r.h for r in got] == [*map(by_counts, texts), None]


def test_hash_embeddings_don_t_change(spark):
    v = spark.createDataFrame([("one",), ("one",), ("two",)], "t string").select(chunk.hash_embedding(4)("t").alias("v")).collect()
    assert v[0].v == v[1].v != v[2].v and abs(sum(x * x for x in v[2].v) - 1) < 1e-6
    rng = random.Random(int.from_bytes(__import__("hashlib").sha256(b"one").digest(), "big"))
    raw = [rng.gauss(0, 1) for _ in range(4)]
    length = sum(x * x for x in raw) ** 0.5
    assert all(abs(a - b / length) < 1e-6 for a, b in zip(v[0].v, raw, strict=True))


def test_summary_windows_close_at_the_limit(spark):
    rows = [(1, k, n, k == 2) for k, n in enumerate([4, 6, 99, 3, 3, 5, 1])] + [(2, k, 1, False) for k in range(9)]
    got = chunk.summary_windows(spark.createDataFrame(rows, "file_id long, chunk_order long, n_tokens int, skip_summary boolean"), 10, 20, 5)
    assert sorted((r.file_id, r.chunk_order, r.window_no) for r in got.collect()) == [(1, 0, 0), (1, 1, 0), (1, 3, 1), (1, 4, 1), (1, 5, 1), (1, 6, 2)]


def test_summaries_are_validated(spark):
    good = '```json\n[{"summary_text":"s","source_chunk_ids":["a","x"],"coverage":"yes"},{"summary_text":"t","source_chunk_ids":["x"],"coverage":"yes"}]\n```'
    rows = spark.createDataFrame([(1, good, ["a"]), (2, "no json", ["a"]), (3, None, ["a"])], "file_id long, answer string, allowed array<string>")
    assert [(r.file_id, r.summary_text, r.source_chunk_ids) for r in chunk.validate_summaries(rows).collect()] == [(1, "s", ["a"])]


def test_near_segments_are_complete(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = base + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(3)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    rows = spark.createDataFrame([(f"{i:03}", 1, s) for i, s in enumerate(signed)], "chunk_key string, file_id long, simhash long")
    rows = rows.unionByName(rows.limit(4).withColumn("chunk_key", F.concat(F.lit("z"), "chunk_key"))).withColumn("file_id", F.col("chunk_key").isin("003", "z003").cast("long"))
    all_rows = rows.collect()
    for within in (True, False):
        got = {r.chunk_key: (r.class_key, r.n_links) for r in chunk.near_duplicate_segments(rows, within_file=within).collect()}
        for a in all_rows:
            near = [b for b in all_rows if bin((a.simhash ^ b.simhash) & (1 << 64) - 1).count("1") <= 3 and (not within or a.file_id == b.file_id)]
            same = [b.chunk_key for b in near if b.simhash == a.simhash]
            assert got[a.chunk_key] == (min(same), len(near) - 1)


def test_quota_admission(spark):
    uploads = spark.createDataFrame([(0, "2024-01", k, 10) for k in range(3)] + [(1, "2024-01", k, 60) for k in range(3)], "tenant_id long, period string, seq long, bytes long")
    limits = spark.createDataFrame([(0, 2, 0), (1, 0, 100)], "tenant_id long, max_docs long, max_bytes long")
    got = audit.admit_uploads(uploads, limits).orderBy("tenant_id", "seq").collect()
    assert [r.admitted for r in got] == [True, True, False, True, False, False]


@SLOW
@given(st.lists(st.tuples(st.sampled_from([-1, 1]), st.integers(0, 50)), min_size=1, max_size=40))
def test_meter_is_the_clamped_fold(spark, steps):
    docs = size = 0
    for d, b in steps:
        docs, size = max(0, docs + d), max(0, size + d * b)
    rows = spark.createDataFrame([(1, "p", k, d, b) for k, (d, b) in enumerate(steps)], "tenant_id long, period string, seq long, doc_delta int, bytes long")
    got = audit.meter(rows).first()
    assert (got.docs, got.bytes) == (docs, size)


@SLOW
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["index", "set_available", "delete"]), st.integers(0, 1)), min_size=1, max_size=40))
def test_change_log_is_the_fold(spark, events):
    index = {}
    for doc, kind, flag in events:
        if kind == "index":
            index[doc] = 0
        elif kind == "delete":
            index.pop(doc, None)
        elif doc in index:
            index[doc] = flag
    rows = spark.createDataFrame([(k, d, e, f if e == "set_available" else None) for k, (d, e, f) in enumerate(events)], "seq long, doc_key long, event_type string, available int")
    assert {r.doc_key: r.available for r in versions.apply_change_log(rows).collect()} == index


@SLOW
@given(st.lists(st.integers(0, 6), max_size=12), st.lists(st.integers(0, 6), max_size=12))
def test_fusion_is_the_loop(spark, a, b):
    scores, first = {}, {}
    for tag, hits in (("a", a), ("b", b)):
        seen = set()
        for rank, c in enumerate(hits):
            if c not in seen:
                seen.add(c)
                scores[c] = scores.get(c, 0) + 1 / (60 + rank)
                first.setdefault(c, (tag, rank))
    want = sorted(scores, key=lambda c: (-round(scores[c], 9), first[c]))
    table = lambda hits: spark.createDataFrame([(1, r, str(c), c, "x") for r, c in enumerate(hits)], "query_id long, rank int, chunk_key string, file_id long, content string")
    got = retrieval.rrf_merge(table(a), table(b)).orderBy("rank").collect()
    assert [int(r.chunk_key) for r in got] == want


def test_chain_finds_tampering(spark):
    rows = spark.createDataFrame([(k, 1 if k % 2 else None, "a", "ok") for k in range(20)], "id long, tenant_id long, action string, result string")
    chained = audit.build_chain(rows)
    assert all(r.verified and not r.gaps for r in audit.verify_chain(chained).collect())
    changed = audit.verify_chain(chained.withColumn("result", F.when(F.col("id") == 5, "no").otherwise(F.col("result")))).where("tenant_id = 1").first()
    assert (changed.mismatches, changed.breaks, changed.first_mismatch_id) == (1, 0, 5)
    broken = audit.verify_chain(chained.withColumn("prev_hash", F.when(F.col("id") == 7, "0").otherwise(F.col("prev_hash")))).where("tenant_id = 1").first()
    assert broken.breaks == 1 and broken.first_break_id == 7 and not broken.verified


def test_addresses_are_canonical(spark):
    got = spark.createDataFrame([("2001:DB8::0:1",), ("10.0.0.1",), ("x",), (None,)], "ip string").select(audit.canonical_ip("ip").alias("c")).collect()
    assert [r.c for r in got] == ["2001:db8::1", "10.0.0.1", "x", None]


def test_context_skips_blank_hits(spark):
    hits = spark.createDataFrame([(1, 0, "a", 1, " x "), (1, 1, "b", 1, "  "), (1, 2, "c", 1, "y" * 20)], "query_id long, rank int, chunk_key string, file_id long, content string")
    got = retrieval.build_context(hits, limit=3, chars=10).first()
    assert got.context == "[1] x\n\n[2] " + "y" * 10 + "…" and [r.chunk_key for r in got.refs] == ["a", "c"]


def test_metric_text(spark):
    lines = spark.createDataFrame([(0, "# HELP x"), (1, "req_total{a} 3"), (2, "req_total{b} 4.5"), (3, "other 9")], "pos int, value string")
    got = metrics.sum_metric(lines, "req_total").first()
    assert (got.total, got["first"]) == (7.5, 3.0)


def test_read_corpus(spark, tmp_path):
    (tmp_path / "a.md").write_text("é")
    (tmp_path / "b.bin").write_bytes(b"x")
    got = parse.read_corpus(spark, str(tmp_path), "*.md").collect()
    assert [(r.name, r.size_bytes, r.text) for r in got] == [("a.md", 2, "é")]


def test_failed_embedding_batches_take_the_pseudo_vectors(spark):
    rows = spark.createDataFrame([("good",), ("bad",)], "content string")

    def model(texts):
        if "bad" in texts:
            raise ValueError
        return [[1.0, 2.0]] * len(texts)

    got = {r.content: r.vector for r in chunk.embed_batch(rows, model, 2, batch=1).collect()}
    assert got["good"] == [1.0, 2.0] and abs(sum(x * x for x in got["bad"]) - 1) < 1e-6




def test_access_is_of_a_user_in_a_tenant(spark):
    members = spark.createDataFrame([(1, 10, "owner"), (1, 20, "viewer"), (2, 20, "editor")], "user_id long, tenant_id long, role string")
    kbs = spark.createDataFrame([("a", 10, "me"), ("b", 20, "team"), ("c", 20, "me")], "kb_id string, tenant_id long, visibility string")
    grants = spark.createDataFrame([(3, "c", "admin"), (1, "b", "viewer")], "user_id long, kb_id string, role string")
    asked = spark.createDataFrame([(1, 10), (1, 20), (2, 20), (3, 20), (4, 10)], "user_id long, tenant_id long")
    who = access.principals(asked, members)
    got = {(r.user_id, r.tenant_id, r.kb_id): r.role for r in access.resolve_access(who, kbs, grants).collect()}
    assert got == {(1, 10, "a"): "owner", (1, 10, "b"): "viewer", (1, 20, "b"): "viewer", (2, 20, "b"): "viewer", (3, 20, "c"): "admin"}
    cleared = {(r.user_id, r.tenant_id): r.clearance for r in access.clearance(who, grants).collect()}
    assert cleared == {(1, 10): 4, (1, 20): 1, (2, 20): 2, (3, 20): 3, (4, 10): 0}
    queries = asked.withColumn("query_id", F.col("user_id") * 100 + F.col("tenant_id"))
    links = spark.createDataFrame([(7, "a"), (8, "b"), (9, "c")], "file_id long, kb_id string")
    files = {(r.query_id, r.file_id, r.clearance) for r in access.authorised_files(queries, members, kbs, grants, links).collect()}
    assert files == {(110, 7, 4), (120, 8, 1), (220, 8, 2), (320, 9, 3)}  # never a base of another tenant
    requested = queries.select("query_id", F.lit("c").alias("kb_id"))
    assert {r.query_id for r in access.authorised_files(queries, members, kbs, grants, links, requested).collect()} == {320}


def test_bulk_grants_keep_the_expiry(spark):
    e = [(1, 1, "k", "viewer", "grant", "2025-01-01"), (2, 1, "k", "admin", "bulk", None), (3, 2, "k", "viewer", "bulk", None), (4, 1, "j", "viewer", "grant", "2025-01-01"), (5, 1, "j", None, "revoke", None), (6, 1, "j", "editor", "bulk", None)]
    events = spark.createDataFrame(e, "seq long, user_id long, kb_id string, role string, op string, expires string").selectExpr("*", "to_date(expires) AS expires_date", "DATE '2024-06-01' AS event_date")
    got = {(r.user_id, r.kb_id): (r.role, str(r.expires_date), r.revoked_date) for r in access.apply_grants(events).collect()}
    assert got == {(1, "k"): ("admin", "2025-01-01", None), (2, "k"): ("viewer", "None", None), (1, "j"): ("editor", "2025-01-01", None)}


def test_search_reads_what_is_available_and_cleared(spark):
    docs = [("a", 1, 0, "same words", [1.0, 0.0], 1, 0), ("b", 1, 0, "same words", [1.0, 0.0], 0, 0), ("c", 2, 0, "same words", [1.0, 0.0], 1, 3), ("d", 3, 1, "same words", [1.0, 0.0], 1, 0)]
    docs = spark.createDataFrame(docs, "doc_key string, file_id long, tenant_id long, content string, embedding array<double>, available int, sensitivity int")
    queries = spark.createDataFrame([(1, "same", [1.0, 0.0]), (2, "same", [1.0, 0.0]), (3, "same", [1.0, 0.0])], "query_id long, query_text string, q_vec array<double>")
    allowed = spark.createDataFrame([(1, 0, 1, 2), (1, 0, 2, 2), (2, 0, 2, 4), (1, 0, 3, 4)], "query_id long, tenant_id long, file_id long, clearance int")
    got = {(r.query_id, r.chunk_key) for r in retrieval.hybrid_search(queries, docs, allowed).collect()}
    assert got == {(1, "a"), (2, "c")}  # d is a file of another tenant


def test_top_k_is_cut_before_the_shuffle(spark):
    docs = spark.createDataFrame([("a", 0, [1.0])], "doc_key string, tenant_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, 0, [1.0])], "query_id long, tenant_id long, q_vec array<double>")
    plan = retrieval.knn_topk(queries, docs, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "BroadcastNestedLoop" not in plan
    hits = spark.createDataFrame([(1, 5, "x", 1, "t", 0.5)], "query_id long, rank int, chunk_key string, file_id long, content string, score double")
    assert retrieval.cut(hits, 2).first()["rank"] == 0
