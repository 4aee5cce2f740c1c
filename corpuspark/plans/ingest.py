"""Queries of parsing and chunking."""

import hashlib
from functools import cache

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuspark.functions.expr import hamming, hex_to_signed, signed_to_hex
from corpuspark.operators import chunk, parse
from corpuspark.plans.base import query
from corpuspark.sources.staging import among, fresh_path


def one_block(rows, text="content"):
    return rows.select("file_id", F.col("chunk_order").alias("pos"), F.lit("text").alias("block_type"), F.col(text).alias("text"), F.lit(1).alias("page"), F.lit(None).cast("string").alias("section_path"))


def markdown(v):
    line = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x.line)
    return v.v_markdown.groupBy("file_id").agg(F.array_join(line, "\n").alias("text"))


#: The characters of the given tables that aren't white space, lower-cased, and more that may come.
ALPHABET = "".join(chr(c) for c in range(33, 127) if not 65 <= c <= 90) + "ßàáâäåæçèéêëìíîïñòóôöøùúûüœ"


@cache
def _pair_hashes() -> str:
    """The hash that the definition gives each pair of the alphabet, and each character of its own, in hexadecimal digits."""
    pairs = [a + b for a in ALPHABET for b in ALPHABET] + list(ALPHABET)
    return b"".join(hashlib.blake2b(p.encode(), digest_size=8).digest() for p in pairs).hex()


def simhash_sql(table: str, key: str, text: str, name: str) -> str:
    """Common table expressions that end in ``name`` (key, h): the 64-bit SimHash of each row's text, counted bit by bit."""
    n = len(ALPHABET)
    sign = "-9223372036854775808"
    votes = ", ".join(f"sum(CASE WHEN (h >> {k}) & 1 = 1 THEN n ELSE -n END) AS b{k}" for k in range(64))
    value = " + ".join(f"CASE WHEN b{k} > 0 THEN {1 << k if k < 63 else sign} ELSE 0 END" for k in range(64))
    quoted = ALPHABET.replace("'", "''")
    return f"""{name}_p AS (SELECT CASE WHEN i < {n * n} THEN substr(a, i // {n} + 1, 1) || substr(a, i % {n} + 1, 1) ELSE substr(a, i - {n * n} + 1, 1) END AS f,
  CAST('0x' || substr(d, 16 * i + 1, 16) AS UBIGINT) AS h FROM (SELECT CAST(i AS INT) AS i, '{quoted}' AS a, '{_pair_hashes()}' AS d FROM range({n * n + n}) t(i))),
{name}_s AS (SELECT {key} AS k, regexp_replace(lower({text}), '\\s+', '', 'g') AS s FROM {table}),
{name}_f AS (SELECT k, f, count(*) AS n FROM (SELECT k, unnest(list_transform(range(1, greatest(len(s), 2)), lambda i: substr(s, i, 2))) AS f FROM {name}_s) WHERE f <> '' GROUP BY 1, 2),
{name}_b AS (SELECT k, {votes} FROM {name}_f JOIN {name}_p USING (f) GROUP BY 1),
{name} AS (SELECT s.k AS {key}, coalesce(CAST({value} AS BIGINT), 0) AS h FROM {name}_s s LEFT JOIN {name}_b b ON b.k = s.k)"""


FINGERPRINT = "CAST(concat('0x', substr(sha256({}), 1, 15)) AS BIGINT)"


def fingerprint(text):
    """15 hex digits of a SHA-256 as a long: arbitrary bits, to measure distances of."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


@query(
    "s1_read_files",
    """SELECT file_id, CASE WHEN file_id % 5 = 0 THEN 'html' ELSE 'text' END AS format, strlen(content) + 1 AS size_bytes, sha256(content || chr(10)) AS digest FROM {v_file} WHERE content IS NOT NULL""",
)
def s1_files(v):
    """The documents written as files of their own, one in five as HTML, and read back as such: name, format, size, bytes."""
    path = fresh_path(v.spark, "files")
    nth = F.row_number().over(Window.partitionBy("file_id").orderBy("content"))  # rows of one id are files of their own
    again = v.v_file.groupBy("file_id").agg(F.count("*").alias("n")).where("n > 1").select("file_id")
    texts = v.v_file.where("content IS NOT NULL").select("file_id", "content")  # only those of repeated ids are shuffled
    numbered = among(texts, again, "file_id", inside=False).withColumn("nth", F.lit(1)).unionByName(among(texts, again, "file_id").withColumn("nth", nth))
    ending = F.when(F.col("file_id") % 5 == 0, ".html").otherwise(".md")
    name = F.concat(F.coalesce(F.col("file_id").cast("string"), F.lit("none")), F.lit("_"), F.col("nth").cast("string"), ending)
    parse.write_corpus(numbered.select(name.alias("name"), F.concat("content", F.lit("\n")).alias("content")), path)
    files = parse.read_corpus(v.spark, path, "*.{md,html}")
    kind = parse.classify_format(F.lit(None).cast("string"), F.col("name"))
    return files.select(F.nullif(F.regexp_extract("name", r"^-?\d+", 0), F.lit("")).cast("long").alias("file_id"), kind.alias("format"), "size_bytes", F.sha2("content", 256).alias("digest"))


@query("s1_read_corpus", "SELECT file_id, name, strlen(content) AS size_bytes, sha256(content) AS digest FROM {v_file}")
def s1(v):
    return v.v_file.select("file_id", "name", F.octet_length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("digest"))


@query(
    "s2_classify_format",
    """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'pdf' WHEN page_id % 5 = 1 THEN 'html' WHEN page_id % 5 = 2 THEN 'text' WHEN page_id % 5 = 3 THEN 'xlsx' ELSE 'text' END AS format
FROM {pages}""",
)
def s2(v):
    p = F.col("page_id") % 5
    mime = F.when(p == 0, "Application/PDF").when(p == 2, "text/markdown").when(p == 4, "image/png")
    name = F.concat(F.col("url"), F.when(p == 1, "x.HTM").when(p == 3, "a.b/table.xlsx").otherwise("/none"))
    return v.pages.select("page_id", parse.classify_format(mime, name).alias("format"))


@query(
    "s3_parse_markdown",
    """WITH l AS (SELECT file_id, line_no, line, starts_with(trim(line), '#') AS title FROM {v_markdown}),
s AS (SELECT *, 2 * sum(title::INT) OVER w - title::INT AS segment, CASE WHEN title THEN nullif(trim(ltrim(trim(line), '#')), '') END AS named FROM l WINDOW w AS (PARTITION BY file_id ORDER BY line_no)),
n AS (SELECT *, last_value(named IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_no) AS section FROM s),
b AS (SELECT file_id, segment, bool_or(title) AS title, first(section ORDER BY line_no) AS section_path, min(line_no) AS n,
  CASE WHEN bool_or(title) THEN first(trim(line)) ELSE trim(string_agg(line, chr(10) ORDER BY line_no), ' ' || chr(10)) END AS text FROM n GROUP BY 1, 2)
SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY n) - 1 AS INT) AS pos, CASE WHEN title THEN 'title' ELSE 'text' END AS block_type, section_path, text FROM b WHERE text <> ''""",
)
def s3(v):
    return parse.parse_markdown(markdown(v)).select("file_id", "pos", "block_type", "section_path", "text")


@query("s4_parse_html")
def s4(v):
    return parse.parse_html(v.pages)


@query(
    "s5_batch_table_rows",
    """SELECT l_suppkey AS file_id, CAST(n // 50 AS BIGINT) AS pos, string_agg(l_orderkey || chr(9) || l_linenumber, chr(10) ORDER BY n) AS text
FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS n FROM {lineitem}) GROUP BY 1, 2""",
)
def s5(v):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber")) - 1
    cells = v.lineitem.select(F.col("l_suppkey").alias("file_id"), n.alias("row"), F.array(F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("cells"))
    return parse.batch_table_rows(cells).select("file_id", "pos", "text")


@query(
    "s6_split_blocks",
    """SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY chunk_order, p) - 1 AS INT) AS pos, text FROM (
  SELECT file_id, chunk_order, p, trim(x) AS text FROM (SELECT file_id, chunk_order, unnest(string_split_regex(content, '[.,]')) AS x, generate_subscripts(string_split_regex(content, '[.,]'), 1) AS p FROM {v_line}))
WHERE text <> ''""",
)
def s6(v):
    return parse.split_blocks(one_block(v.v_line), ".,").select("file_id", "pos", "text")


@query("s7_scan_index", "SELECT doc_key, available FROM {v_index}")
def s7(v):
    return parse.scan_index(v.v_index, "doc_key", "available")


@query("c1_chunk_naive")
def c1(v):
    return chunk.chunk_naive(parse.parse_markdown(markdown(v)), 128)


@query(
    "c2_chunk_one",
    "SELECT file_id, trim(string_agg(line, chr(10) ORDER BY line_no), ' ' || chr(10)) AS content FROM {v_markdown} GROUP BY 1",
)
def c2(v):
    rows = v.v_markdown.select("file_id", F.col("line_no").alias("chunk_order"), F.col("line").alias("content"))
    return chunk.chunk_one(one_block(rows)).select("file_id", "content")


@query("c3_chunk_delimiter")
def c3(v):
    return chunk.chunk_delimiter(one_block(v.v_line), "\n.", 64)


@query("c4_chunk_qa")
def c4(v):
    asked = F.concat(F.when(F.col("chunk_order") % 4 == 0, "Q: ").otherwise(""), F.col("content"))
    return chunk.chunk_qa(one_block(v.v_line.withColumn("content", asked)), 128)


@query("c5_chunk_domain")
def c5(v):
    return chunk.chunk_domain(one_block(v.v_line), "tag", 64)


@query(
    "c6_resolve_parse_config",
    """SELECT f.file_id, coalesce(file_method, kb_method, 'naive') AS method FROM {v_file} f LEFT JOIN (
  SELECT file_id, arg_min(kb_method, l.kb_id) AS kb_method FROM {v_file_kb} l JOIN {v_kb} k ON k.kb_id = l.kb_id WHERE kb_method IS NOT NULL GROUP BY 1) k ON k.file_id = f.file_id""",
)
def c6(v):
    return chunk.resolve_parse_config(v.v_file, v.v_file_kb, v.v_kb)


@query(
    "c7_chunk_id",
    """SELECT file_id, chunk_order, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-',
  lower(hex((CAST('0x' || substr(h, 17, 2) AS INT) & 63) | 128)), substr(h, 19, 2), '-', substr(h, 21, 12)) AS id
FROM (SELECT file_id, chunk_order, sha1(unhex('7b3a2c1e5d4f4a8b9c6e1f2d3a4b5c6d') || encode(concat(file_id, ':1:', chunk_order))) AS h FROM {v_line})""",
)
def c7(v):
    return v.v_line.select("file_id", "chunk_order", chunk.chunk_id(F.col("file_id"), F.lit(1), F.col("chunk_order")).alias("id"))


@query("c8_content_hash", "SELECT file_id, chunk_order, sha256(content) AS hash FROM {v_line}")
def c8(v):
    return v.v_line.select("file_id", "chunk_order", chunk.content_hash(F.col("content")).alias("hash"))


@query(
    "c9_simhash64",
    f"""WITH t AS (SELECT file_id || ':' || chunk_order AS k0, file_id, chunk_order, content FROM {{v_line}}), {simhash_sql("t", "k0", "content", "sh")}
SELECT file_id, chunk_order, h AS simhash FROM t JOIN sh USING (k0)""",
)
def c9(v):
    return v.v_line.select("file_id", "chunk_order", chunk.simhash64("content").alias("simhash"))


@query(
    "c10_hamming",
    f"""SELECT file_id, chunk_order, bit_count(xor(f, g)) AS distance, bit_count(xor(f, g)) <= 24 AS near, printf('%016x', f) AS digits
FROM (SELECT *, {FINGERPRINT.format("content")} AS f, {FINGERPRINT.format("file_id::VARCHAR")} AS g FROM {{v_line}})""",
)
def c10(v):
    f, g = F.col("f"), F.col("g")
    rows = v.v_line.select("file_id", "chunk_order", fingerprint(F.col("content")).alias("f"), fingerprint(F.col("file_id").cast("string")).alias("g"))
    back = hex_to_signed(signed_to_hex(f))
    return rows.select("file_id", "chunk_order", hamming(back, g).cast("byte").alias("distance"), chunk.same_segment(f, g, 24).alias("near"), signed_to_hex(f).alias("digits"))


@query(
    "c11_near_duplicate_segments",
    f"""WITH t AS (SELECT chunk_key, content FROM {{v_chunk_v1}}), {simhash_sql("t", "chunk_key", "content", "sh")},
f AS (SELECT c.file_id, c.chunk_key, h FROM {{v_chunk_v1}} c JOIN sh USING (chunk_key)),
n AS (SELECT a.chunk_key, count(*) - 1 AS n_links FROM f a JOIN f b ON a.file_id = b.file_id AND bit_count(xor(a.h, b.h)) <= 3 GROUP BY 1)
SELECT f.chunk_key, min(f.chunk_key) OVER (PARTITION BY file_id, h) AS class_key, n_links FROM f JOIN n USING (chunk_key)""",
)
def c11(v):
    return chunk.near_duplicate_segments(v.v_chunk_v1.select("chunk_key", "file_id", chunk.simhash64("content").alias("simhash")))


@query(
    "c11_near_duplicates_anywhere",
    f"""WITH t AS (SELECT chunk_key, content FROM {{v_chunk_v1}}), {simhash_sql("t", "chunk_key", "content", "sh")},
d AS (SELECT h, count(*) AS n, min(chunk_key) AS class_key FROM sh GROUP BY 1),
b AS (SELECT h, n, k, (h >> (16 * k)) & 65535 AS v FROM d, (SELECT unnest([0, 1, 2, 3]) AS k) x),
l AS (SELECT h, sum(n) AS near FROM (SELECT DISTINCT a.h, c.h AS o, c.n FROM b a JOIN b c ON a.k = c.k AND a.v = c.v AND a.h <> c.h AND bit_count(xor(a.h, c.h)) <= 3) GROUP BY 1)
SELECT s.chunk_key, d.class_key, (d.n - 1 + coalesce(near, 0))::BIGINT AS n_links FROM sh s JOIN d ON d.h = s.h LEFT JOIN l ON l.h = s.h""",
)
def c11_anywhere(v):
    return chunk.near_duplicate_segments(v.v_chunk_v1.select("chunk_key", "file_id", chunk.simhash64("content").alias("simhash")), within_file=False)


@query(
    "c12_token_count",
    r"SELECT file_id, chunk_order, CAST(len(regexp_extract_all(content, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')) AS INT) AS n FROM {v_line}".replace("{L}", "{{L}}").replace("{N}", "{{N}}").replace("{{", "{").replace("}}", "}"),
)
def c12(v):
    return v.v_line.select("file_id", "chunk_order", chunk.token_count(F.col("content")).alias("n"))


@query("c13_hash_embedding")
def c13(v):
    return v.v_line.select("file_id", "chunk_order", chunk.hash_embedding(16)("content").alias("vector"))


@query("c14_embed_batch")
def c14(v):
    def letters(texts):
        return [[float(t.count(c)) for c in "aeiou"] for t in texts]

    return chunk.embed_batch(v.v_line, letters, 5).select("file_id", "chunk_order", "vector")


def counted(v):
    return v.v_chunk_v1.select("file_id", "chunk_key", "chunk_order", "version", chunk.token_count(F.col("content")).alias("n_tokens"), (F.col("chunk_order") % 9 == 8).alias("skip_summary"))


TOKEN_COUNT = r"len(regexp_extract_all(content, '[\pL\pN_]+|[^\s\pL\pN_]'))"


@query(
    "c15_summary_windows",
    f"""WITH RECURSIVE t AS (SELECT file_id, chunk_order, {TOKEN_COUNT} AS m FROM {{v_chunk_v1}} WHERE chunk_order % 9 <> 8),
e AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY chunk_order) AS n FROM t QUALIFY sum(m) OVER (PARTITION BY file_id) >= 50 AND count(*) OVER (PARTITION BY file_id) >= 5),
w AS (SELECT file_id, chunk_order, n, 0 AS window_no, m AS total FROM e WHERE n = 1
  UNION ALL SELECT e.file_id, e.chunk_order, e.n, w.window_no + (w.total >= 200)::INT, CASE WHEN w.total >= 200 THEN e.m ELSE w.total + e.m END FROM w JOIN e ON e.file_id = w.file_id AND e.n = w.n + 1)
SELECT file_id, chunk_order, window_no FROM w""",
)
def c15(v):
    return chunk.summary_windows(counted(v), 200, 50, 5)


def answers(v):
    """A model answer for each file in JSON: its summary with its sources, some of them foreign, fenced for even files."""
    source = F.when(F.col("pos") == F.col("file_id") % 5, F.lit("foreign")).otherwise(F.col("chunk_key"))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("pos", source.alias("k")))), lambda s: s.k)
    rows = v.v_source.groupBy("file_id", "summary_key").agg(ids.alias("source_chunk_ids"), F.collect_list("chunk_key").alias("allowed"))
    coverage = F.element_at(F.array(F.lit("yes"), F.lit("uncertain"), F.lit("no")), (F.col("file_id") % 3 + 1).cast("int"))
    item = F.to_json(F.array(F.struct(F.col("summary_key").alias("summary_text"), "source_chunk_ids", coverage.alias("coverage"), F.array(F.lit("a"), F.col("summary_key")).alias("heading_path"))))
    fenced = F.when(F.col("file_id") % 2 == 0, F.concat(F.lit("```json\n"), item, F.lit("\n```"))).otherwise(item)
    return rows.select("file_id", fenced.alias("answer"), "allowed")


VALID = """valid AS (SELECT file_id, summary_key, list(chunk_key ORDER BY pos) FILTER (pos <> file_id % 5) AS ids FROM {v_source} WHERE file_id % 3 < 2 GROUP BY 1, 2)"""


@query("c16_validate_summaries", f"WITH {VALID} SELECT file_id, summary_key AS summary_text, array_to_string(ids, ',') AS ids FROM valid")
def c16(v):
    return chunk.validate_summaries(answers(v)).select("file_id", "summary_text", F.array_join("source_chunk_ids", ",").alias("ids"))


@query(
    "c17_coverage_ratio",
    f"""WITH {VALID}, c AS (SELECT file_id, count(*) FILTER (chunk_order % 9 <> 8) AS n FROM {{v_chunk_v1}} GROUP BY 1)
SELECT c.file_id, CASE WHEN n > 0 THEN coalesce(len(ids), 0) / n ELSE 0.0 END AS coverage_ratio FROM c LEFT JOIN valid ON valid.file_id = c.file_id""",
)
def c17(v):
    return chunk.coverage_ratio(counted(v), chunk.validate_summaries(answers(v)))


@query(
    "c18_build_anchors",
    f"""WITH {VALID}, t AS (SELECT s.file_id, summary_key, ids[1] AS target_chunk_id, content FROM valid s JOIN {{v_chunk_v1}} c ON c.chunk_key = ids[1]), {simhash_sql("t", "target_chunk_id", "content", "sh")}
SELECT file_id, summary_key, t.target_chunk_id, 'a/' || summary_key AS section_path, sha256(content) AS target_content_hash, h AS simhash FROM t JOIN sh ON sh.target_chunk_id = t.target_chunk_id""",
)
def c18(v):
    summaries = chunk.validate_summaries(answers(v)).withColumnRenamed("summary_text", "summary_key")
    cited = v.v_chunk_v1.join(v.v_source.where("pos <= 1").select("chunk_key").distinct(), "chunk_key", "left_semi")  # first sources, foreign ones left out
    anchors = chunk.build_anchors(summaries, cited.withColumn("simhash", chunk.simhash64("content")))
    return anchors.select("file_id", "summary_key", "target_chunk_id", "section_path", "target_content_hash", "simhash")


@query(
    "c19_build_index_docs",
    """SELECT chunk_key AS doc_key, file_id, sha256(content) AS digest, chunk_order, 'chunk' AS doc_type, NULL::DOUBLE AS coverage_ratio, 0 AS available FROM {v_chunk_v1}
UNION ALL SELECT summary_key, file_id, sha256(summary_text), NULL, 'summary', coverage_ratio, 0 FROM {v_summary}""",
)
def c19(v):
    return chunk.build_index_docs(v.v_chunk_v1, v.v_summary).select("doc_key", "file_id", F.sha2("content", 256).alias("digest"), "chunk_order", "doc_type", "coverage_ratio", "available")


@query("c20_ingest_cost", "SELECT file_id, sum(chunks)::BIGINT AS chunks, sum(tokens)::BIGINT AS tokens FROM {v_cost_log} GROUP BY 1")
def c20(v):
    each = v.v_cost_log.select("file_id", F.explode(F.sequence(F.lit(1), F.col("chunks"))).alias("k"), F.col("chunks"), "tokens")
    per_chunk = each.select("file_id", F.when(F.col("k") == 1, F.col("tokens")).otherwise(F.lit(0)).alias("n_tokens"))
    return chunk.ingest_cost(per_chunk, "emb").select("file_id", "chunks", "tokens")
