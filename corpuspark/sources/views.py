"""Model tables as views over the given tables, in SQL that Spark and DuckDB both read.

``{name}`` stands for another view or a given table. ``view`` builds one in Spark; ``with_views`` expands them in a DuckDB query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from corpuspark.sources.staging import spread

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
AS_OF = "2024-01-31 00:00:00"

VIEWS = {
    "v_file": """SELECT doc_id AS file_id, doc_id % 4 AS tenant_id, concat('doc_', CAST(doc_id AS STRING), '.md') AS name, text AS content,
  n_chars AS size_bytes, doc_id % 150 AS owner_user_id,
  CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN 'one' ELSE 'naive' END AS file_method,
  CASE WHEN doc_id % 11 = 0 THEN 'uploaded' ELSE 'ready' END AS status, DATE '2024-01-01' + CAST(doc_id % 60 AS INT) AS created_date
FROM {documents}""",
    "v_kb": """SELECT DISTINCT concat('t', CAST(doc_id % 4 AS STRING), '_', source) AS kb_id, doc_id % 4 AS tenant_id, source AS name,
  CASE CAST(substr(source, 4) AS INT) % 3 WHEN 0 THEN 'me' WHEN 1 THEN 'team' ELSE 'tenant' END AS visibility,
  CASE WHEN CAST(substr(source, 4) AS INT) % 2 = 0 THEN 'delimiter' END AS kb_method
FROM {documents}""",
    "v_file_kb": """SELECT doc_id AS file_id, concat('t', CAST(doc_id % 4 AS STRING), '_', source) AS kb_id FROM {documents}
UNION SELECT doc_id, concat('t', CAST(doc_id % 4 AS STRING), '_src', CAST(doc_id % 4 AS STRING)) FROM {documents} WHERE doc_id % 5 = 0""",
    "v_user": """SELECT c_custkey AS user_id, c_name AS external_id, CAST(c_nationkey % 4 AS BIGINT) AS tenant_id,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'owner' WHEN 'MACHINERY' THEN 'admin' WHEN 'AUTOMOBILE' THEN 'editor' ELSE 'viewer' END AS role,
  CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment END AS department,
  CASE WHEN c_custkey % 15 = 0 THEN NULL ELSE concat('g', CAST(c_nationkey AS STRING)) END AS group_name
FROM {customer}""",
    "v_grant_event": """SELECT o_orderkey AS seq, o_custkey AS user_id,
  concat('t', CAST(o_orderkey % 4 AS STRING), '_src', CAST(o_orderkey % 20 AS STRING)) AS kb_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'admin' WHEN '2-HIGH' THEN 'editor' ELSE 'viewer' END AS role,
  CASE WHEN o_orderstatus = 'F' THEN 'revoke' WHEN o_orderkey % 5 = 0 THEN 'bulk' ELSE 'grant' END AS op,
  CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderdate AS DATE) + 365 END AS expires_date, CAST(o_orderdate AS DATE) AS event_date
FROM {orders}""",
    "v_query_log": """SELECT event_id AS id, user_id % 4 AS tenant_id, user_id,
  CASE WHEN event_id % 51 = 0 THEN NULL WHEN event_id % 50 = 0 THEN '' ELSE concat(event_type, ' ', CAST(user_id % 20 AS STRING)) END AS query_norm,
  event_id % 6 AS path_a_hits, event_id % 25 AS path_b_hits, event_type = 'purchase' AS rerank_used,
  CAST(floor(value * 10) AS INT) AS latency_ms, ts AS created_at
FROM {events}""",
    "v_chat_log": """SELECT event_id AS id, user_id % 4 AS tenant_id, user_id, props AS query,
  CASE event_type WHEN 'purchase' THEN 'answered' WHEN 'error' THEN 'error' ELSE 'no_result' END AS outcome,
  CASE WHEN event_type <> 'error' THEN concat('llm-', CAST(user_id % 3 AS STRING)) END AS model,
  event_id % 9 AS hits, CAST(floor(value * 10) AS INT) AS latency_ms, ts AS created_at
FROM {events} WHERE event_type IN ('purchase', 'error', 'view')""",
    "v_cost_log": """SELECT event_id AS id, user_id % 4 AS tenant_id, event_id % n_files AS file_id, event_id % 40 + 1 AS chunks,
  CAST(floor(value * 100) AS BIGINT) AS tokens, concat('emb-', CAST(user_id % 2 AS STRING)) AS model, ts AS created_at
FROM {events} CROSS JOIN (SELECT count(*) AS n_files FROM {documents}) n WHERE event_type = 'signup'""",
    "v_audit": """SELECT event_id AS id, CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id % 4 END AS tenant_id, user_id,
  event_type AS action, props AS query_text,
  CASE event_type WHEN 'error' THEN 'dropped' WHEN 'click' THEN 'reused' ELSE 'ok' END AS result, ts AS created_at
FROM {events}""",
    "v_outbox": """SELECT event_id AS seq, user_id AS aggregate_id, user_id % n_files AS file_id, event_id % n_keys AS doc_key,
  CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'set_available' WHEN 'purchase' THEN 'set_available' ELSE 'index' END AS event_type,
  CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 0 END AS available,
  CAST(event_id % 4 AS INT) AS attempts, CASE WHEN event_id % 10 < 8 THEN ts END AS published_at, ts AS created_at
FROM {events} CROSS JOIN (SELECT CAST(floor(count(*) / 37) AS BIGINT) + 1 AS n_keys FROM {events}) k CROSS JOIN (SELECT count(*) AS n_files FROM {documents}) n""",
    "v_access_log": """SELECT event_id AS id, user_id, CASE WHEN event_type IN ('view', 'click') THEN 'GET' ELSE 'POST' END AS method,
  concat('/v1/docs/', CAST(event_id AS STRING)) AS path,
  CASE event_type WHEN 'error' THEN '500' WHEN 'signup' THEN '429' ELSE '200' END AS status, value / 100 AS seconds, ts AS created_at
FROM {events}""",
    "v_meter_event": """SELECT event_id AS seq, user_id % 4 AS tenant_id, CASE WHEN event_type IN ('error', 'click', 'view') THEN -1 ELSE 1 END AS doc_delta,
  CAST(floor(value * 1000) AS BIGINT) AS bytes, substr(CAST(ts AS STRING), 1, 7) AS period
FROM {events}""",
    "v_message": """SELECT conv_id * 1000 + turn AS id, conv_id, conv_id % 150 AS user_id, conv_id % 4 AS tenant_id, role, text AS content,
  CASE WHEN conv_id % 3 = 0 THEN NULL ELSE concat('conv ', CAST(conv_id AS STRING)) END AS title
FROM {conversations}""",
    "v_rerank": "SELECT doc_id AS file_id, CAST(quality AS DOUBLE) - CAST(toxic AS DOUBLE) / 2 AS relevance FROM {labels}",
    "v_sensitivity": """SELECT d.doc_id AS file_id, CASE WHEN l.toxic = 1 THEN 4 WHEN l.quality = 0 THEN 2 WHEN l.doc_id IS NULL THEN 1 ELSE 0 END AS sensitivity
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "v_line": """SELECT doc_id AS file_id, CAST(pos AS BIGINT) AS chunk_order, line AS content
FROM {documents} LATERAL VIEW posexplode(split(text, '\n')) x AS pos, line WHERE length(trim(line)) > 0""",
    "v_chunk_v1": "SELECT file_id, 1 AS version, chunk_order, content, concat(CAST(file_id AS STRING), ':1:', CAST(chunk_order AS STRING)) AS chunk_key FROM {v_line}",
    "v_chunk_v2": """SELECT file_id, 2 AS version, chunk_order,
  CASE WHEN file_id % 3 = 0 OR (file_id + chunk_order) % 5 = 0 THEN concat(content, ' edited') ELSE content END AS content,
  concat(CAST(file_id AS STRING), ':2:', CAST(chunk_order AS STRING)) AS chunk_key FROM {v_line} WHERE chunk_order % 17 <> 16""",
    "v_active": """SELECT file_id, CASE WHEN file_id % 4 = 3 THEN 1 ELSE 2 END AS active_version, file_id % 4 AS tenant_id,
  CASE WHEN file_id % 29 = 0 THEN 1 ELSE CASE WHEN file_id % 4 = 3 THEN 1 ELSE 2 END END AS active_summary_version FROM {v_file}""",
    "v_size": "SELECT count(*) AS n_vectors FROM {embeddings}",
    "v_query": """SELECT b.item_id AS query_id, b.text AS query_text, u.user_id, u.tenant_id, e.embedding AS q_vec
FROM {benchmark} b JOIN {embeddings} e ON e.vec_id = b.item_id CROSS JOIN (SELECT count(*) AS n_users FROM {v_user}) n JOIN {v_user} u ON u.user_id = (b.item_id * 37) % n_users""",
    "v_member": """SELECT user_id, tenant_id, role FROM {v_user} WHERE user_id % 17 <> 5
UNION ALL SELECT user_id, (tenant_id + 1) % 4, CASE WHEN user_id % 2 = 0 THEN 'editor' ELSE 'viewer' END FROM {v_user} WHERE user_id % 13 = 0""",
    "v_actor": """SELECT user_id, tenant_id FROM {v_user}
UNION ALL SELECT user_id, (tenant_id + 1) % 4 FROM {v_user} WHERE user_id % 13 = 0 OR user_id % 19 = 4""",
    "v_summary": """SELECT c.file_id, 1 AS summary_version, concat('s', CAST(c.file_id AS STRING)) AS summary_key,
  min(CASE WHEN c.rn = 1 THEN c.content END) AS summary_text, CAST(3 AS DOUBLE) / max(c.n) AS coverage_ratio
FROM (SELECT file_id, content, row_number() OVER (PARTITION BY file_id ORDER BY chunk_order) AS rn, count(*) OVER (PARTITION BY file_id) AS n FROM {v_line}) c
WHERE c.rn <= 3 AND c.n >= 5 GROUP BY c.file_id""",
    "v_source": """SELECT c.file_id, concat('s', CAST(c.file_id AS STRING)) AS summary_key, CAST(c.rn - 1 AS INT) AS pos,
  concat(CAST(c.file_id AS STRING), ':1:', CAST(c.chunk_order AS STRING)) AS chunk_key
FROM (SELECT file_id, chunk_order, row_number() OVER (PARTITION BY file_id ORDER BY chunk_order) AS rn, count(*) OVER (PARTITION BY file_id) AS n FROM {v_line}) c
WHERE c.rn <= 3 AND c.n >= 5""",
    "v_shown": """SELECT file_id, chunk_order, version, CASE WHEN (file_id * 5 + chunk_order) % 23 = 0 THEN 0 ELSE 1 END AS available
FROM (SELECT file_id, chunk_order, version FROM {v_chunk_v1} UNION ALL SELECT file_id, chunk_order, version FROM {v_chunk_v2}) x""",
    "v_index": """SELECT c.chunk_key AS doc_key, c.file_id, CASE WHEN (c.file_id * 7 + c.chunk_order) % 89 = 0 THEN 0 ELSE c.version END AS chunk_version,
  CASE WHEN (c.file_id * 7 + c.chunk_order) % 83 = 0 THEN 0 ELSE 1 END AS available
FROM {v_chunk_v2} c WHERE (c.file_id * 7 + c.chunk_order) % 97 <> 0
UNION ALL SELECT chunk_key, file_id, 1, CASE WHEN chunk_order % 41 = 0 THEN 1 ELSE 0 END FROM {v_chunk_v1}
UNION ALL SELECT concat('orphan:', CAST(file_id AS STRING)), file_id, 2, 1 FROM {v_file} WHERE file_id % 37 = 0""",
    "v_markdown": """SELECT file_id, chunk_order AS line_no, CASE WHEN chunk_order % 6 = 0
  THEN concat(CASE WHEN chunk_order % 12 = 0 THEN '# ' ELSE '## ' END, substr(content, 1, 20)) ELSE content END AS line FROM {v_line}""",
    "v_quota": """SELECT CAST(t AS BIGINT) AS tenant_id, CASE t WHEN 0 THEN 40 WHEN 1 THEN 0 ELSE 100000 END AS max_docs,
  CASE t WHEN 2 THEN 20000 ELSE 0 END AS max_bytes FROM (VALUES (0), (1), (2)) q(t)""",
}
DUCKDB = {
    "v_line": """SELECT doc_id AS file_id, CAST(pos - 1 AS BIGINT) AS chunk_order, line AS content
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {documents}) t
WHERE length(trim(line)) > 0""",
}
_NAME = re.compile(r"\{(\w+)\}")


def view(spark: SparkSession, sf_dir: str, name: str, ready: dict[str, DataFrame] | None = None) -> DataFrame:
    """The view or given table ``name`` over the tables in ``sf_dir``, those in ``ready`` taken from there."""
    if ready and name in ready:
        return ready[name]
    if name not in VIEWS:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return spread(table) if name == "documents" else table  # its texts are what most of the work hangs on
    sql = VIEWS[name]
    return spark.sql(sql, **{n: view(spark, sf_dir, n, ready) for n in dict.fromkeys(_NAME.findall(sql))})


def with_views(sql: str) -> str:
    """A DuckDB query with the views it names, and theirs, as common table expressions."""
    ready: dict[str, str] = {}

    def need(text: str) -> str:
        for name in dict.fromkeys(_NAME.findall(text)):
            if name in VIEWS and name not in ready:
                ready[name] = need(DUCKDB.get(name, VIEWS[name]))
        return _NAME.sub(r"\1", text)

    body = need(sql.strip())
    own = body.startswith("WITH ")
    head = ", ".join(f"{n} AS ({t})" for n, t in ready.items())
    if not head:
        return body
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if own else f"WITH {head} {body}"
