"""Queries of the usage analytics and listings."""

from pyspark.sql import functions as F

from corpuspark.operators import access, usage
from corpuspark.plans.access import ACCESS, grants_of, who_of
from corpuspark.plans.base import query
from corpuspark.sources.views import AS_OF

WINDOW = f"created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY"


@query("u1_time_window", f"SELECT id, user_id, latency_ms FROM {{v_query_log}} WHERE {WINDOW}")
def u1(v):
    return usage.time_window(v.v_query_log, AS_OF, 10).select("id", "user_id", "latency_ms")


@query(
    "u2_overview",
    """WITH q AS (SELECT tenant_id, count(*) AS queries, count(*) FILTER (rerank_used) AS reranks, count(DISTINCT user_id) AS users FROM {v_query_log} GROUP BY 1),
c AS (SELECT tenant_id, count(*) AS chats, count(*) FILTER (outcome = 'answered') AS answered, count(*) FILTER (outcome = 'no_result') AS no_result,
  count(*) FILTER (outcome = 'error') AS errors FROM {v_chat_log} GROUP BY 1),
u AS (SELECT tenant_id, count(*) AS uploads FROM {v_file} GROUP BY 1)
SELECT tenant_id, coalesce(queries, 0) AS queries, coalesce(reranks, 0) AS reranks, coalesce(users, 0) AS users, coalesce(chats, 0) AS chats,
  coalesce(answered, 0) AS answered, coalesce(no_result, 0) AS no_result, coalesce(errors, 0) AS errors, coalesce(uploads, 0) AS uploads,
  CASE WHEN chats > 0 THEN round(answered / chats, 3) ELSE 0.0 END AS success_rate
FROM q FULL JOIN c USING (tenant_id) FULL JOIN u USING (tenant_id)""",
)
def u2(v):
    return usage.overview(v.v_query_log, v.v_chat_log, v.v_file)


@query("u3_top_queries", "SELECT query_norm, count(*) AS n FROM {v_query_log} WHERE query_norm <> '' GROUP BY 1 ORDER BY n DESC, query_norm LIMIT 20")
def u3(v):
    return usage.top_queries(v.v_query_log)


@query(
    "u4_user_usage",
    """WITH t AS (SELECT user_id, 0 AS kind FROM {v_query_log} UNION ALL SELECT user_id, 1 FROM {v_chat_log} UNION ALL SELECT owner_user_id, 2 FROM {v_file}),
n AS (SELECT user_id, count(*) FILTER (kind = 0) AS queries, count(*) FILTER (kind = 1) AS chats, count(*) FILTER (kind = 2) AS uploads FROM t GROUP BY 1)
SELECT user_id, coalesce(external_id, substr(CAST(user_id AS VARCHAR), 1, 8)) AS label, queries, chats, uploads, queries + chats + uploads AS total
FROM n LEFT JOIN {v_user} USING (user_id)""",
)
def u4(v):
    return usage.user_usage(v.v_query_log, v.v_chat_log, v.v_file, v.v_user)


@query(
    "u5_model_usage",
    """SELECT 'llm' AS kind, model, count(*) AS calls FROM {v_chat_log} WHERE model IS NOT NULL GROUP BY model
UNION ALL SELECT 'embedding', model, count(*) FROM {v_cost_log} WHERE model IS NOT NULL GROUP BY model""",
)
def u5(v):
    return usage.model_usage(v.v_chat_log, v.v_cost_log)


@query(
    "u6_user_chats",
    """SELECT user_id, nth, id, outcome FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS INT) AS nth FROM {v_chat_log})
WHERE nth <= 50""",
)
def u6(v):
    return usage.user_chats(v.v_chat_log)


@query(
    "u7_user_conversations",
    """WITH c AS (SELECT user_id, conv_id, coalesce(max(title), 'untitled') AS title, max(id) AS last_id, count(*) AS n_messages,
  string_agg(role || ':' || content, '|' ORDER BY id) AS turns FROM {v_message} GROUP BY 1, 2)
SELECT user_id, conv_id, title, n_messages, sha256(turns) AS turns FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_id DESC) AS nth FROM c) WHERE nth <= 30""",
)
def u7(v):
    turns = F.array_join(F.transform("messages", lambda m: F.concat(m.role, F.lit(":"), m.content)), "|")
    return usage.conversations_of_users(v.v_message).select(
        "user_id", "conv_id", "title", F.size("messages").cast("long").alias("n_messages"), F.sha2(turns, 256).alias("turns")
    )


@query("u8_conversation_previews", "SELECT conv_id, arg_max(substr(content, 1, 60), id) AS preview, count(*) AS n_messages FROM {v_message} GROUP BY 1")
def u8(v):
    return usage.conversation_previews(v.v_message)


TURNS = "SELECT user_id AS conv_id, id, query, outcome AS answer, CASE WHEN user_id % 3 = 0 THEN 'kept' END AS title FROM {v_chat_log}"


@query(
    "u9_persist_turns",
    f"""WITH x AS ({TURNS}), t AS (SELECT conv_id, coalesce(max(title), arg_min(substr(query, 1, 30), id)) AS title FROM x GROUP BY 1)
SELECT conv_id, id * 2 AS id, 'user' AS role, query AS content, title FROM x JOIN t USING (conv_id)
UNION ALL SELECT conv_id, id * 2 + 1, 'assistant', answer, title FROM x JOIN t USING (conv_id)""".replace("title FROM x JOIN", "t.title FROM x JOIN"),
)
def u9(v):
    x = v.v_chat_log.select(
        F.col("user_id").alias("conv_id"), "id", "query", F.col("outcome").alias("answer"), F.when(F.col("user_id") % 3 == 0, "kept").alias("title")
    )
    messages, titles = usage.persist_turns(x)
    return messages.join(titles, "conv_id").select("conv_id", "id", "role", "content", "title")


@query(
    "u10_chat_outcome",
    "SELECT id, CASE WHEN outcome = 'error' THEN 'error' WHEN hits = 0 THEN 'no_result' ELSE 'answered' END AS decided FROM {v_chat_log}",
)
def u10(v):
    return v.v_chat_log.select("id", usage.chat_outcome(F.col("outcome") == "error", F.col("hits")).alias("decided"))


@query(
    "u11_kb_listing",
    f"""WITH {ACCESS}, n AS (SELECT kb_id, count(DISTINCT file_id) AS documents FROM {{v_file_kb}} GROUP BY 1)
SELECT a.user_id, a.tenant_id, a.kb_id, k.name, a.role, coalesce(documents, 0) AS documents
FROM access a JOIN {{v_kb}} k ON a.kb_id = k.kb_id AND a.tenant_id = k.tenant_id LEFT JOIN n ON n.kb_id = a.kb_id""",
)
def u11(v):
    return usage.kb_listing(v.v_kb, v.v_file_kb, access.resolve_access(who_of(v), v.v_kb, grants_of(v)))


@query(
    "u12_kb_documents",
    """SELECT kb_id, file_id, name, status, CAST(row_number() OVER (PARTITION BY kb_id ORDER BY created_date DESC, file_id) AS INT) AS nth
FROM {v_file} JOIN {v_file_kb} USING (file_id)""",
)
def u12(v):
    return usage.kb_documents(v.v_file, v.v_file_kb)


@query(
    "u13_file_listing",
    """SELECT owner_user_id, f.file_id, name, coalesce(kbs, 0) AS kbs, CAST(row_number() OVER (PARTITION BY owner_user_id ORDER BY created_date DESC, f.file_id) AS INT) AS nth
FROM {v_file} f LEFT JOIN (SELECT file_id, count(*) AS kbs FROM {v_file_kb} GROUP BY 1) n ON n.file_id = f.file_id""",
)
def u13(v):
    return usage.file_listing(v.v_file, v.v_file_kb)


@query(
    "u14_file_status",
    """SELECT file_id, status, size_bytes FROM {v_file} f
WHERE EXISTS (SELECT 1 FROM {v_file_kb} l JOIN {v_kb} k ON k.kb_id = l.kb_id WHERE l.file_id = f.file_id AND k.tenant_id = f.tenant_id)""",
)
def u14(v):
    return usage.file_status(v.v_file, v.v_file_kb, v.v_kb)


@query(
    "u15_link_membership",
    """WITH e AS (SELECT file_id, concat('t', CAST(file_id % 4 AS VARCHAR), '_src1') AS kb_id, CASE WHEN file_id % 3 = 0 THEN 'detach' ELSE 'attach' END AS op, file_id AS seq FROM {v_file}
  UNION ALL SELECT file_id, kb_id, 'detach', 1 FROM {v_file_kb} WHERE file_id % 13 = 0),
a AS (SELECT file_id, kb_id, 'attach' AS op, -1 AS seq FROM {v_file_kb} UNION ALL SELECT * FROM e)
SELECT file_id, kb_id FROM (SELECT file_id, kb_id, arg_max(op, seq) AS op FROM a GROUP BY 1, 2)
WHERE op = 'attach' AND kb_id NOT IN (SELECT kb_id FROM {v_kb} WHERE visibility = 'me')""",
)
def u15(v):
    kb, op = F.concat(F.lit("t"), (F.col("file_id") % 4).cast("string"), F.lit("_src1")), F.when(F.col("file_id") % 3 == 0, "detach").otherwise("attach")
    events = v.v_file.select("file_id", kb.alias("kb_id"), op.alias("op"), F.col("file_id").alias("seq"))
    detached = v.v_file_kb.where("file_id % 13 = 0").select("file_id", "kb_id", F.lit("detach").alias("op"), F.lit(1).cast("long").alias("seq"))
    return usage.link_membership(v.v_file_kb, events.unionByName(detached), v.v_kb.where("visibility = 'me'"))


@query(
    "u16_member_listing",
    f"""WITH {ACCESS}, n AS (SELECT user_id, tenant_id, count(*) AS kbs FROM access GROUP BY 1, 2)
SELECT u.tenant_id, u.user_id, u.role, department, group_name, coalesce(kbs, 0) AS kbs,
  CAST(row_number() OVER (PARTITION BY u.tenant_id ORDER BY department ASC NULLS LAST, group_name ASC NULLS LAST, u.user_id) AS INT) AS nth
FROM {{v_user}} u LEFT JOIN n ON n.user_id = u.user_id AND n.tenant_id = u.tenant_id""",
)
def u16(v):
    return usage.member_listing(v.v_user, access.resolve_access(who_of(v), v.v_kb, grants_of(v)))


@query("u17_departments", "SELECT DISTINCT tenant_id, department FROM {v_user} WHERE department IS NOT NULL")
def u17(v):
    return usage.distinct_values(v.v_user, "department")


@query("u17_groups", "SELECT DISTINCT tenant_id, group_name FROM {v_user} WHERE group_name IS NOT NULL")
def u17_groups(v):
    return usage.distinct_values(v.v_user, "group_name")
