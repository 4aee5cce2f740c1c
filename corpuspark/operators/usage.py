"""Usage analytics and corpus listings over log tables; every operator computes all tenants or users at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_window(logs: DataFrame, as_of: str, days: int, column: str = "created_at") -> DataFrame:
    """Rows of the last ``days`` days before ``as_of``; 0 keeps all."""
    if not days:
        return logs
    return logs.where(F.col(column) >= F.to_timestamp_ntz(F.lit(as_of)) - F.expr(f"INTERVAL {int(days)} DAYS"))


def overview(queries: DataFrame, chats: DataFrame, uploads: DataFrame) -> DataFrame:
    """By tenant: queries, rerank uses, users, chats by outcome, success rate and uploads. Three aggregates meet on the tenant."""
    outcome = lambda o: F.count(F.when(F.col("outcome") == o, 1))
    q = queries.groupBy("tenant_id").agg(
        F.count("*").alias("queries"), F.count(F.when(F.col("rerank_used"), 1)).alias("reranks"), F.countDistinct("user_id").alias("users")
    )
    c = chats.groupBy("tenant_id").agg(
        F.count("*").alias("chats"), outcome("answered").alias("answered"), outcome("no_result").alias("no_result"), outcome("error").alias("errors")
    )
    u = uploads.groupBy("tenant_id").agg(F.count("*").alias("uploads"))
    counts = ["queries", "reranks", "users", "chats", "answered", "no_result", "errors", "uploads"]
    joined = q.join(c, "tenant_id", "full").join(u, "tenant_id", "full").na.fill(0, counts)
    rate = F.when(F.col("chats") > 0, F.round(F.col("answered") / F.col("chats"), 3)).otherwise(F.lit(0.0))
    return joined.select("tenant_id", *counts, rate.alias("success_rate"))


def top_queries(queries: DataFrame, limit: int = 20) -> DataFrame:
    """The most frequent non-empty queries."""
    counted = queries.where(F.col("query_norm") != "").groupBy("query_norm").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "query_norm").limit(limit)


def user_usage(queries: DataFrame, chats: DataFrame, uploads: DataFrame, users: DataFrame) -> DataFrame:
    """Queries, chats and uploads of every user seen in any log; the label is the external id or the start of the id."""
    tagged = [df.select(F.col(key).alias("user_id"), F.lit(k).alias("kind")) for k, (df, key) in enumerate(((queries, "user_id"), (chats, "user_id"), (uploads, "owner_user_id")))]
    counts = tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).groupBy("user_id").agg(
        *(F.count(F.when(F.col("kind") == k, 1)).alias(n) for k, n in enumerate(("queries", "chats", "uploads")))
    )
    label = F.coalesce("external_id", F.substring(F.col("user_id").cast("string"), 1, 8))
    total = F.col("queries") + F.col("chats") + F.col("uploads")
    return counts.join(users.select("user_id", "external_id"), "user_id", "left").select("user_id", label.alias("label"), "queries", "chats", "uploads", total.alias("total"))


def model_usage(chats: DataFrame, costs: DataFrame) -> DataFrame:
    """Calls by model: language models from the chats, embedding models from the ingest costs."""
    llm = chats.where("model IS NOT NULL").groupBy("model").agg(F.count("*").alias("calls")).withColumn("kind", F.lit("llm"))
    embedding = costs.where("model IS NOT NULL").groupBy("model").agg(F.count("*").alias("calls")).withColumn("kind", F.lit("embedding"))
    return llm.unionByName(embedding).select("kind", "model", "calls")


def newest_per(rows: DataFrame, key: str, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each key in the order given."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= limit)


def user_chats(chats: DataFrame, limit: int = 50) -> DataFrame:
    return newest_per(chats, "user_id", [F.desc("created_at"), F.desc("id")], limit).select("user_id", "nth", "id", "outcome")


def conversations_of_users(messages: DataFrame, limit: int = 30, title: str = "untitled") -> DataFrame:
    """The newest conversations of each user with their messages nested in order."""
    nested = messages.groupBy("user_id", "conv_id").agg(
        F.coalesce(F.max("title"), F.lit(title)).alias("title"),
        F.max("id").alias("last_id"),
        F.sort_array(F.collect_list(F.struct("id", "role", "content"))).alias("messages"),
    )
    return newest_per(nested, "user_id", [F.desc("last_id")], limit)


def conversation_previews(messages: DataFrame, chars: int = 60) -> DataFrame:
    """The start of each conversation's last message."""
    return messages.groupBy("conv_id").agg(F.max_by(F.substring("content", 1, chars), "id").alias("preview"), F.count("*").alias("n_messages"))


def persist_turns(chats: DataFrame, title_chars: int = 30) -> tuple[DataFrame, DataFrame]:
    """(messages, titles): a user and an assistant row for each exchange (conv_id, id, query, answer, title), and each conversation's title."""
    user = chats.select("conv_id", (F.col("id") * 2).alias("id"), F.lit("user").alias("role"), F.col("query").alias("content"))
    assistant = chats.select("conv_id", (F.col("id") * 2 + 1).alias("id"), F.lit("assistant").alias("role"), F.col("answer").alias("content"))
    first = F.min_by(F.substring("query", 1, title_chars), "id")
    return user.unionByName(assistant), chats.groupBy("conv_id").agg(F.coalesce(F.max("title"), first).alias("title"))


def chat_outcome(error: Column, hits: Column) -> Column:
    return F.when(error, "error").when(F.coalesce(hits, F.lit(0)) == 0, "no_result").otherwise("answered")


def kb_listing(kbs: DataFrame, links: DataFrame, access: DataFrame) -> DataFrame:
    """For each principal and accessible base of the tenant: its number of documents and the role there."""
    n = links.groupBy("kb_id").agg(F.countDistinct("file_id").alias("documents"))
    listed = access.join(kbs.select("kb_id", "name", F.col("tenant_id").alias("kb_tenant")), "kb_id").where("kb_tenant = tenant_id")
    return listed.join(n, "kb_id", "left").select("user_id", "tenant_id", "kb_id", "name", "role", F.coalesce("documents", F.lit(0)).alias("documents"))


def kb_documents(files: DataFrame, links: DataFrame) -> DataFrame:
    """Documents of each base, numbered newest first."""
    w = Window.partitionBy("kb_id").orderBy(F.desc("created_date"), "file_id")
    return files.join(links, "file_id").select("kb_id", "file_id", "name", "status", F.row_number().over(w).alias("nth"))


def file_listing(files: DataFrame, links: DataFrame) -> DataFrame:
    """Files of each owner, newest first, with the number of bases they are in."""
    n = links.groupBy("file_id").agg(F.count("*").alias("kbs"))
    w = Window.partitionBy("owner_user_id").orderBy(F.desc("created_date"), "file_id")
    return files.join(n, "file_id", "left").select("owner_user_id", "file_id", "name", F.coalesce("kbs", F.lit(0)).alias("kbs"), F.row_number().over(w).alias("nth"))


def file_status(files: DataFrame, links: DataFrame, kbs: DataFrame) -> DataFrame:
    """Status of the files that are in some base of their own tenant."""
    member = links.join(kbs.select("kb_id", F.col("tenant_id").alias("kb_tenant")), "kb_id").select("file_id", F.col("kb_tenant").alias("tenant_id"))
    return files.join(member, ["file_id", "tenant_id"], "left_semi").select("file_id", "status", "size_bytes")


def link_membership(links: DataFrame, events: DataFrame, deleted_kbs: DataFrame) -> DataFrame:
    """Links after attach and detach events (file_id, kb_id, op, seq); links of deleted bases go."""
    seen = links.select("file_id", "kb_id", F.lit("attach").alias("op"), F.lit(-1).cast("long").alias("seq"))
    last = seen.unionByName(events.select("file_id", "kb_id", "op", F.col("seq").cast("long").alias("seq"))).groupBy("file_id", "kb_id").agg(F.max_by("op", "seq").alias("op"))
    return last.where("op = 'attach'").join(deleted_kbs.select("kb_id"), "kb_id", "left_anti").select("file_id", "kb_id")


def member_listing(users: DataFrame, access: DataFrame, department: str | None = None, group: str | None = None) -> DataFrame:
    """Members with the number of bases they can see, ordered by department and group, nulls last."""
    rows = users
    if department is not None:
        rows = rows.where(F.col("department") == department)
    if group is not None:
        rows = rows.where(F.col("group_name") == group)
    n = access.groupBy("user_id", "tenant_id").agg(F.count("*").alias("kbs"))
    w = Window.partitionBy("tenant_id").orderBy(F.asc_nulls_last("department"), F.asc_nulls_last("group_name"), "user_id")
    return rows.join(n, ["user_id", "tenant_id"], "left").select(
        "tenant_id", "user_id", "role", "department", "group_name", F.coalesce("kbs", F.lit(0)).alias("kbs"), F.row_number().over(w).alias("nth")
    )


def distinct_values(users: DataFrame, column: str) -> DataFrame:
    """Non-null values of a member column by tenant, sorted."""
    return users.where(F.col(column).isNotNull()).select("tenant_id", column).distinct().orderBy("tenant_id", column)
