"""Access control, for all users and bases at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuspark.functions.expr import rank_role, role_rank


def active_grants(grants: DataFrame, as_of: str) -> DataFrame:
    """Grants that are neither revoked nor expired at ``as_of``."""
    now = F.to_date(F.lit(as_of))
    return grants.where(F.col("revoked_date").isNull() & (F.col("expires_date").isNull() | (F.col("expires_date") > now)))


def apply_grants(events: DataFrame) -> DataFrame:
    """Fold grant, bulk and revoke events (seq, user_id, kb_id, role, op, expires_date, event_date) to the current grants.

    The last event decides; a grant clears a revocation, sets the role and, unless it is a bulk one, the expiry; a bulk grant keeps the
    expiry that the grants before it left (none if it is the first); a revocation keeps role and expiry.
    """
    given, direct = F.col("op").isin("grant", "bulk"), F.col("op") == "grant"
    at = lambda c: F.when(c, F.col("seq"))
    folded = events.groupBy("user_id", "kb_id").agg(
        F.max_by("role", at(given)).alias("role"),
        F.max_by(F.struct("expires_date"), at(direct)).alias("direct"),
        F.max(at(given)).alias("granted"),
        F.max_by(F.struct("op", "event_date"), "seq").alias("last"),
    )
    return folded.where("granted IS NOT NULL").select(
        "user_id", "kb_id", "role", F.col("direct.expires_date").alias("expires_date"), F.when(F.col("last.op") == "revoke", F.col("last.event_date")).alias("revoked_date")
    )


def grant_targets(users: DataFrame, department: str | None, group: str | None, user_ids: DataFrame | None) -> DataFrame:
    """(department and group) or explicitly named members, each once, with their tenant."""
    picked = users.where("false")
    if department is not None or group is not None:
        picked = users
        if department is not None:
            picked = picked.where(F.col("department") == department)
        if group is not None:
            picked = picked.where(F.col("group_name") == group)
    if user_ids is not None:
        picked = picked.unionByName(users.join(user_ids, "user_id", "left_semi"))
    return picked.select("tenant_id", "user_id").dropDuplicates()


def bulk_grants(targets: DataFrame, kbs: DataFrame, role: str) -> DataFrame:
    """One grant for each target and base of the target's tenant."""
    return targets.join(kbs.select("kb_id", "tenant_id"), "tenant_id").select("user_id", "kb_id", F.lit(role).alias("role"))


def principals(asked: DataFrame, members: DataFrame) -> DataFrame:
    """(user_id, tenant_id, role) of whoever acts in a tenant; who isn't a member of it is a viewer there."""
    role = members.select("user_id", "tenant_id", F.col("role").alias("held"))
    who = asked.select("user_id", "tenant_id").distinct().join(role, ["user_id", "tenant_id"], "left")
    return who.select("user_id", "tenant_id", F.coalesce("held", F.lit("viewer")).alias("role"))


def resolve_access(who: DataFrame, kbs: DataFrame, grants: DataFrame) -> DataFrame:
    """(user_id, tenant_id, kb_id, role) for each principal (user_id, tenant_id, role): owners and admins reach all bases of that tenant,
    editors the shared ones as viewers, and the user's grants add to both; the higher role counts. A role in one tenant says nothing of
    another."""
    bases = kbs.select("kb_id", "tenant_id", "visibility")
    by_role = who.where(F.col("role").isin("owner", "admin")).join(bases, "tenant_id").select("user_id", "tenant_id", "kb_id", role_rank(F.col("role")).alias("rank"))
    shared = who.where("role = 'editor'").join(bases.where(F.col("visibility").isin("team", "tenant")), "tenant_id")
    shared = shared.select("user_id", "tenant_id", "kb_id", F.lit(1).alias("rank"))
    granted = who.select("user_id", "tenant_id").join(grants.select("user_id", "kb_id", role_rank(F.col("role")).alias("rank")), "user_id")
    granted = granted.select("user_id", "tenant_id", "kb_id", "rank")
    best = by_role.unionByName(shared).unionByName(granted).groupBy("user_id", "tenant_id", "kb_id").agg(F.max("rank").alias("rank"))
    return best.select("user_id", "tenant_id", "kb_id", rank_role(F.col("rank")).alias("role"))


def clearance(who: DataFrame, grants: DataFrame) -> DataFrame:
    """(user_id, tenant_id, clearance): the highest rank of a principal's role in the tenant (owner, admin, editor) and of the user's
    grants; 0 at least."""
    own = F.when(F.col("role").isin("owner", "admin", "editor"), role_rank(F.col("role"))).otherwise(0)
    most = grants.groupBy("user_id").agg(F.max(role_rank(F.col("role"))).alias("granted"))
    return who.join(most, "user_id", "left").select("user_id", "tenant_id", F.greatest(own, F.coalesce("granted", F.lit(0))).alias("clearance"))


def can_write(role: Column) -> Column:
    return role_rank(role) >= 2


def is_kb_admin(role: Column) -> Column:
    return role_rank(role) >= 3


def allowed_files(access: DataFrame, kbs: DataFrame, links: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """(user_id, tenant_id, file_id) reachable through accessible bases of the user's own tenant."""
    bases = access.join(kbs.select("kb_id", "tenant_id"), ["kb_id", "tenant_id"], "left_semi")
    if requested is not None:
        bases = bases.join(requested, ["user_id", "kb_id"], "left_semi")
    return bases.join(links, "kb_id").select("user_id", "tenant_id", "file_id").distinct()


def allowed_among(asked: DataFrame, access: DataFrame, kbs: DataFrame, links: DataFrame) -> DataFrame:
    """The asked (user_id, tenant_id, file_id) that ``allowed_files`` has. Each meets the bases of its file and then those that its principal
    reaches, so the work grows with what is asked, not with principals times files."""
    bases = access.join(kbs.select("kb_id", "tenant_id"), ["kb_id", "tenant_id"], "left_semi").select("user_id", "tenant_id", "kb_id")
    of_file = asked.select("user_id", "tenant_id", "file_id").distinct().join(links, "file_id")
    return of_file.join(bases, ["user_id", "tenant_id", "kb_id"], "left_semi").select("user_id", "tenant_id", "file_id").distinct()


def count_allowed(access: DataFrame, kbs: DataFrame, links: DataFrame, sensitivity: DataFrame | None = None, cleared: DataFrame | None = None) -> DataFrame:
    """(user_id, tenant_id, files, ids): the number and the sum of the files of ``allowed_files``, within the principal's clearance where
    ``sensitivity`` and ``cleared`` are given; principals without any have no row.

    Principals that reach the same bases (with the same clearance) see the same files, and files in the same bases (of the same sensitivity)
    have the same readers. So these classes meet, through each base once, and not principals and files.
    """
    bases = access.join(kbs.select("kb_id", "tenant_id"), ["kb_id", "tenant_id"], "left_semi")
    who = bases.groupBy("user_id", "tenant_id").agg(F.sort_array(F.collect_set("kb_id")).alias("held"))  # no more than a tenant's bases
    files = links.groupBy("file_id").agg(F.sort_array(F.collect_set("kb_id")).alias("linked"))
    own, of = ["held"], ["linked"]
    if sensitivity is not None:
        who = who.join(cleared.select("user_id", "tenant_id", "clearance"), ["user_id", "tenant_id"])
        files = files.join(sensitivity.select("file_id", "sensitivity"), "file_id")
        own, of = ["held", "clearance"], ["linked", "sensitivity"]
    classes = who.select(*own).distinct().withColumn("kb_id", F.explode("held"))
    groups = files.groupBy(*of).agg(F.count("*").alias("n"), F.sum("file_id").alias("total")).withColumn("kb_id", F.explode("linked"))
    met = classes.join(groups, "kb_id").where("sensitivity <= clearance" if sensitivity is not None else "true")
    met = met.drop("kb_id").distinct().groupBy(*own).agg(F.sum("n").alias("files"), F.sum("total").alias("ids"))
    return who.join(met, own).groupBy("user_id", "tenant_id").agg(F.sum("files").alias("files"), F.sum("ids").alias("ids"))


def tenant_files(kbs: DataFrame, links: DataFrame) -> DataFrame:
    """(tenant_id, file_id) of all files in bases of the tenant."""
    return links.join(kbs.select("kb_id", "tenant_id"), "kb_id").select("tenant_id", "file_id").distinct()


def sensitivity_filter(files: DataFrame, sensitivity: DataFrame, cleared: DataFrame) -> DataFrame:
    """Files (user_id, tenant_id, file_id) whose sensitivity is within the principal's clearance."""
    known = files.join(sensitivity, "file_id").join(cleared.select("user_id", "tenant_id", "clearance"), ["user_id", "tenant_id"])
    return known.where("sensitivity <= clearance").select("user_id", "tenant_id", "file_id")


def authorised_bases(queries: DataFrame, members: DataFrame, kbs: DataFrame, grants: DataFrame, links: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """(query_id, tenant_id, kb_id, clearance) that each query (query_id, user_id, tenant_id) may read: access is resolved for its
    principal, cut to the requested bases (query_id, kb_id) of queries that request any, and to bases of its tenant that have files."""
    who = principals(queries, members)
    bases = resolve_access(who, kbs, grants).join(kbs.select("kb_id", "tenant_id"), ["kb_id", "tenant_id"], "left_semi")
    of_query = queries.select("query_id", "user_id", "tenant_id").join(bases.select("user_id", "tenant_id", "kb_id"), ["user_id", "tenant_id"])
    if requested is not None:
        asking = requested.select("query_id").distinct()
        of_query = of_query.join(requested, ["query_id", "kb_id"], "left_semi").unionByName(of_query.join(asking, "query_id", "left_anti"))
    some = of_query.join(links.select("kb_id").distinct(), "kb_id", "left_semi").distinct()
    return some.join(clearance(who, grants), ["user_id", "tenant_id"]).select("query_id", "tenant_id", "kb_id", "clearance")


def authorised_files(queries: DataFrame, members: DataFrame, kbs: DataFrame, grants: DataFrame, links: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """(query_id, tenant_id, file_id, clearance) of the files in ``authorised_bases``."""
    bases = authorised_bases(queries, members, kbs, grants, links, requested)
    return bases.join(links, "kb_id").select("query_id", "tenant_id", "file_id", "clearance").distinct()


def bases_of_files(links: DataFrame) -> DataFrame:
    """(file_id, bases): the bases of each file in order."""
    return links.groupBy("file_id").agg(F.sort_array(F.collect_set("kb_id")).alias("bases"))


def effective_kbs(users: DataFrame, kbs: DataFrame, grants: DataFrame) -> DataFrame:
    """The access report: where a grant exists its role is shown, with its source and whether it can be revoked."""
    none = grants.where("false").select("user_id", "kb_id", "role")
    derived = resolve_access(users, kbs, none).select("user_id", "kb_id", F.col("role").alias("derived"))
    given = grants.join(users.select("user_id"), "user_id", "left_semi").select("user_id", "kb_id", F.col("role").alias("granted"))
    both = derived.join(given, ["user_id", "kb_id"], "full")
    source = F.when(F.col("granted").isNull(), "role").when(F.col("derived").isNull(), "grant").otherwise("raised")
    return both.select("user_id", "kb_id", F.coalesce("granted", "derived").alias("role"), source.alias("source"), F.col("granted").isNotNull().alias("can_revoke"))


def offboard(users: DataFrame, grants: DataFrame, keys: DataFrame, leaving: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memberships, grants, keys) after members (user_id, tenant_id) leave; grants and keys of all tenants are revoked, once."""
    gone = leaving.select("user_id").distinct().withColumn("leaves", F.lit(True))
    revoked = F.when(F.col("leaves"), F.coalesce("revoked_date", F.to_date(F.lit(as_of)))).otherwise(F.col("revoked_date"))
    left = users.join(leaving, ["user_id", "tenant_id"], "left_anti")
    return left, *(df.join(gone, "user_id", "left").withColumn("revoked_date", revoked).drop("leaves") for df in (grants, keys))


def authenticate(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """Requests (id, token) with the owner of the unrevoked key of the token's SHA-256, or null."""
    live = keys.where("revoked_date IS NULL").select(F.col("key_hash"), F.col("user_id").alias("key_user"))
    return requests.withColumn("key_hash", F.sha2("token", 256)).join(live, "key_hash", "left").drop("key_hash", "token")


def resolve_model(tenants: DataFrame, configs: DataFrame, fallback: str) -> DataFrame:
    """(tenant_id, kind, model): the tenant's default, else the system's (null tenant), else the fallback."""
    defaults = configs.where("is_default = 1")
    kinds = configs.select("kind").distinct()
    wanted = tenants.select("tenant_id").distinct().crossJoin(kinds)  # a handful of kinds
    own = wanted.join(defaults.select("tenant_id", "kind", "model", "seq"), ["tenant_id", "kind"]).withColumn("level", F.lit(0))
    system = wanted.join(defaults.where("tenant_id IS NULL").select("kind", "model", "seq"), "kind").withColumn("level", F.lit(1))
    w = Window.partitionBy("tenant_id", "kind").orderBy("level", "seq")
    best = own.unionByName(system).withColumn("nth", F.row_number().over(w)).where("nth = 1").select("tenant_id", "kind", "model")
    return wanted.join(best, ["tenant_id", "kind"], "left").select("tenant_id", "kind", F.coalesce("model", F.lit(fallback)).alias("model"))
