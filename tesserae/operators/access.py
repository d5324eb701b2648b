"""Who may do what: roles and tools, grants on rows and on requested scopes, idempotent administration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.schema import ROLES

#: Each tool's least role and whether it reads or writes.
TOOL_POLICY = {
    "recall": ("reader", "read"),
    "get_profile": ("reader", "read"),
    "get_context": ("reader", "read"),
    "memory_stats": ("reader", "read"),
    "search_history": ("reader", "read"),
    "get_recent_interactions": ("reader", "read"),
    "remember": ("writer", "write"),
    "save_lesson": ("writer", "write"),
    "update_memory": ("writer", "write"),
    "link_memory": ("writer", "write"),
    "forget": ("owner", "write"),
    "merge_memory": ("owner", "write"),
    "consolidate": ("owner", "write"),
    "export_memory": ("owner", "write"),
    "import_memory": ("owner", "write"),
    "extract_memories": ("owner", "write"),
}
#: Tools that take a session as a filter only, and those that write to GLOBAL unless told otherwise.
FILTER_ONLY = ("search_history", "get_recent_interactions")
GLOBAL_WRITES = ("consolidate", "extract_memories", "import_memory")


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def rank(role: Column) -> Column:
    """Null for an unknown role."""
    return _lookup(ROLES, role)


def permission(tool: Column) -> Column:
    """Unknown tools count as reading; `may_call` refuses them."""
    return F.coalesce(_lookup({t: k for t, (_, k) in TOOL_POLICY.items()}, tool), F.lit("read"))


def may_call(role: Column, tool: Column) -> Column:
    least = rank(_lookup({t: r for t, (r, _) in TOOL_POLICY.items()}, tool))
    return F.coalesce(rank(role) >= least, F.lit(False))


def _granting(grants: DataFrame, write: bool) -> DataFrame:
    """Distinct (grantee, kind, ref) that give the permission; writing is also reading."""
    return grants.where(F.col("permission").isin(["write"] if write else ["read", "write"])).select("grantee_user_id", "scope_kind", "scope_ref").distinct()


def can_access(rows: DataFrame, grants: DataFrame, users: DataFrame, uid: int, write: bool = False) -> DataFrame:
    """The rows and `allowed`: GLOBAL always, USER for the owner or by a grant on the owner, SESSION and PROJECT by grants."""
    own = _granting(grants.where(F.col("grantee_user_id") == uid), write)
    refs = lambda kind, column: own.where(F.col("scope_kind") == kind).select(F.col("scope_ref").alias(column), F.lit(True).alias(f"by_{column}"))
    owners = users.join(refs("USER", "external_id"), "external_id").select(F.col("id").alias("user_id"), F.lit(True).alias("by_owner"))
    known = users.select(F.col("id").alias("user_id"), F.lit(True).alias("known"))
    out = rows.join(owners, "user_id", "left").join(known, "user_id", "left").join(refs("SESSION", "session_id"), "session_id", "left").join(refs("PROJECT", "project_id"), "project_id", "left")
    mine = (F.col("user_id") == uid) | (F.col("known") & F.col("by_owner"))
    allowed = F.when(F.col("scope") == "GLOBAL", True).when(F.col("scope") == "USER", mine).when(F.col("scope") == "SESSION", F.col("by_session_id")).when(F.col("scope") == "PROJECT", F.col("by_project_id"))
    return out.withColumn("allowed", F.coalesce(allowed, F.lit(False))).select(*rows.columns, "allowed")


def bind_scope(requests: DataFrame, grants: DataFrame, users: DataFrame) -> DataFrame:
    """Requests (id, uid, external_id, role, tool, user_ref, session_ref, project_ref) with `reason`, null where the scope is granted.

    A request for another user, a session or a project needs a grant for the tool's permission; tools
    that would write to GLOBAL need an owner or a grant on GLOBAL, unless a scope is named.
    """
    write = permission(F.col("tool")) == "write"
    out = requests.withColumn("write", write)
    every = _granting(grants, False).withColumn("read_ok", F.lit(True)).join(_granting(grants, True).withColumn("write_ok", F.lit(True)), ["grantee_user_id", "scope_kind", "scope_ref"], "left")
    for kind, ref in (("USER", "user_ref"), ("SESSION", "session_ref"), ("PROJECT", "project_ref"), ("GLOBAL", "global_ref")):
        of = every.where(F.col("scope_kind") == kind).select(F.col("grantee_user_id").alias("uid"), F.col("scope_ref").alias(ref), "read_ok", "write_ok")
        out = (out.withColumn(ref, F.lit("*")) if ref == "global_ref" else out).join(of, ["uid", ref], "left")
        out = out.withColumn(f"ok_{kind}", F.coalesce(F.when(F.col("write"), F.col("write_ok")).otherwise(F.col("read_ok")), F.lit(False))).drop("read_ok", "write_ok")
    out = out.join(users.select(F.col("external_id").alias("user_ref"), F.lit(True).alias("known")), "user_ref", "left")
    foreign = F.col("user_ref").isNotNull() & (F.col("user_ref") != F.col("external_id")) & ~(F.col("ok_USER") & F.coalesce("known", F.lit(False)))
    session = F.col("session_ref").isNotNull() & ~F.col("tool").isin(*FILTER_ONLY) & ~F.col("ok_SESSION")
    project = F.col("project_ref").isNotNull() & ~F.col("ok_PROJECT")
    unnamed = F.col("user_ref").isNull() & F.col("session_ref").isNull() & F.col("project_ref").isNull()
    owner = F.coalesce(rank(F.col("role")) >= ROLES["owner"], F.lit(False))
    wide = F.col("write") & unnamed & F.col("tool").isin(*GLOBAL_WRITES) & ~(owner | F.col("ok_GLOBAL"))
    return out.withColumn("reason", F.when(foreign | session | project, "scope").when(wide, "global-write")).select(*requests.columns, "reason")


def upsert(current: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `changes` replace those of `current` with the same key or are added; of repeated changes the last by `seq` counts."""
    columns = current.columns
    last = changes.groupBy(*key).agg(F.max_by(F.struct(*[c for c in columns if c not in key]), "seq").alias("new"))
    rest = [c for c in columns if c not in key]
    return current.join(last, key, "left_anti").unionByName(last.select(*key, *[F.col(f"new.{c}").alias(c) for c in rest]).select(*columns))


def remove(current: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """Removing what isn't there changes nothing."""
    return current.join(keys.select(*key).distinct(), key, "left_anti")


def listing(rows: DataFrame, order: list, limit: int, most: int) -> DataFrame:
    """The first rows in an order, between 1 and `most` of them."""
    return rows.orderBy(*order).limit(max(1, min(limit, most)))
