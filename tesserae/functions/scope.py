"""Row visibility, status, validity and grant predicates as Columns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.schema import HIDDEN, ROLES, TRANSITIONS


def visible(user_id: int | None = None, session_id: str | None = None, project_id: str | None = None) -> Column:
    """Rows that the caller may see; a dimension that isn't bound shows nothing of its scope."""
    out = F.col("scope") == "GLOBAL"
    for scope, column, value in (("USER", "user_id", user_id), ("SESSION", "session_id", session_id), ("PROJECT", "project_id", project_id)):
        if value is not None:
            out = out | ((F.col("scope") == scope) & (F.col(column) == F.lit(value)))
    return F.coalesce(out, F.lit(False))


def not_hidden(include_archived: bool = False) -> Column:
    return F.lit(True) if include_archived else ~F.col("status").isin(*HIDDEN)


def valid_at(at: datetime | Column) -> Column:
    at = at if isinstance(at, Column) else F.lit(at)
    return F.coalesce(F.col("valid_from") <= at, F.lit(True)) & F.coalesce(F.col("valid_until") >= at, F.lit(True))


def personal(user_id: int) -> Column:
    return F.col("user_id").isNull() | (F.col("user_id") == user_id)


def interaction_owner(user_id: int, owner: bool) -> Column:
    return (F.col("user_id") == user_id) | (F.lit(owner) & F.col("user_id").isNull())


def asked(**values: object) -> Column:
    """Filters that were asked for; a value of None asks for nothing."""
    out = F.lit(True)
    for column, value in values.items():
        if value is not None:
            out = out & (F.col(column) == F.lit(value))
    return out


def contains_text(column: str, needle: str) -> Column:
    return F.lower(F.col(column)).contains(needle.lower())


def granted(rows: DataFrame, grants: DataFrame, user_id: int, kind: str, ref: str, permission: str = "read") -> DataFrame:
    """Rows whose `ref` column is granted to the user; writing is also reading."""
    allowed = ["read", "write"] if permission == "read" else ["write"]
    ok = grants.where((F.col("grantee_user_id") == user_id) & (F.col("scope_kind") == kind) & F.col("permission").isin(allowed))
    return rows.join(ok.select(F.col("scope_ref").alias(ref)).distinct(), ref, "left_semi")


def has_role(role: str, least: str) -> bool:
    return role in ROLES and least in ROLES and ROLES[role] >= ROLES[least]


def may_move(a: Column, b: Column) -> Column:
    """Whether a status may follow another."""
    table = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    return F.coalesce(F.array_contains(F.try_element_at(table, a), b), F.lit(False))


def may_link(a: str, b: str) -> Column:
    """Whether rows aliased `a` and `b` may be linked: personal and session rows only within their owner."""
    def same(scope: str, column: str, both: bool) -> Column:
        x, y = F.col(f"{a}.scope") == scope, F.col(f"{b}.scope") == scope
        return ~((x & y) if both else (x | y)) | F.col(f"{a}.{column}").eqNullSafe(F.col(f"{b}.{column}"))

    return same("USER", "user_id", False) & same("SESSION", "session_id", False) & same("PROJECT", "project_id", True)


def untrusted(metadata: str) -> Column:
    """Null is trusted; what isn't a JSON object is not; an object only unless `trusted` is there and isn't true."""
    parsed = F.try_parse_json(F.col(metadata))
    kind = F.schema_of_variant(parsed)
    flag = F.get_json_object(metadata, "$.trusted")
    quoted = F.col(metadata).rlike(r'"trusted"\s*:\s*"')
    return F.when(F.col(metadata).isNull(), False).when(parsed.isNull() | ~F.coalesce(kind.startswith("OBJECT"), F.lit(False)), True).otherwise(F.coalesce((flag != "true") | quoted, F.lit(False)))
