"""Queries of access, administration and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import scope
from tesserae.operators import access
from tesserae.plans import views
from tesserae.plans.registry import query

MAY = lambda kind, ref, write: f"EXISTS (SELECT 1 FROM grants g WHERE g.grantee_user_id = 1 AND g.scope_kind = '{kind}' AND g.scope_ref = {ref} AND g.permission IN ({chr(39)}write{chr(39)}{'' if write else ', ' + chr(39) + 'read' + chr(39)}))"


def _rows_sql(write: bool) -> str:
    return (
        views.more_sql("users", "grants")
        + f" SELECT m.id, CASE m.scope WHEN 'GLOBAL' THEN true WHEN 'USER' THEN coalesce(m.user_id = 1 OR EXISTS (SELECT 1 FROM users u WHERE u.id = m.user_id AND {MAY('USER', 'u.external_id', write)}), false)"
        f" WHEN 'SESSION' THEN {MAY('SESSION', 'm.session_id', write)} WHEN 'PROJECT' THEN {MAY('PROJECT', 'm.project_id', write)} ELSE false END AS allowed FROM memories m"
    )


def _rows(spark, d, write):
    m = views.memories(spark, d).select("id", "scope", "user_id", "session_id", "project_id")
    return access.can_access(m, views.more(spark, d, "grants"), views.more(spark, d, "users"), 1, write).select("id", "allowed")


@query("f10_row_read", _rows_sql(False))
def _(spark, d):
    return _rows(spark, d, False)


@query("f10_row_write", _rows_sql(True))
def _(spark, d):
    return _rows(spark, d, True)


@query("f12_grants_write", views.more_sql("grants") + " SELECT id, project_id FROM memories WHERE project_id IN (SELECT scope_ref FROM grants WHERE grantee_user_id = 2 AND scope_kind = 'PROJECT' AND permission = 'write')")
def _(spark, d):
    return scope.granted(views.memories(spark, d), views.more(spark, d, "grants"), 2, "PROJECT", "project_id", "write").select("id", "project_id")


@query("f06_captured_owner", views.more_sql("captured") + " SELECT id, coalesce(user_id = 7, false) AS for_user, user_id = 7 OR user_id IS NULL AS for_owner FROM captured WHERE user_id = 7 OR user_id IS NULL")
def _(spark, d):
    rows = views.more(spark, d, "captured").where(scope.interaction_owner(7, True))
    return rows.select("id", F.coalesce(scope.interaction_owner(7, False), F.lit(False)).alias("for_user"), scope.interaction_owner(7, True).alias("for_owner"))


@query("f02_user_gate", "SELECT id, CASE scope WHEN 'GLOBAL' THEN true WHEN 'USER' THEN user_id = 2 ELSE false END AS seen, false AS unnamed FROM memories WHERE scope IN ('USER', 'PROJECT', 'SESSION') OR scope = 'GLOBAL' AND id % 2 >= 0")
def _(spark, d):
    rows = views.memories(spark, d)
    return rows.select("id", scope.visible(user_id=2).alias("seen"), (scope.visible() & (F.col("scope") != "GLOBAL")).alias("unnamed"))


_TOOLS = list(access.TOOL_POLICY)
_RANKED = "(VALUES ('reader', 0), ('writer', 1), ('owner', 2), ('admin', 3))"
_POLICY = "(VALUES " + ", ".join(f"('{t}', '{r}', '{k}')" for t, (r, k) in access.TOOL_POLICY.items()) + ") p(tool, least, kind)"


@query("f13_may_call", views.more_sql("users") + f" SELECT u.id, p.tool, (SELECT n FROM {_RANKED} r(role, n) WHERE r.role = u.role) >= (SELECT n FROM {_RANKED} r(role, n) WHERE r.role = p.least) AS allowed FROM users u CROSS JOIN {_POLICY} UNION ALL SELECT id, 'unknown', false FROM users")
def _(spark, d):
    tools = F.explode(F.array(*[F.lit(t) for t in [*_TOOLS, "unknown"]])).alias("tool")
    return views.more(spark, d, "users").select("id", "role", tools).select("id", "tool", access.may_call(F.col("role"), F.col("tool")).alias("allowed"))


_REQUESTS = "event_id AS id; user_id % 50 AS uid; concat('u', user_id % 50) AS external_id; CASE user_id % 4 WHEN 0 THEN 'reader' WHEN 1 THEN 'writer' WHEN 2 THEN 'owner' ELSE 'admin' END AS role; CASE WHEN event_id % 5 = 0 THEN concat('u', event_id % 9) WHEN event_id % 83 = 1 THEN 'u-none' END AS user_ref; CASE WHEN event_id % 7 = 0 THEN concat('s', event_id % 8) END AS session_ref; CASE WHEN event_id % 3 = 0 THEN concat('p', event_id % 6) END AS project_ref; CASE event_id % 16 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TOOLS)) + " END AS tool"
_GRANT = "EXISTS (SELECT 1 FROM grants g WHERE g.grantee_user_id = r.uid AND g.scope_kind = '{}' AND g.scope_ref = {} AND (g.permission = 'write' OR p.kind = 'read'))"


@query(
    "f14_bind_scope",
    views.more_sql("users", "grants") + f", requests AS (SELECT {_REQUESTS.replace(';', ',')} FROM events) SELECT r.id, CASE"
    f" WHEN r.user_ref IS NOT NULL AND r.user_ref <> r.external_id AND NOT ({_GRANT.format('USER', 'r.user_ref')} AND EXISTS (SELECT 1 FROM users u WHERE u.external_id = r.user_ref)) THEN 'scope'"
    f" WHEN r.session_ref IS NOT NULL AND r.tool NOT IN ('search_history', 'get_recent_interactions') AND NOT {_GRANT.format('SESSION', 'r.session_ref')} THEN 'scope'"
    f" WHEN r.project_ref IS NOT NULL AND NOT {_GRANT.format('PROJECT', 'r.project_ref')} THEN 'scope'"
    " WHEN r.user_ref IS NULL AND r.session_ref IS NULL AND r.project_ref IS NULL AND r.tool IN ('consolidate', 'extract_memories', 'import_memory') AND r.role NOT IN ('owner', 'admin')"
    " AND NOT EXISTS (SELECT 1 FROM grants g WHERE g.grantee_user_id = r.uid AND g.scope_kind = 'GLOBAL' AND g.scope_ref = '*' AND g.permission = 'write') THEN 'global-write' END AS reason"
    f" FROM requests r JOIN {_POLICY} ON p.tool = r.tool",
)
def _(spark, d):
    requests = views.table(spark, d, "events").selectExpr(*_REQUESTS.split(";"))
    return access.bind_scope(requests, views.more(spark, d, "grants"), views.more(spark, d, "users")).select("id", "reason")


@query("f07_optional_filters", views.more_sql("captured") + " SELECT id, 'session' AS asked FROM captured WHERE session_id = 'c3' UNION ALL SELECT id, 'kind' FROM captured WHERE kind = 'error' UNION ALL SELECT id, 'both' FROM captured WHERE session_id = 'c3' AND kind = 'prompt' UNION ALL SELECT id, 'none' FROM captured")
def _(spark, d):
    rows = views.more(spark, d, "captured")
    parts = [rows.where(scope.asked(**a)).select("id", F.lit(n).alias("asked")) for n, a in (("session", {"session_id": "c3"}), ("kind", {"kind": "error"}), ("both", {"session_id": "c3", "kind": "prompt"}), ("none", {"kind": None}))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("j08_tokens_users", views.more_sql("users", "tokens") + " SELECT t.id, u.external_id, u.role, sha256(t.token) AS token_hash, t.revoked FROM tokens t JOIN users u ON u.id = t.user_id")
def _(spark, d):
    users = views.more(spark, d, "users").withColumnRenamed("id", "user_id")
    return views.more(spark, d, "tokens").join(users, "user_id").select("id", "external_id", "role", F.sha2("token", 256).alias("token_hash"), "revoked")


@query("x33_verify_token", views.more_sql("tokens") + " SELECT id, substr(sha256(token), 1, 8) AS hash_prefix, id % 2 = 0 AND NOT revoked AS verified FROM tokens")
def _(spark, d):
    from tesserae.functions import text

    given = F.when(F.col("id") % 2 == 0, F.col("token")).otherwise(F.lit("thm_wrong"))
    return views.more(spark, d, "tokens").select("id", text.hash_prefix(F.col("token")).alias("hash_prefix"), (text.verify_token(given, F.sha2("token", 256)) & ~F.col("revoked")).alias("verified"))


@query("t11_audit_newest", views.more_sql("audit") + " SELECT id, actor, action FROM audit ORDER BY id DESC LIMIT 500")
def _(spark, d):
    return access.listing(views.more(spark, d, "audit").select("id", "actor", "action"), [F.desc("id")], 9000, 500)


@query("t14_grant_listing", views.more_sql("grants") + " SELECT scope_kind, scope_ref, permission, row_number() OVER (ORDER BY scope_kind, scope_ref, permission) AS place FROM (SELECT DISTINCT scope_kind, scope_ref, permission FROM grants WHERE grantee_user_id = 3)")
def _(spark, d):
    from pyspark.sql.window import Window as W

    mine = views.more(spark, d, "grants").where("grantee_user_id = 3").select("scope_kind", "scope_ref", "permission").distinct()
    return mine.withColumn("place", F.row_number().over(W.orderBy("scope_kind", "scope_ref", "permission")).cast("long"))


_G = ["grantee_user_id", "scope_kind", "scope_ref"]


@query(
    "u17_grants_changed",
    views.more_sql("grants") + ", put AS (SELECT event_id AS seq, user_id % 60 AS grantee_user_id, 'PROJECT' AS scope_kind, 'p' || (event_id % 5) AS scope_ref, CASE WHEN event_id % 2 = 0 THEN 'read' ELSE 'write' END AS permission FROM events),"
    " last AS (SELECT grantee_user_id, scope_kind, scope_ref, arg_max(permission, seq) AS permission FROM put GROUP BY grantee_user_id, scope_kind, scope_ref),"
    " merged AS (SELECT o.* FROM (SELECT grantee_user_id, scope_kind, scope_ref, max(permission) AS permission FROM grants GROUP BY grantee_user_id, scope_kind, scope_ref) o WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.grantee_user_id = o.grantee_user_id AND l.scope_kind = o.scope_kind AND l.scope_ref = o.scope_ref) UNION ALL SELECT * FROM last)"
    " SELECT * FROM merged WHERE NOT (scope_kind = 'SESSION' AND scope_ref = 's1')",
)
def _(spark, d):
    old = views.more(spark, d, "grants").groupBy(*_G).agg(F.max("permission").alias("permission"))
    put = views.table(spark, d, "events").selectExpr("event_id AS seq", "user_id % 60 AS grantee_user_id", "'PROJECT' AS scope_kind", "concat('p', event_id % 5) AS scope_ref", "CASE WHEN event_id % 2 = 0 THEN 'read' ELSE 'write' END AS permission")
    gone = views.more(spark, d, "grants").where("scope_kind = 'SESSION' AND scope_ref = 's1'")
    return access.remove(access.upsert(old, put, _G), gone.select("scope_kind", "scope_ref"), ["scope_kind", "scope_ref"])


@query("u17_audit_append", views.more_sql("audit") + " SELECT id, action FROM audit UNION ALL SELECT doc_id + (SELECT max(id) + 1 FROM audit), 'import' FROM documents")
def _(spark, d):
    rows = views.more(spark, d, "audit").select("id", "action")
    start = rows.agg((F.max("id") + 1).alias("start"))  # one row
    new = views.table(spark, d, "documents").select("doc_id").join(F.broadcast(start)).select((F.col("doc_id") + F.col("start")).alias("id"), F.lit("import").alias("action"))
    return rows.unionByName(new)
