"""Queries of the write path: creating, updating, resolving, importing, and the functions they use."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import documents, text
from tesserae.operators import mutate, writes
from tesserae.plans import views
from tesserae.plans.registry import query
from tesserae.schema import LINKS, MEMORY_TYPES, SOURCE_TYPES

_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"


def at(day: str):
    return F.lit(day).cast("timestamp")


@query("u02_save_lesson", views.more_sql("lessons") + " SELECT id, situation, mistake, correction FROM lessons UNION ALL SELECT row_number() OVER (ORDER BY p_partkey) + (SELECT max(id) FROM lessons), p_name, 'size ' || p_size, p_type FROM part")
def _(spark, d):
    old = views.more(spark, d, "lessons").select("id", "situation", "mistake", "correction")
    new = views.table(spark, d, "part").selectExpr("p_partkey AS seq", "p_name AS situation", "concat('size ', p_size) AS mistake", "p_type AS correction")
    new = writes.numbered(new, ["seq"], "id", old.agg(F.max("id")))
    return old.unionByName(new.select("id", *[text.redact(F.col(c)).alias(c) for c in ("situation", "mistake", "correction")]))


@query("u03_create_memory", "SELECT id, type, status, scope, confidence, updated_at FROM memories UNION ALL SELECT row_number() OVER (ORDER BY doc_id) + (SELECT max(id) FROM memories), 'FACT', 'active', CASE WHEN doc_id % 2 = 0 THEN 'SESSION' WHEN doc_id % 3 = 0 THEN 'PROJECT' WHEN doc_id % 5 = 0 THEN 'USER' ELSE 'GLOBAL' END, CASE WHEN doc_id % 4 = 0 THEN 0.9 ELSE 0.5 END, TIMESTAMP '2025-01-01' FROM documents")
def _(spark, d):
    new = views.table(spark, d, "documents").selectExpr("doc_id AS seq", "'FACT' AS type", "text AS content", "CASE WHEN doc_id % 2 = 0 THEN 's1' END AS session_id", "CASE WHEN doc_id % 3 = 0 THEN 'p1' END AS project_id", "CASE WHEN doc_id % 5 = 0 THEN 4L END AS user_id", "CASE WHEN doc_id % 4 = 0 THEN 0.9D END AS confidence")
    return writes.create(views.memories(spark, d), new, at(views.NOW)).select("id", "type", "status", "scope", "confidence", "updated_at")


@query(
    "u04_update_memory",
    ", c AS (SELECT *, id % 6 = 0 AND id % 12 <> 0 AS apart, id % 12 = 0 AS edit, id % 6 = 1 AS weigh, id % 6 = 2 AND NOT coalesce(valid_from > TIMESTAMP '2024-04-01', false) AS bound FROM memories)"
    " SELECT id, CASE WHEN apart THEN 'superseded' ELSE status END AS status, CASE WHEN edit THEN 'new ' || id ELSE md5(content) END AS body, CASE WHEN weigh THEN 0.9 ELSE importance END AS importance, CASE WHEN bound THEN TIMESTAMP '2024-04-01' ELSE valid_until END AS valid_until, CASE WHEN apart OR edit OR weigh OR bound THEN TIMESTAMP '2025-01-01' ELSE updated_at END AS updated_at, supersedes_id FROM c"
    " UNION ALL SELECT row_number() OVER (ORDER BY id) + (SELECT max(id) FROM memories), 'active', 'new ' || id, importance, valid_until, TIMESTAMP '2025-01-01', id FROM c WHERE apart",
)
def _(spark, d):
    m = views.memories(spark, d)
    changes = m.where("id % 6 < 3").selectExpr("id", "CASE WHEN id % 6 = 0 THEN concat('new ', id) END AS content", "id % 12 = 0 AS replace", "CASE WHEN id % 6 = 1 THEN 0.9D END AS importance", "CASE WHEN id % 6 = 2 THEN TIMESTAMP '2024-04-01' END AS valid_until")
    out = writes.update(m, changes, at(views.NOW))
    return out.select("id", "status", F.when(F.col("content").rlike(r"^new \d+$"), F.col("content")).otherwise(F.md5("content")).alias("body"), "importance", "valid_until", "updated_at", "supersedes_id")


@query(
    "u09_entities",
    views.more_sql("entities") + ", w AS (SELECT lower(trim(p_type)) AS canonical_name, min(p_partkey) AS seq FROM part GROUP BY 1 UNION ALL SELECT p_name, min(p_partkey) FROM part GROUP BY 1)"
    ", m AS (SELECT canonical_name, min(seq) AS seq FROM w WHERE canonical_name NOT IN (SELECT canonical_name FROM entities) GROUP BY 1) SELECT id, canonical_name FROM entities UNION ALL SELECT row_number() OVER (ORDER BY seq) + (SELECT max(id) FROM entities), canonical_name FROM m",
)
def _(spark, d):
    p = views.table(spark, d, "part")
    wanted = p.select(F.col("p_partkey").alias("seq"), documents.canonical(F.col("p_type")).alias("canonical_name")).union(p.select("p_partkey", documents.canonical(F.col("p_name"))))
    return writes.get_or_create(views.more(spark, d, "entities").select("id", "canonical_name"), wanted, ["canonical_name"])


_REL = "source_entity_id, relation, target_entity_id, source_memory_id"


@query(
    "u09_relations",
    views.more_sql("relations") + f", w AS (SELECT id + 1000000 AS seq, source_entity_id, relation, target_entity_id, CASE WHEN id % 8 = 0 THEN source_memory_id END AS source_memory_id FROM relations), m AS (SELECT {_REL}, min(seq) AS seq FROM w GROUP BY ALL)"
    f", n AS (SELECT m.* FROM m WHERE NOT EXISTS (SELECT 1 FROM relations r WHERE r.source_entity_id = m.source_entity_id AND r.relation = m.relation AND r.target_entity_id = m.target_entity_id AND coalesce(r.source_memory_id, -1) = coalesce(m.source_memory_id, -1)))"
    f" SELECT id, {_REL} FROM relations UNION ALL SELECT row_number() OVER (ORDER BY seq) + (SELECT max(id) FROM relations), {_REL} FROM n",
)
def _(spark, d):
    r = views.more(spark, d, "relations")
    wanted = r.selectExpr("id + 1000000 AS seq", "source_entity_id", "relation", "target_entity_id", "CASE WHEN id % 8 = 0 THEN source_memory_id END AS source_memory_id")
    return writes.get_or_create(r, wanted, _REL.split(", "))


_META = "CASE WHEN id % 17 = 0 THEN '{\"trusted\":false}' WHEN id % 19 = 0 THEN '{\"trusted\":true}' WHEN id % 23 = 0 THEN 'broken' END"


@query(
    "u10_derived",
    f", m AS (SELECT *, id // 3 AS component, {_META} AS metadata, CASE scope WHEN 'SESSION' THEN 4 WHEN 'USER' THEN 3 WHEN 'PROJECT' THEN 2 ELSE 1 END AS level, CASE scope WHEN 'SESSION' THEN session_id WHEN 'USER' THEN CAST(user_id AS VARCHAR) WHEN 'PROJECT' THEN project_id ELSE '' END AS owner FROM (SELECT * REPLACE (CASE WHEN id % 5 = 0 THEN 'GLOBAL' ELSE scope END AS scope) FROM memories))"
    ", t AS (SELECT *, max(level) OVER (PARTITION BY component) AS top FROM m)"
    " SELECT component, count(*) AS size, CASE top WHEN 4 THEN 'SESSION' WHEN 3 THEN 'USER' WHEN 2 THEN 'PROJECT' ELSE 'GLOBAL' END AS scope, CASE WHEN top > 1 THEN min(CASE WHEN level = top THEN owner END) END AS owner, md5('Consolidated: ' || string_agg(content, ' | ' ORDER BY id)) AS body,"
    " bool_or(coalesce(metadata IN ('{\"trusted\":false}', 'broken'), false)) AS untrusted FROM t GROUP BY component, top HAVING count(DISTINCT CASE WHEN level = top THEN owner END) = 1",
)
def _(spark, d):
    m = views.memories(spark, d).withColumn("scope", F.when(F.col("id") % 5 == 0, "GLOBAL").otherwise(F.col("scope"))).withColumn("metadata", F.expr(_META))
    members = m.select(F.floor(F.col("id") / 3).cast("long").alias("component"), "id")
    return writes.derive(m, members).select("component", F.col("size").cast("long").alias("size"), "scope", "owner", F.md5("content").alias("body"), "untrusted")


_FOUND = ", f AS (SELECT source_memory_id AS candidate, target_memory_id AS id, ({})[source_memory_id % 4 + 1] AS relation FROM links WHERE source_memory_id <> target_memory_id)".format("['duplicate', 'update', 'contradiction', 'unrelated']")


def _found(spark, d):
    rel = F.element_at(F.array(*map(F.lit, ("duplicate", "update", "contradiction", "unrelated"))), (F.col("source_memory_id") % 4 + 1).cast("int"))
    return views.links(spark, d).where("source_memory_id <> target_memory_id").select(F.col("source_memory_id").alias("candidate"), F.col("target_memory_id").alias("id"), rel.alias("relation"))


@query(
    "u11_resolve_statuses",
    _FOUND + ", u AS (SELECT id AS old, min(candidate) AS new FROM f WHERE relation = 'update' GROUP BY id) SELECT id, CASE WHEN id IN (SELECT old FROM u) THEN 'superseded' WHEN id IN (SELECT new FROM u) THEN 'active' WHEN id IN (SELECT candidate FROM f WHERE relation = 'duplicate') THEN 'deleted'"
    " WHEN id IN (SELECT id FROM f WHERE relation = 'duplicate') AND status IN ('active', 'stale') THEN 'active' ELSE status END AS status, round(CASE WHEN id IN (SELECT id FROM f WHERE relation = 'duplicate') AND status IN ('active', 'stale') THEN least(confidence + 0.05, 1.0) ELSE confidence END, 6) AS confidence FROM memories",
)
def _(spark, d):
    links = views.links(spark, d).withColumn("confidence", F.lit(0.5))
    return writes.resolve(views.memories(spark, d), links, _found(spark, d))[0].select("id", "status", "confidence")


@query("u11_resolve_links", _FOUND + ", n AS (SELECT DISTINCT candidate AS s, id AS t FROM f WHERE relation = 'contradiction') SELECT source_memory_id, relation, target_memory_id, CAST(0.5 AS DOUBLE) AS confidence FROM links WHERE NOT (relation = 'contradicts' AND (source_memory_id, target_memory_id) IN (SELECT (s, t) FROM n)) UNION ALL SELECT s, 'contradicts', t, CAST(0.8 AS DOUBLE) FROM n".replace("(SELECT (s, t) FROM n)", "(SELECT s, t FROM n)"))
def _(spark, d):
    links = views.links(spark, d).withColumn("confidence", F.lit(0.5))
    return writes.resolve(views.memories(spark, d), links, _found(spark, d))[1]


@query("u12_forget_links", "SELECT source_memory_id, relation, target_memory_id FROM links WHERE source_memory_id % 7 <> 3 AND target_memory_id % 7 <> 3")
def _(spark, d):
    m = views.memories(spark, d)
    return mutate.forget(m, views.links(spark, d), m.where("id % 7 = 3").select("id"))[1].select("source_memory_id", "relation", "target_memory_id")


@query(
    "u07_merged_from",
    f", p AS (SELECT s.id AS src, s.id - 2 AS tgt FROM memories s JOIN memories t ON t.id = s.id - 2 WHERE s.id % 40 = 2 AND s.status <> 'deleted' AND t.status <> 'deleted'"
    " AND NOT ((s.scope = 'USER' OR t.scope = 'USER') AND s.user_id IS DISTINCT FROM t.user_id) AND NOT ((s.scope = 'SESSION' OR t.scope = 'SESSION') AND s.session_id IS DISTINCT FROM t.session_id) AND NOT (s.scope = 'PROJECT' AND t.scope = 'PROJECT' AND s.project_id IS DISTINCT FROM t.project_id))"
    f" SELECT m.id, CASE WHEN m.id IN (SELECT src FROM p) THEN 'superseded' WHEN m.id IN (SELECT tgt FROM p) THEN 'active' ELSE status END AS status, CASE WHEN m.id IN (SELECT tgt FROM p) THEN CASE {_META} WHEN '{{\"trusted\":false}}' THEN '{{\"trusted\":false,\"merged_from\":[' || (m.id + 2) || ']}}' WHEN '{{\"trusted\":true}}' THEN '{{\"trusted\":true,\"merged_from\":[' || (m.id + 2) || ']}}' ELSE '{{\"merged_from\":[' || (m.id + 2) || ']}}' END ELSE {_META} END AS metadata FROM memories m",
)
def _(spark, d):
    m = views.memories(spark, d).withColumn("metadata", F.expr(_META))
    pairs = m.where("id % 40 = 2").selectExpr("id AS source", "id - 2 AS target")
    return mutate.merge(m, pairs).select("id", "status", "metadata")


_TYPED = "CASE WHEN length(content) BETWEEN 1 AND 2000 AND type IN {} AND confidence BETWEEN 0 AND 1 THEN true ELSE false END".format(_IN(MEMORY_TYPES))
_NORM = r"trim(regexp_replace(regexp_replace(lower(content), '\s+', ' ', 'g'), '[^\p{L}\p{N}\s]', '', 'g'), ' ')"


@query(
    "u13_import_verdicts",
    ", items AS (SELECT id AS idx, CASE WHEN id % 29 = 0 THEN 'OTHER' ELSE type END AS type, CASE WHEN id % 31 = 0 THEN 1.5 ELSE confidence END AS confidence, content, CASE WHEN id % 2 = 0 THEN 'GLOBAL' ELSE 'USER' END AS scope, CASE WHEN id % 2 = 0 THEN '' ELSE 'u' || (id % 3) END AS owner FROM memories)"
    f", i AS (SELECT *, {_TYPED} AS good, {_NORM} AS norm FROM items), k AS (SELECT DISTINCT type, {_NORM} AS norm FROM memories WHERE status <> 'deleted' AND id % 3 = 0)"
    ", v AS (SELECT i.*, k.norm IS NOT NULL AS known FROM i LEFT JOIN k ON k.type = i.type AND k.norm = i.norm), r AS (SELECT *, row_number() OVER (PARTITION BY good AND NOT known, scope, owner, type, lower(trim(content, ' ')) ORDER BY idx) AS place FROM v)"
    " SELECT idx, CASE WHEN NOT good THEN 'invalid' WHEN known THEN 'duplicate' WHEN place = 1 THEN 'import' ELSE 'repeated' END AS verdict FROM r",
)
def _(spark, d):
    return _plan(spark, d).select("idx", "verdict")


def _plan(spark, d):
    m = views.memories(spark, d)
    nothing = [F.lit(None).cast("string").alias(c) for c in ("summary", "status", "project_id", "session_id", "user_ref", "valid_from", "valid_until", "metadata")]
    numbers = [F.lit(None).cast("double").alias(c) for c in ("importance", "salience")]
    items = m.select(F.col("id").alias("idx"), F.when(F.col("id") % 29 == 0, "OTHER").otherwise(F.col("type")).alias("type"), F.when(F.col("id") % 31 == 0, 1.5).otherwise(F.col("confidence")).alias("confidence"), "content", "source",
                     F.when(F.col("id") % 2 == 0, "GLOBAL").otherwise("USER").alias("scope"), F.when(F.col("id") % 2 == 0, "").otherwise(F.concat(F.lit("u"), F.col("id") % 3)).alias("owner"), *nothing, *numbers)
    good = items.withColumn("good", writes.valid_memory()).select("idx", "scope", "owner", "type", "content", "good")
    return writes.import_plan(good, m.where("id % 3 = 0"))


@query(
    "a17_import_counters",
    ", items AS (SELECT id AS idx, CASE WHEN id % 29 = 0 THEN 'OTHER' ELSE type END AS type, CASE WHEN id % 31 = 0 THEN 1.5 ELSE confidence END AS confidence, content, CASE WHEN id % 2 = 0 THEN 'GLOBAL' ELSE 'USER' END AS scope, CASE WHEN id % 2 = 0 THEN '' ELSE 'u' || (id % 3) END AS owner FROM memories)"
    f", i AS (SELECT *, {_TYPED} AS good, {_NORM} AS norm FROM items), k AS (SELECT DISTINCT type, {_NORM} AS norm FROM memories WHERE status <> 'deleted' AND id % 3 = 0)"
    ", v AS (SELECT i.*, k.norm IS NOT NULL AS known FROM i LEFT JOIN k ON k.type = i.type AND k.norm = i.norm), fresh AS (SELECT DISTINCT scope, owner, type, lower(trim(content, ' ')) FROM v WHERE good AND NOT known)"
    " SELECT (SELECT count(*) FROM v WHERE NOT good) AS invalid, (SELECT count(*) FROM v WHERE good AND known) AS duplicates, (SELECT count(*) FROM fresh) AS would_import, (SELECT count(*) FROM v WHERE good AND NOT known) - (SELECT count(*) FROM fresh) AS repeated",
)
def _(spark, d):
    n = lambda v: F.count_if(F.col("verdict") == v)
    return _plan(spark, d).agg(n("invalid").alias("invalid"), n("duplicate").alias("duplicates"), n("import").alias("would_import"), n("repeated").alias("repeated"))


@query(
    "j15_import_links",
    f", l AS (SELECT source_memory_id AS s, CASE WHEN source_memory_id % 37 = 0 THEN 'likes' ELSE relation END AS relation, target_memory_id AS t FROM links), m AS (SELECT * REPLACE (CASE WHEN id % 3 < 2 THEN 'GLOBAL' ELSE scope END AS scope), row_number() OVER (ORDER BY id) + 500000 AS new FROM memories WHERE id % 5 <> 4) SELECT a.new AS source_memory_id, l.relation, b.new AS target_memory_id FROM l JOIN m a ON a.id = l.s JOIN m b ON b.id = l.t WHERE l.relation IN {_IN(LINKS)}"
    " AND (NOT (a.scope = 'USER' OR b.scope = 'USER') OR a.user_id IS NOT DISTINCT FROM b.user_id) AND (NOT (a.scope = 'SESSION' OR b.scope = 'SESSION') OR a.session_id IS NOT DISTINCT FROM b.session_id) AND (NOT (a.scope = 'PROJECT' AND b.scope = 'PROJECT') OR a.project_id IS NOT DISTINCT FROM b.project_id)",
)
def _(spark, d):
    rows = views.memories(spark, d).where("id % 5 <> 4").select(F.col("id").alias("old"), F.when(F.col("id") % 3 < 2, "GLOBAL").otherwise(F.col("scope")).alias("scope"), "user_id", "session_id", "project_id")
    ids = writes.numbered(rows.select("old"), ["old"], "place").select("old", (F.col("place") + 500000).alias("id"))
    asked = views.links(spark, d).select(F.col("source_memory_id").alias("source_id"), F.when(F.col("source_memory_id") % 37 == 0, "likes").otherwise(F.col("relation")).alias("relation"), F.col("target_memory_id").alias("target_id"), F.lit(None).cast("double").alias("confidence"))
    return writes.import_links(asked, rows, ids)


@query(
    "j16_import_relations",
    views.more_sql("entities", "relations") + ", batch AS (SELECT id AS old, id + 700000 AS id FROM entities WHERE id % 4 = 1), known AS (SELECT id FROM entities WHERE id % 3 = 0), e AS (SELECT * FROM batch UNION ALL SELECT id, id FROM known WHERE id NOT IN (SELECT old FROM batch)), m AS (SELECT id AS old, id + 900000 AS id FROM memories WHERE id % 2 = 0)"
    " SELECT s.id AS new_source_entity_id, r.relation, t.id AS new_target_entity_id, m.id AS new_memory_id FROM relations r JOIN e s ON s.old = r.source_entity_id JOIN e t ON t.old = r.target_entity_id LEFT JOIN m ON m.old = r.source_memory_id WHERE r.id % 53 <> 0 AND r.id % 59 <> 0",
)
def _(spark, d):
    e = views.more(spark, d, "entities")
    bad = F.when(F.col("id") % 53 == 0, 2.0).otherwise(0.5)
    rows = views.more(spark, d, "relations").withColumns({"confidence": bad, "valid_from": F.when(F.col("id") % 59 == 0, "2024-01-01").otherwise("2024-01-01T00:00:00Z"), "valid_until": F.lit(None).cast("string")})
    batch = e.where("id % 4 = 1").selectExpr("id AS old", "id + 700000 AS id")
    m = views.memories(spark, d).where("id % 2 = 0").selectExpr("id AS old", "id + 900000 AS id")
    return writes.import_relations(rows, batch, e.where("id % 3 = 0"), m)


@query(
    "f16_validators",
    views.more_sql("users", "entities", "preferences", "lessons")
    + " SELECT 'users' AS kind, count(*) AS n, CAST(count_if(id % 7 <> 0 AND id % 11 <> 0) AS BIGINT) AS valid FROM users UNION ALL SELECT 'entities', count(*), CAST(count_if(id % 6 <> 0) AS BIGINT) FROM entities UNION ALL SELECT 'preferences', count(*), CAST(count_if(id % 9 <> 0 AND id % 10 <> 3) AS BIGINT) FROM preferences UNION ALL SELECT 'lessons', count(*), CAST(count_if(id % 13 <> 0) AS BIGINT) FROM lessons"
    " UNION ALL SELECT 'profile', count(*), CAST(count_if(length(text) BETWEEN 1 AND 10000) AS BIGINT) FROM documents",
)
def _(spark, d):
    count = lambda df, name, ok: df.select(ok.alias("ok")).agg(F.count("*").alias("n"), F.count_if("ok").alias("valid")).select(F.lit(name).alias("kind"), "n", "valid")
    users = views.more(spark, d, "users").withColumn("external_id", F.when(F.col("id") % 7 == 0, F.lit("a\u0001b")).when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("external_id")))
    entities = views.more(spark, d, "entities").withColumn("name", F.when(F.col("id") % 6 == 0, F.repeat(F.lit("x"), 501)).otherwise(F.col("name")))
    prefs = views.more(spark, d, "preferences").withColumn("category", F.when(F.col("id") % 9 == 0, "hobby").otherwise(F.col("category"))).withColumn("confidence", F.when(F.col("id") % 10 == 3, -0.1).otherwise(F.col("confidence")))
    lessons = views.more(spark, d, "lessons").withColumn("mistake", F.when(F.col("id") % 13 == 0, "").otherwise(F.col("mistake")))
    profile = views.table(spark, d, "documents").select(F.lit("topics").alias("section"), F.col("text").alias("content"))
    parts = [count(users, "users", writes.valid_user()), count(entities, "entities", writes.valid_entity()), count(prefs, "preferences", writes.valid_preference()), count(lessons, "lessons", writes.valid_lesson()), count(profile, "profile", writes.valid_profile())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_RAW = "CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'not json' WHEN 2 THEN '[1,2]' WHEN 3 THEN '\"text\"' WHEN 4 THEN props ELSE '{\"trusted\":\"yes\",\"a\":1}' END"


@query("n02_parsed_or_raw", f"SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '\"not json\"' ELSE {_RAW} END AS metadata FROM events")
def _(spark, d):
    return views.table(spark, d, "events").select("event_id", documents.parsed_or_raw(F.expr(_RAW)).alias("metadata"))


@query(
    "n03_updated_metadata",
    f"SELECT event_id, CASE event_id % 18 // 6 WHEN 0 THEN CASE event_id % 6 WHEN 4 THEN CAST(json(props) AS VARCHAR) WHEN 5 THEN '{{\"trusted\":false,\"a\":1}}' END WHEN 1 THEN CASE event_id % 6 WHEN 5 THEN '{{\"b\":2,\"trusted\":false}}' ELSE '{{\"b\":2}}' END ELSE CASE event_id % 6 WHEN 5 THEN '{{\"trusted\":false}}' END END AS metadata FROM events",
)
def _(spark, d):
    new = F.expr("CASE event_id % 18 div 6 WHEN 0 THEN NULL WHEN 1 THEN '{\"trusted\":true,\"b\":2}' ELSE 'null' END")
    new = F.when(F.col("event_id") % 6 == 5, F.expr("CASE event_id % 18 div 6 WHEN 0 THEN NULL WHEN 1 THEN '{\"b\":2}' ELSE 'null' END")).otherwise(new)
    return views.table(spark, d, "events").select("event_id", documents.updated_metadata(F.expr(_RAW), new).alias("metadata"))


@query(
    "n04_trusted_flag",
    "SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{\"trusted\":' || f || '}' WHEN 1 THEN '{\"value\":\"not json\",\"trusted\":' || f || '}' WHEN 2 THEN '{\"value\":[1,2],\"trusted\":' || f || '}' WHEN 3 THEN '{\"value\":\"text\",\"trusted\":' || f || '}' WHEN 4 THEN rtrim(CAST(json(props) AS VARCHAR), '}') || ',\"trusted\":' || f || '}' ELSE '{\"trusted\":' || f || ',\"a\":1}' END AS metadata FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS f FROM events)",
)
def _(spark, d):
    return views.table(spark, d, "events").select("event_id", documents.with_trusted(F.expr(_RAW), F.col("event_id") % 2 == 0).alias("metadata"))


@query("n05_aliased_fields", "SELECT event_id, event_id % 40 AS source, CASE WHEN event_id % 2 = 0 THEN event_id % 7 END AS target FROM events")
def _(spark, d):
    row = F.expr("CASE WHEN event_id % 3 = 0 THEN to_json(struct(event_id % 40 AS sourceEntityId, event_id % 2 AS x)) ELSE to_json(struct(event_id % 40 AS source_entity_id, CASE WHEN event_id % 2 = 0 THEN event_id % 7 END AS targetEntityId)) END")
    rows = views.table(spark, d, "events").select("event_id", row.alias("r"), F.expr("CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN to_json(struct(event_id % 7 AS target_entity_id)) END").alias("more"))
    source = documents.aliased(F.col("r"), "sourceEntityId", "source_entity_id").cast("long")
    target = F.coalesce(documents.aliased(F.col("r"), "targetEntityId", "target_entity_id"), documents.aliased(F.col("more"), "targetEntityId", "target_entity_id")).cast("long")
    return rows.select("event_id", source.alias("source"), target.alias("target"))


@query("n01_metadata_fields", views.more_sql("captured") + " SELECT id, CASE WHEN (id // 100) % 11 > 3 THEN 't' || ((id // 100) % 17) END AS tool, CASE WHEN (id // 100) % 11 > 3 THEN '/d' || (id % 100 % 7) END AS directory FROM captured")
def _(spark, d):
    return views.more(spark, d, "captured").select("id", documents.metadata_field(F.col("meta"), "tool").alias("tool"), documents.metadata_field(F.col("meta"), "directory").alias("directory"))


_STAMP = "CASE event_id % 8 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%g+07:00') WHEN 4 THEN '2024-02-30T10:00:00Z' WHEN 5 THEN strftime(ts, '%Y-%m-%dT%H:%MZ') WHEN 6 THEN '2024-13-01T00:00:00Z' END"


@query("d02_iso_dates", f"SELECT event_id, coalesce(regexp_matches(s, '{documents.ISO}') AND TRY_CAST(substr(s, 1, 10) AS DATE) IS NOT NULL, false) AS iso FROM (SELECT event_id, {_STAMP} AS s FROM events)")
def _(spark, d):
    forms = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS'+07:00'", None, "yyyy-MM-dd'T'HH:mm'Z'"]
    made = F.when(F.col("event_id") % 8 == 4, "2024-02-30T10:00:00Z").when(F.col("event_id") % 8 == 6, "2024-13-01T00:00:00Z")
    for i, f in enumerate(forms):
        made = made.when(F.col("event_id") % 8 == i, F.date_format("ts", f)) if f else made
    return views.table(spark, d, "events").select("event_id", documents.is_iso(made).alias("iso"))


def _hook_sql() -> str:
    line = "x"
    out = "x"
    for p in reversed(text.HOOK_SECRETS):
        p = p.replace("(?i)", "")
        out = f"CASE WHEN regexp_matches({line}, '{p}', 'i') THEN regexp_replace({line}, '{p}', '[REDACTED]', 'i') ELSE {out} END"
    return f"SELECT doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x: {out}), chr(10))) AS body FROM documents"


@query("x04_hook_redaction", _hook_sql())
def _(spark, d):
    return views.table(spark, d, "documents").select("doc_id", F.md5(text.hook_redact(F.col("text"))).alias("body"))


@query("x22_canonical_names", "SELECT c_custkey, lower(trim('  ' || c_name || ' ')) AS name FROM customer")
def _(spark, d):
    return views.table(spark, d, "customer").select("c_custkey", documents.canonical(F.concat(F.lit("  "), F.col("c_name"), F.lit(" "))).alias("name"))


_TAGGED = "CASE WHEN item_id % 2 = 0 THEN '<Memory-Reference x>' || text || '</memory-reference>' ELSE text END"
_SAFE = rf"regexp_replace({_TAGGED}, '(?i)<(/?memory-reference\b[^>]*>)', '&lt;\1', 'g')"


@query("x25_wrapped", f"SELECT item_id, md5('{documents.GUIDANCE}' || chr(10) || '{documents.OPEN}' || chr(10) || CASE WHEN item_id % 3 = 0 THEN '{documents.UNTRUSTED_TAG} {documents.UNTRUSTED_NOTE}' || chr(10) ELSE '' END || {_SAFE} || chr(10) || '{documents.CLOSE}') AS block, md5('{documents.OPEN}' || CASE WHEN item_id % 3 = 0 THEN ' {documents.UNTRUSTED_TAG} {documents.UNTRUSTED_NOTE}' ELSE '' END || chr(10) || {_SAFE} || chr(10) || '{documents.CLOSE}') AS line FROM benchmark")
def _(spark, d):
    body, bad = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("<Memory-Reference x>"), F.col("text"), F.lit("</memory-reference>"))).otherwise(F.col("text")), F.col("item_id") % 3 == 0
    return views.table(spark, d, "benchmark").select("item_id", F.md5(documents.wrap(body, bad)).alias("block"), F.md5(documents.decorate(body, bad)).alias("line"))


@query("x29_titles", views.more_sql("preferences", "lessons") + " SELECT 'preferences' AS kind, id, category || '/' || key AS title, key || ': ' || value AS body FROM preferences UNION ALL SELECT 'lessons', id, substr(situation, 1, 80), 'Situation: ' || situation || ' | Mistake: ' || mistake || ' | Correction: ' || correction FROM lessons")
def _(spark, d):
    p = views.more(spark, d, "preferences").select(F.lit("preferences").alias("kind"), "id", documents.preference_title("category", "key").alias("title"), documents.preference_body("key", "value").alias("body"))
    return p.unionByName(views.more(spark, d, "lessons").select(F.lit("lessons").alias("kind"), "id", documents.lesson_title("situation").alias("title"), documents.lesson_body("situation", "mistake", "correction").alias("body")))


@query("x30_preference_text", views.more_sql("preferences") + " SELECT id, '[' || category || '] ' || key || ' = ' || value AS content FROM preferences")
def _(spark, d):
    return views.more(spark, d, "preferences").select("id", documents.preference_text("category", "key", "value").alias("content"))


_FILE = "CASE p_partkey % 7 WHEN 0 THEN p_name || '.json' WHEN 1 THEN 'export-' || p_partkey || '.json' WHEN 2 THEN 'Con.json' WHEN 3 THEN '../x.json' WHEN 4 THEN '.json' WHEN 5 THEN 'a.txt' ELSE 'lpt9.json' END"


@query("x32_file_names", "SELECT p_partkey, CASE WHEN p_partkey % 7 = 1 THEN 'export-' || p_partkey || '.json' END AS name FROM part")
def _(spark, d):
    return views.table(spark, d, "part").select("p_partkey", documents.file_name(F.expr(_FILE)).alias("name"))


@query("x34_dictionary_terms", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN lower(p_type) WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE p_name END AS term FROM part")
def _(spark, d):
    raw = F.expr("CASE p_partkey % 5 WHEN 0 THEN concat(' ', p_type, '  ') WHEN 1 THEN '   ' WHEN 2 THEN concat(p_name, char(7), 'x') WHEN 3 THEN repeat('ab', 51) ELSE p_name END")
    return views.table(spark, d, "part").select("p_partkey", documents.dictionary_term(raw).alias("term"))


@query("m15_two_digits", "SELECT p_partkey, printf('%.2f', p_retailprice) AS shown FROM part")
def _(spark, d):
    return views.table(spark, d, "part").select("p_partkey", documents.two_digits(F.col("p_retailprice")).alias("shown"))


@query("st8_error_status", "SELECT conv_id, turn, CASE WHEN regexp_matches(r, '\"is_error\"\\s*:\\s*true', 'i') OR contains(lower(substr(r, 1, 200)), 'error') THEN 'error' ELSE 'success' END AS status FROM (SELECT *, CASE conv_id % 4 WHEN 0 THEN text || '\"is_error\" : TRUE' WHEN 1 THEN 'Error: ' || text ELSE text END AS r FROM conversations)")
def _(spark, d):
    r = F.expr("CASE conv_id % 4 WHEN 0 THEN concat(text, '\"is_error\" : TRUE') WHEN 1 THEN concat('Error: ', text) ELSE text END")
    return views.table(spark, d, "conversations").select("conv_id", "turn", text.error_status(r).alias("status"))
