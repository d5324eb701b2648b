"""Queries of streams, snapshots, scrubbing, migration and index maintenance."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tesserae.functions import documents, text, thai
from tesserae.operators import lexical, mutate, writes
from tesserae.plans import views
from tesserae.plans.registry import _redacted_sql, query
from tesserae.sources import io
from tesserae.sources.shared import durable
from tesserae.streaming import capture


def _top(spark, name):
    return f"{durable(spark)}/{name}-{uuid.uuid4().hex}"


def _folder(spark, df, name, json=False):
    """A folder with the rows, to be read as a stream."""
    path = _top(spark, name)
    df.write.json(path) if json else df.write.parquet(path)
    return path


def _ran(spark, rows, name):
    """The rows that a stream has written when it has read all there is."""
    top = _top(spark, name)
    capture.append(rows, f"{top}/rows", f"{top}/state").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{top}/rows")


_HOOKS = (
    "concat('e', conv_id, '-', turn) AS id", "concat('s', conv_id % 9) AS session_id", "timestampadd(SECOND, CAST(conv_id * 60 + turn AS INT), TIMESTAMP '2024-01-01 00:00:00') AS ts",
    "CASE WHEN turn = 0 AND conv_id % 5 = 0 THEN 'SessionEnd' WHEN role = 'user' THEN 'UserPromptSubmit' WHEN role = 'assistant' THEN 'PostToolUse' ELSE 'PreCompact' END AS hook_event_name",
    "CASE WHEN conv_id % 7 = 0 THEN '  ' ELSE text END AS prompt", "concat('t', turn % 4) AS tool_name", "CASE WHEN conv_id % 3 = 0 THEN concat('Error: ', text) ELSE text END AS tool_response",
)
_HOOK_SQL = "(SELECT 'e' || conv_id || '-' || turn AS id, 's' || (conv_id % 9) AS session_id, CASE WHEN turn = 0 AND conv_id % 5 = 0 THEN 'SessionEnd' WHEN role = 'user' THEN 'UserPromptSubmit' WHEN role = 'assistant' THEN 'PostToolUse' ELSE 'PreCompact' END AS name, CASE WHEN conv_id % 7 = 0 THEN '  ' ELSE text END AS prompt, 't' || (turn % 4) AS tool, CASE WHEN conv_id % 3 = 0 THEN 'Error: ' || text ELSE text END AS answer FROM conversations)"


@query("s11_hook_stream", f"SELECT id, session_id, CASE name WHEN 'UserPromptSubmit' THEN 'prompt' ELSE 'tool_call' END AS kind, CASE name WHEN 'UserPromptSubmit' THEN length(prompt) ELSE length('tool=' || tool) END AS size, CASE name WHEN 'PostToolUse' THEN CASE WHEN contains(lower(substr(answer, 1, 200)), 'error') THEN 'error' ELSE 'success' END END AS status FROM {_HOOK_SQL} WHERE name = 'PostToolUse' OR name = 'UserPromptSubmit' AND trim(prompt) <> ''")
def _(spark, d):
    path = _folder(spark, views.table(spark, d, "conversations").selectExpr(*_HOOKS), "hooks", json=True)
    rows = capture.hooked(capture.hooks(spark, path))
    return _ran(spark, rows.select("id", "session_id", "kind", F.length("content").alias("size"), F.get_json_object("meta", "$.status").alias("status")), "hooked")


@query("st2_distinct_ids", "SELECT event_id AS id, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    rows = views.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")
    path = _folder(spark, rows.unionByName(rows), "events")
    got = _ran(spark, capture.distinct_ids(capture.captured(capture.events(spark, path)), "1000 days").select("id", "kind"), "distinct")
    return got.groupBy("id").agg(F.count("*").alias("n"))


@query("w06_bounded_memory", "SELECT count(*) AS rows, count(DISTINCT event_id) AS ids FROM events")
def _(spark, d):
    rows = views.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")
    path = _folder(spark, rows.unionByName(rows), "events")
    seen = capture.first_seen(capture.events(spark, path).select(F.col("event_id").alias("id"), "user_id"), "user_id", 100_000)
    return _ran(spark, seen, "seen").agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"))


@query("st5_enriched_stream", "SELECT event_id AS id, CASE WHEN user_id % 3 > 0 THEN 'profile of ' || user_id END AS additional_context FROM events WHERE event_type IN ('click', 'view')")
def _(spark, d):
    rows = views.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")
    profiles = rows.select("user_id").distinct().where("user_id % 3 > 0").select("user_id", F.concat(F.lit("profile of "), F.col("user_id")).alias("profile"))
    stream = capture.enriched(capture.captured(capture.events(spark, _folder(spark, rows, "events"))), profiles)
    return _ran(spark, stream.select("id", "additional_context"), "enriched")


@query("st6_session_end", f"SELECT DISTINCT session_id FROM {_HOOK_SQL} WHERE name = 'SessionEnd'")
def _(spark, d):
    path, out = _folder(spark, views.table(spark, d, "conversations").selectExpr(*_HOOKS), "hooks", json=True), _top(spark, "ended")
    ran = capture.on_session_end(capture.hooks(spark, path), lambda ended, n: ended.write.mode("overwrite").parquet(f"{out}/batch={n}"), _top(spark, "state"))
    ran.awaitTermination()
    return spark.read.schema("session_id string, batch int").parquet(out).select("session_id").distinct()


@query("st7_retained", "SELECT event_id, CAST(ts AS DATE) AS day FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-15'")
def _(spark, d):
    path = _top(spark, "retained")
    views.table(spark, d, "events").select("event_id", F.to_date("ts").alias("day")).write.partitionBy("day").parquet(path)
    return mutate.retained(spark.read.parquet(path), "day", F.lit("2024-02-14").cast("date"), 30).select("event_id", "day")


@query("s06_set_status", "SELECT id, CASE WHEN id % 6 = 2 THEN 'archived' ELSE status END AS status, CASE WHEN id % 6 = 2 THEN TIMESTAMP '2025-01-01' ELSE updated_at END AS updated_at FROM memories")
def _(spark, d):
    m = views.memories(spark, d)
    changes = m.where("id % 6 = 2").select("id", F.lit("archived").alias("status"))
    return mutate.set_status(m, changes, F.lit(views.NOW).cast("timestamp")).select("id", "status", "updated_at")


@query("s07_json_import", "SELECT id, type, confidence FROM memories WHERE id < 150")
def _(spark, d):
    top = _top(spark, "imports")
    io.write_json(views.memories(spark, d).where("id < 150").select("id", "type", "content", "confidence"), f"{top}/in")
    return io.read_import(spark, f"{top}/in", top).select("id", "type", "confidence")


@query("s12_snapshot", "SELECT 'customer' AS table_name, count(*) AS n FROM customer UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'snapshots', 2")
def _(spark, d):
    top = _top(spark, "snapshots")
    tables = {t: views.table(spark, d, t) for t in ("customer", "part")}
    for k in range(3):
        names = io.snapshot(tables, top, f"2025-01-0{k + 1}", keep=2)
    copied = {t: spark.read.parquet(f"{top}/{names[-1]}/{t}") for t in tables}
    left = spark.createDataFrame([("snapshots", len(names))], "table_name string, n long")
    return io.counts(copied).unionByName(left)


_SCRUBBED = {"documents": ("doc_id", ["text"]), "conversations": ("conv_id", ["text"]), "benchmark": ("item_id", ["text"]), "pages": ("page_id", ["url"]), "customer": ("c_custkey", ["c_name"]), "part": ("p_partkey", ["p_name", "p_type"]), "events": ("event_id", ["props"]), "supplier": ("s_suppkey", ["s_name"]), "orders": ("o_orderkey", ["o_orderpriority"])}


@query("u14_scrub_counts", " UNION ALL ".join(f"{'SELECT' if i else ' SELECT'} '{t}' AS table_name, CAST(count_if({' OR '.join(f'{c} <> {_redacted_sql(c)}' for c in cols)}) AS BIGINT) AS changed, count(*) AS rows FROM {t}" for i, (t, (_, cols)) in enumerate(_SCRUBBED.items())))
def _(spark, d):
    out = None
    for t, (_key, columns) in _SCRUBBED.items():
        rows, changed = mutate.scrub(views.table(spark, d, t).select(*columns), columns, text.redact)
        one = rows.agg(changed.alias("changed"), F.count("*").alias("rows")).select(F.lit(t).alias("table_name"), "changed", "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("x03_redacted_json", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{\"a\": [\"[REDACTED]\", 1], \"k\": {\"b\": null}}' WHEN 1 THEN 'not json [REDACTED]' ELSE '{\"n\": {\"n\": {\"n\": {\"n\": {\"n\": {\"n\": {\"n\": {\"n\": {\"n\": {\"n\": \"[REDACTED]\"}}}}}}}}}}' END AS meta FROM events")
def _(spark, d):
    deep = '{"n": ' * 10 + '{"m": 1}' + "}" * 10
    raw = F.when(F.col("event_id") % 3 == 0, '{"a": ["token=abcdef12", 1], "k": {"b": null}}').when(F.col("event_id") % 3 == 1, "not json password=abcdef").otherwise(deep)
    return views.table(spark, d, "events").select("event_id", text.redact_json(raw).alias("meta"))


@query("u18_backfill", views.more_sql("preferences", "lessons") + ", n AS (SELECT 'PREFERENCE' AS type, '[' || category || '] ' || key || ' = ' || value AS content FROM preferences UNION ALL SELECT 'LESSON', 'Situation: ' || situation || ' | Mistake: ' || mistake || ' | Correction: ' || correction FROM lessons) SELECT type, content FROM memories WHERE id % 2 = 0 UNION ALL SELECT DISTINCT type, content FROM n")
def _(spark, d):
    old = views.memories(spark, d).where("id % 2 = 0").select("type", "content")
    p = views.more(spark, d, "preferences").select(F.lit("PREFERENCE").alias("type"), documents.preference_text("category", "key", "value").alias("content"))
    new = p.unionByName(views.more(spark, d, "lessons").select(F.lit("LESSON").alias("type"), documents.lesson_body("situation", "mistake", "correction").alias("content")))
    return writes.backfill(writes.backfill(old, new), new)  # a second run adds nothing


@query("u16_refreshed_index", r", t AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 = 3 THEN 'changed text ' || doc_id ELSE text END AS x FROM documents WHERE doc_id % 10 <> 4), w AS (SELECT id, regexp_extract_all(strip_accents(lower(x)), '[\p{L}\p{N}\p{Co}\p{M}]+') AS w FROM t) SELECT id, len(w) AS length, len(list_distinct(w)) AS terms FROM w WHERE len(w) > 0")
def _(spark, d):
    docs = views.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    index = lexical.postings(docs, F.col("text"))
    changed = docs.where("id % 10 = 3").select("id", F.concat(F.lit("changed text "), F.col("id")).alias("text"))
    new = lexical.refreshed(index, changed, F.col("text"), docs.where("id % 10 = 4").select("id"))
    return new.groupBy("id").agg(F.max("length").cast("long").alias("length"), F.count("*").alias("terms"))


@query("q19_antonyms", "SELECT l.source_memory_id, l.target_memory_id, len(list_filter({0}, lambda w: contains(lower(a.says), w))) > 0 AND len(list_filter({0}, lambda w: contains(lower(b.says), w))) > 0 AND len(list_distinct(list_filter({0}, lambda w: contains(lower(a.says), w)) || list_filter({0}, lambda w: contains(lower(b.says), w)))) > 1 AS opposite FROM links l JOIN (SELECT id, substr(content, 1, 400) || CASE id % 4 WHEN 0 THEN ' tabs' WHEN 1 THEN ' machine' ELSE '' END AS says FROM memories) a ON a.id = l.source_memory_id JOIN (SELECT id, substr(content, 1, 400) || CASE id % 4 WHEN 0 THEN ' tabs' WHEN 1 THEN ' machine' ELSE '' END AS says FROM memories) b ON b.id = l.target_memory_id".format("[" + ", ".join(f"'{w}'" for w in text.ANTONYMS) + "]"))
def _(spark, d):
    from tesserae.operators import conflict

    says = F.concat(F.substring("content", 1, 400), F.when(F.col("id") % 4 == 0, " tabs").when(F.col("id") % 4 == 1, " machine").otherwise(""))
    m = views.memories(spark, d).select("id", says.alias("says"))
    rows = views.links(spark, d).join(m.alias("a"), F.col("a.id") == F.col("source_memory_id")).join(m.alias("b"), F.col("b.id") == F.col("target_memory_id"))
    return rows.select("source_memory_id", "target_memory_id", conflict.opposite(F.col("a.says"), F.col("b.says")).alias("opposite"))


@query("m03_scope_factors", "SELECT id, CAST(CASE scope WHEN 'SESSION' THEN CASE WHEN session_id = 's3' THEN 1.0 ELSE 0.2 END WHEN 'GLOBAL' THEN 0.6 ELSE 0.8 END AS DOUBLE) AS by_session, CAST(CASE scope WHEN 'PROJECT' THEN CASE WHEN project_id = 'p2' THEN 1.0 ELSE 0.3 END WHEN 'USER' THEN 0.8 WHEN 'GLOBAL' THEN 0.7 ELSE 0.3 END AS DOUBLE) AS by_project, CAST(CASE scope WHEN 'USER' THEN 1.0 WHEN 'GLOBAL' THEN 0.7 ELSE 0.3 END AS DOUBLE) AS by_user, CAST(CASE scope WHEN 'GLOBAL' THEN 0.8 WHEN 'PROJECT' THEN 0.7 WHEN 'USER' THEN 0.6 ELSE 0.4 END AS DOUBLE) AS alone FROM memories")
def _(spark, d):
    from tesserae.functions import scoring

    return views.memories(spark, d).select("id", scoring.scope_factor(session_id="s3").alias("by_session"), scoring.scope_factor(project_id="p2").alias("by_project"), scoring.scope_factor(user_id=1).alias("by_user"), scoring.scope_factor().alias("alone"))


@query("x10_dictionary_segments", None)
def _(spark, d):
    rows = spark.createDataFrame([("ถอนการติดตั้งระบบ",), ("กขค",), ("เรียกใช้งาน",)], "content string")
    return rows.select("content", thai.word_tokens(F.col("content"), extra=("งาน",)).alias("words"))
