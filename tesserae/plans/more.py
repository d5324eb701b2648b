"""More queries of the registry: merges, imports, streams, evaluation, Thai and highlights."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tesserae.functions import highlight, scope, scoring, text, thai
from tesserae.operators import graph, lexical, mutate, retrieve
from tesserae.plans import views
from tesserae.plans.registry import SHOWN, VISIBLE, WHO, query


@query("s02_all_embeddings", f"SELECT 'memories' AS ref_table, id AS ref_id FROM memories WHERE status = 'active' AND {VISIBLE} AND id IN (SELECT vec_id FROM embeddings) UNION ALL SELECT 'lessons', p_partkey FROM part WHERE p_size < 5")
def _(spark, d):
    seen = views.memories(spark, d).where((F.col("status") == "active") & scope.visible(**WHO)).select("id")
    own = views.embeddings(spark, d).join(seen, "id", "left_semi").select(F.lit("memories").alias("ref_table"), F.col("id").alias("ref_id"))
    return own.unionByName(views.table(spark, d, "part").where("p_size < 5").select(F.lit("lessons").alias("ref_table"), F.col("p_partkey").alias("ref_id")))


@query("s04_by_keys", "SELECT id, type FROM memories WHERE id IN (SELECT item_id * 3 FROM benchmark)")
def _(spark, d):
    keys = views.table(spark, d, "benchmark").select((F.col("item_id") * 3).alias("id"))
    return views.memories(spark, d).join(keys, "id", "left_semi").select("id", "type")


@query("s09_vocabulary", r"SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{Co}\p{M}]+')) AS term FROM documents")
def _(spark, d):
    return views.table(spark, d, "documents").select(F.explode(text.index_terms(F.col("text"))).alias("term")).distinct()


@query("f06_interaction_owner", "SELECT event_id FROM events WHERE user_id = 7 OR (user_id IS NULL)")
def _(spark, d):
    return views.table(spark, d, "events").where(scope.interaction_owner(7, True)).select("event_id")


@query("a05_rank_fusion", ", a AS (SELECT id, row_number() OVER (ORDER BY confidence DESC, id) AS rank FROM memories WHERE scope = 'GLOBAL'), b AS (SELECT id, row_number() OVER (ORDER BY importance DESC, id) AS rank FROM memories WHERE scope = 'GLOBAL') SELECT id, round(sum(1.0 / (60 + rank)), 8) AS rrf FROM (SELECT * FROM a WHERE rank <= 50 UNION ALL SELECT * FROM b WHERE rank <= 50) GROUP BY id")
def _(spark, d):
    rows = views.memories(spark, d).where("scope = 'GLOBAL'")

    def channel(by):
        return rows.orderBy(F.desc(by), "id").limit(50).select("id", F.row_number().over(W.orderBy(F.desc(by), "id")).alias("rank"))

    return retrieve.fuse(channel("confidence"), channel("importance")).select("id", F.round("rrf", 8).alias("rrf"))


@query("a10_last_row_by_key", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def _(spark, d):
    return views.table(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"))


@query("a14_cluster_summary", "SELECT o_custkey AS cluster, string_agg(o_orderpriority, ' | ' ORDER BY o_orderkey) AS content FROM orders GROUP BY o_custkey")
def _(spark, d):
    got = views.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("cluster")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("m"))
    return got.select("cluster", F.array_join(F.transform("m", lambda x: x["o_orderpriority"]), " | ").alias("content"))


@query("a16_any_untrusted", "SELECT user_id, bool_or(json_extract_string(props, '$.k')::INT > 90) AS untrusted FROM events GROUP BY user_id")
def _(spark, d):
    return views.table(spark, d, "events").groupBy("user_id").agg(F.bool_or(F.get_json_object("props", "$.k").cast("int") > 90).alias("untrusted"))


@query("a19_retrieval_quality", ", r AS (SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY confidence DESC, id) AS rank, importance >= 0.5 AS relevant FROM memories) SELECT round(avg(hit), 6) AS hit5, round(avg(p), 6) AS p5, round(avg(rr), 6) AS mrr FROM (SELECT type, max(CASE WHEN relevant THEN 1.0 ELSE 0.0 END) AS hit, sum(CASE WHEN relevant THEN 1.0 ELSE 0.0 END) / 5 AS p, coalesce(max(CASE WHEN relevant THEN 1.0 / rank END), 0.0) AS rr FROM r WHERE rank <= 5 GROUP BY type)")
def _(spark, d):
    by = W.partitionBy("type").orderBy(F.desc("confidence"), "id")
    top = views.memories(spark, d).withColumn("rank", F.row_number().over(by)).where("rank <= 5").withColumn("ok", F.col("importance") >= 0.5)
    one = top.groupBy("type").agg(F.max(F.col("ok").cast("double")).alias("hit"), (F.sum(F.col("ok").cast("double")) / 5).alias("p"), F.coalesce(F.max(F.when(F.col("ok"), 1.0 / F.col("rank"))), F.lit(0.0)).alias("rr"))
    return one.agg(F.round(F.avg("hit"), 6).alias("hit5"), F.round(F.avg("p"), 6).alias("p5"), F.round(F.avg("rr"), 6).alias("mrr"))


@query("w04_two_channels", ", s AS (SELECT item_id AS id, row_number() OVER (ORDER BY item_id) AS rank FROM benchmark WHERE item_id % 3 = 0), l AS (SELECT item_id AS id, row_number() OVER (ORDER BY item_id) AS rank FROM benchmark WHERE item_id % 2 = 0), u AS (SELECT id, 0 AS channel, rank FROM s UNION ALL SELECT id, 1, rank FROM l WHERE id NOT IN (SELECT id FROM s)) SELECT id, channel, row_number() OVER (ORDER BY channel, rank) AS rank FROM u ORDER BY channel, u.rank LIMIT 20")
def _(spark, d):
    b = views.table(spark, d, "benchmark").select(F.col("item_id").alias("id"))
    s, p = (b.where(f"id % {k} = 0").withColumn("rank", F.row_number().over(W.orderBy("id"))) for k in (3, 2))
    return lexical.two_channels(s, p, 20).select("id", "channel", F.col("rank").cast("long").alias("rank"))


@query("w05_first_in_batch", "SELECT min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def _(spark, d):
    by = W.partitionBy("user_id", "event_type").orderBy("event_id")
    return views.table(spark, d, "events").withColumn("k", F.row_number().over(by)).where("k = 1").select("event_id")


@query("t05_latest_orders", "SELECT o_orderkey AS id FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5")
def _(spark, d):
    return views.table(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(5).select(F.col("o_orderkey").alias("id"))


@query("x08_loose_form", "SELECT c_custkey AS id, regexp_replace(lower(c_name || ' ติดตั้ง เซิร์ฟเวอร์ น้ำ'), '[่-ํ]', '', 'g') AS loose FROM customer")
def _(spark, d):
    return views.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), thai.loose(F.concat(F.col("c_name"), F.lit(" ติดตั้ง เซิร์ฟเวอร์ น้ำ"))).alias("loose"))


_THAI = "CASE id % 5 WHEN 0 THEN 'ผมใช้ฐานข้อมูล postgres' WHEN 1 THEN 'ติดตั้งแพ็กเกจใหม่ v2' WHEN 2 THEN 'ความจำเป็น' WHEN 3 THEN 'plain  text' ELSE 'ใช้pnpmเร็วมาก ๆ' END || ' ' || substr(content, 1, 40)"
_PADDED = f"CASE WHEN regexp_matches(t, '[฀-๿]') THEN regexp_replace(regexp_replace(t, '{thai.word_pattern()}', ' \\1 ', 'g'), ' {{2,}}', ' ', 'g') ELSE t END"


@query("x12_thai_segments", f", t AS (SELECT id, {_THAI} AS t FROM memories) SELECT id, {_PADDED} AS padded, regexp_extract_all(lower({_PADDED}), '[a-z0-9]+|[฀-๿]+') AS words FROM t".replace("\\\\1", "\\1"))
def _(spark, d):
    t = F.expr(_THAI)
    return views.memories(spark, d).select("id", thai.segmented(t).alias("padded"), thai.word_tokens(t).alias("words"))


@query("x11_forced_words", None)
def _(spark, d):
    rows = spark.createDataFrame([("ติดตั้งฐานข้อมูล",), ("ระบบฐานข้อมูลใหม่",), ("ฐาน ข้อมูล",), ("none",)], "content string")
    return rows.select("content", thai.word_tokens(F.col("content"), forced={"ระบบฐานข้อมูล": "ระบบฐานข้อมูล", "ติดตั้งฐานข้อมูล": "ติดตั้ง"}).alias("words"))


@query("x07_has_thai", "SELECT id, id % 5 <> 3 AS thai FROM memories")
def _(spark, d):
    return views.memories(spark, d).select("id", thai.has_thai(F.expr(_THAI)).alias("thai"))


@query("x24_sanitize", r"SELECT page_id, regexp_replace(CASE WHEN page_id % 2 = 0 THEN html || '<MEMORY-Reference a=1>x</memory-reference>' ELSE html END, '(?i)<(/?memory-reference\b[^>]*>)', '&lt;\1', 'g') AS html FROM pages")
def _(spark, d):
    html = F.when(F.col("page_id") % 2 == 0, F.concat("html", F.lit("<MEMORY-Reference a=1>x</memory-reference>"))).otherwise(F.col("html"))
    return views.table(spark, d, "pages").select("page_id", text.sanitize(html).alias("html"))


@query("x26_highlight", "SELECT p_partkey, CASE WHEN contains(p_name, ' ') THEN '[mem]' || p_name || '[/mem] of [mem]' || p_brand || '[/mem]' ELSE p_name || ' of [mem]' || p_brand || '[/mem]' END AS shown FROM part")
def _(spark, d):
    wanted = F.array(F.upper(F.col("p_brand")), F.when(F.col("p_name").contains(" "), F.col("p_name")).otherwise(""), F.lit("absent"))
    return views.table(spark, d, "part").select("p_partkey", highlight.highlighted(F.concat("p_name", F.lit(" of "), "p_brand"), wanted).alias("shown"))


@query("x27_spans", None)
def _(spark, d):
    rows = spark.createDataFrame([("Use PNPM with pnpm scripts", ["pnpm", "pnpm scripts", "scripts run"]), ("aaaa", ["aa"]), ("nothing", ["x"])], "content string, wanted array<string>")
    return rows.select("content", highlight.memory_spans("content", "wanted").alias("spans"), highlight.underlined("content", "wanted").alias("shown"))


@query("m08_token_estimate", "SELECT doc_id, CAST(ceil(length(text) / 4) + 8 AS BIGINT) AS tokens FROM documents")
def _(spark, d):
    return views.table(spark, d, "documents").select("doc_id", scoring.token_estimate(F.col("text")).cast("long").alias("tokens"))


@query("d01_age_in_days", "SELECT event_id, round(greatest(0.0, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 8.64e10), 6) AS age FROM events")
def _(spark, d):
    return views.table(spark, d, "events").select("event_id", F.round(scoring.age_days(F.col("ts").cast("timestamp"), F.lit("2024-02-01").cast("timestamp")), 6).alias("age"))


@query("d04_retention", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
def _(spark, d):
    return views.table(spark, d, "events").where(F.col("ts") >= F.expr("TIMESTAMP '2024-02-14' - INTERVAL 30 DAYS")).select("event_id")


@query("n01_meta_field", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(spark, d):
    return views.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("q05_recall", "SELECT 'lessons' AS section, p_partkey AS id FROM (SELECT p_partkey FROM part WHERE contains(lower(p_name), '1') ORDER BY p_partkey LIMIT 8) UNION ALL SELECT 'history', id FROM (SELECT id FROM interactions WHERE contains(lower(content), 'the') ORDER BY ts DESC, id LIMIT 20)")
def _(spark, d):
    lessons = views.table(spark, d, "part").where(scope.contains_text("p_name", "1")).orderBy("p_partkey").limit(8).select(F.lit("lessons").alias("section"), F.col("p_partkey").alias("id"))
    history = views.interactions(spark, d).where(scope.contains_text("content", "the")).orderBy(F.desc("ts"), "id").limit(20).select(F.lit("history").alias("section"), "id")
    return lessons.unionByName(history)


@query("q06_profile", "SELECT 'memories' AS section, id FROM (SELECT id FROM memories WHERE status = 'active' ORDER BY importance * confidence DESC, updated_at DESC, id LIMIT 15) UNION ALL SELECT 'preferences', c_custkey FROM (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15) UNION ALL SELECT 'lessons', o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5)")
def _(spark, d):
    m = views.memories(spark, d).where("status = 'active'").withColumn("w", F.col("importance") * F.col("confidence")).orderBy(F.desc("w"), F.desc("updated_at"), "id").limit(15).select(F.lit("memories").alias("section"), "id")
    p = views.table(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(15).select(F.lit("preferences").alias("section"), F.col("c_custkey").alias("id"))
    o = views.table(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(5).select(F.lit("lessons").alias("section"), F.col("o_orderkey").alias("id"))
    return m.unionByName(p).unionByName(o)


@query("q11_co_occurrence", ", e AS (SELECT item_id, list_slice(list_filter(regexp_extract_all(text, '[a-z]{6,}'), lambda x: true), 1, 12) AS w FROM benchmark), f AS (SELECT item_id, unnest(w) AS e, generate_subscripts(w, 1) AS i FROM e) SELECT x.e AS source, y.e AS target, count(*) AS n FROM f x JOIN f y ON x.item_id = y.item_id AND x.i < y.i GROUP BY ALL")
def _(spark, d):
    found = views.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.slice(F.regexp_extract_all("text", F.lit("[a-z]{6,}"), F.lit(0)), 1, 12).alias("entities"))
    return graph.co_occurring(found)


@query("q24_export", f"SELECT m.id, m.type, m.scope, c.c_name AS owner FROM memories m LEFT JOIN customer c ON c.c_custkey = m.user_id WHERE {SHOWN} AND {VISIBLE}")
def _(spark, d):
    import uuid

    from tesserae.sources import io
    from tesserae.sources.shared import durable

    users = views.table(spark, d, "customer").selectExpr("c_custkey AS user_id", "c_name AS owner")
    out = views.memories(spark, d).where(scope.not_hidden() & scope.visible(**WHO)).join(users, "user_id", "left").select("id", "type", "scope", "owner")
    path = f"{durable(spark)}/export-{uuid.uuid4().hex}"
    io.write_json(out, path)
    return spark.read.schema(out.schema).json(path)


@query("u07_merge", "SELECT id, CASE WHEN id % 40 = 1 THEN 'superseded' WHEN id % 40 = 0 AND id + 1 IN (SELECT id FROM memories) THEN 'active' ELSE status END AS status FROM memories")
def _(spark, d):
    m = views.memories(spark, d)
    pairs = m.where("id % 40 = 1").selectExpr("id AS old", "id - 1 AS new")
    return mutate.supersede(m, pairs).select("id", "status")


@query("u13_import", "SELECT id FROM memories UNION SELECT doc_id + 500 FROM documents")
def _(spark, d):
    old = views.memories(spark, d).select("id")
    return mutate.insert_missing(old, old.select((F.col("id") + 500).alias("id")), ["id"])


@query("u15_set_validity", "SELECT id, CASE WHEN id % 9 = 0 THEN TIMESTAMP '2024-06-01' ELSE valid_until END AS valid_until FROM memories")
def _(spark, d):
    return views.memories(spark, d).select("id", F.when(F.col("id") % 9 == 0, F.lit("2024-06-01").cast("timestamp")).otherwise(F.col("valid_until")).alias("valid_until"))


@query("st2_stream_dedupe", None)
def _(spark, d):
    from tesserae.plans.streams import _folder, _ran
    from tesserae.streaming import capture

    rows = views.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _ran(spark, capture.distinct_events(capture.captured(capture.events(spark, _folder(spark, rows, "events")))).select("id", "kind", "user_id"), "dedupe")


@query("st9_backfill_owner", "SELECT id, coalesce(user_id, 0) AS user_id FROM memories")
def _(spark, d):
    return views.memories(spark, d).select("id", F.coalesce("user_id", F.lit(0)).alias("user_id"))
