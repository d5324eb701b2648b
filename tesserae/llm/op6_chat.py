"""Operator 6: chat formatting by quotation linking, in DataFrame functions only.

A line that starts with ">" marks is a quotation at that many levels. Runs of lines of one level
are passages. What a message says itself (level 0, without "... wrote:" lines) is filed as a
whole, by paragraph and by line; passages, and their lines, are normalised (lower case, letters
and digits only), hashed and joined to the latest earlier message of the conversation that says
the same. A message replies to the source of its outermost passage that has one (its longest
match). Replies form trees; each message gets its root and depth, so that sorting by (conv_id,
root_turn, turn) is a reply order in which parents come first, and `formatted`, the message
without quotations after its role.

The join is an as-of join in two levels, within blocks of BLOCK turns and over the blocks' maxima,
so neither a hot conversation nor a line that a conversation repeats is ever gathered in one task.
Roots are found by pointer doubling over the replies only.

Messages of any length are taken whole, in time that grows with their lines. Null texts say and
quote nothing (body ""); a null turn or conv_id links with nothing. Rows that
repeat a (conv_id, turn) all stay, and share the least parent. An empty table gives an empty
result; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import let, materialize

BLOCK = 1024
_MARKS = r"^(?:[ \t]*>)+"
_WROTE = r"(?i)^\s*(on\b.{1,200}\bwrote|.{1,80}\bschrieb|le\b.{1,200}a écrit)\s*:\s*$"


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), "[^>]", ""))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """Each message with `lines`, array<struct<at, level, text>>, and `body`, what it says itself."""
    lines = F.split(F.coalesce("text", F.lit("")), "\r?\n")
    lines = F.transform(lines, lambda x, i: F.struct(i.alias("at"), level(x).alias("level"), F.trim(F.regexp_replace(x, _MARKS, "")).alias("text")))
    out = messages.withColumn("lines", lines)
    quotes = F.exists("lines", lambda x: x["level"] > 0)
    own = F.filter("lines", lambda x: (x["level"] == 0) & ~(quotes & x["text"].rlike(_WROTE)))
    body = F.trim(F.regexp_replace(F.array_join(F.transform(own, lambda x: x["text"]), "\n"), r"\n{3,}", "\n\n"), F.lit("\n "))
    return out.withColumn("body", body)


def _starts(lines: Column) -> Column:
    """Where a run of lines of one level begins, from 0; and the number of lines."""
    places = F.sequence(F.lit(0), F.size(lines) - 1)  # there is one line at least
    fresh = F.filter(places, lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]))
    return F.concat(fresh, F.array(F.size(lines)))


def _passages(lines: Column) -> Column:
    """Runs of quoted lines of one level: array<struct<level, texts>>. Each line is looked at a fixed number of times."""

    def runs(starts: Column) -> Column:
        whole = F.transform(F.slice(starts, 1, F.size(starts) - 1), lambda a, k: F.slice(lines, a + 1, F.get(starts, k + 1) - a))
        quoted = F.filter(whole, lambda r: r[0]["level"] > 0)
        return F.transform(quoted, lambda r: F.struct(r[0]["level"].alias("level"), F.transform(r, lambda x: x["text"]).alias("texts")))

    return let(_starts(lines), runs)


def _quotes(lines: Column) -> Column:
    """The number of passages."""
    return F.size(F.filter(_starts(lines), lambda i: F.coalesce(F.get(lines, i)["level"] > 0, F.lit(False)))).cast("long")


def _units(messages: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, own, level, size, key): what is said (own) and quoted, by hash."""
    of = messages.where("conv_id is not null and turn is not null")
    said = F.array_distinct(F.concat(F.array("body"), F.split("body", r"\n\s*\n"), F.split("body", "\n")))
    own = of.select("conv_id", "turn", F.lit(True).alias("own"), F.lit(0).alias("level"), F.explode(said).alias("unit"))
    quoting = of.where(F.exists("lines", lambda x: x["level"] > 0))
    runs = quoting.select("conv_id", "turn", F.explode(let(F.col("lines"), _passages)).alias("run"))
    quoted = runs.select("conv_id", "turn", F.lit(False).alias("own"), F.col("run.level").alias("level"), F.explode(F.array_distinct(F.concat(F.array(F.array_join("run.texts", "\n")), F.col("run.texts")))).alias("unit"))
    units = own.unionByName(quoted).withColumn("unit", normal(F.col("unit"))).where("unit <> ''")
    return units.select("conv_id", "turn", "own", "level", F.length("unit").alias("size"), F.sha2("unit", 256).alias("key"))


def linked(messages: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, parent_turn, n_linked) for the messages with a quotation whose source is known."""
    units = _units(messages)
    wanted = units.where("not own").select("conv_id", "key").distinct()
    said = units.where("own").join(wanted, ["conv_id", "key"], "left_semi")  # only what is quoted somewhere
    events = said.unionByName(units.where("not own")).withColumn("block", F.floor(F.col("turn") / BLOCK))
    said_at = F.when(F.col("own"), F.col("turn"))
    inside = W.partitionBy("conv_id", "key", "block").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    over = W.partitionBy("conv_id", "key").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = events.groupBy("conv_id", "key", "block").agg(F.max(said_at).alias("_last")).withColumn("_earlier", F.max("_last").over(over)).drop("_last")
    found = events.withColumn("_near", F.max(said_at).over(inside)).where("not own").join(blocks, ["conv_id", "key", "block"])
    found = found.withColumn("source", F.coalesce("_near", "_earlier")).where("source is not null")
    by_level = found.groupBy("conv_id", "turn", "level").agg(F.max(F.struct("size", "source"))["source"].alias("source"))
    return by_level.groupBy("conv_id", "turn").agg(F.min(F.struct("level", "source"))["source"].alias("parent_turn"), F.count("*").alias("n_linked"))


def threads(replies: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, root_turn, depth) for replies (conv_id, turn, parent_turn); parents are earlier."""
    at = materialize(replies.select("conv_id", "turn", F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth")), "replies")
    while True:
        up = at.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("_root"), F.col("depth").alias("_depth"))
        step = at.join(up, ["conv_id", "root_turn"], "left")
        step = materialize(step.select("conv_id", "turn", F.coalesce("_root", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.col("_root").isNotNull().alias("_moved")), "replies")
        at = step.drop("_moved")
        if step.where("_moved").limit(1).count() == 0:
            return at


def format_chat(messages: DataFrame) -> DataFrame:
    said = parsed(messages.select("conv_id", "turn", "role", "text"))
    replies = materialize(linked(said), "linked")
    trees = replies.join(threads(replies), ["conv_id", "turn"])
    n_quotes = let(F.col("lines"), _quotes)
    out = said.select("conv_id", "turn", "role", "body", n_quotes.alias("n_quotes")).join(trees, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id",
        "turn",
        "role",
        "body",
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("body")).alias("formatted"),
        "n_quotes",
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "parent_turn",
        F.coalesce("root_turn", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chat(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: The same in SQL: units by unnesting, the latest earlier source by a correlated maximum, roots by recursion.
ORACLE = r"""
WITH RECURSIVE line AS (
  SELECT conv_id, turn, role, rid, ix, raw,
         length(regexp_replace(regexp_extract(raw, '^([ \t]*>)+'), '[^>]', '', 'g')) AS level,
         trim(regexp_replace(raw, '^([ \t]*>)+', ''), ' ') AS text
  FROM (SELECT conv_id, turn, role, rid, unnest(lines) AS raw, generate_subscripts(lines, 1) AS ix
        FROM (SELECT conv_id, turn, role, row_number() OVER () AS rid,
                     string_split_regex(coalesce(text, ''), '\r?\n') AS lines FROM conversations))
), said AS (
  SELECT rid, any_value(conv_id) AS conv_id, any_value(turn) AS turn, any_value(role) AS role,
         coalesce(trim(regexp_replace(string_agg(text, chr(10) ORDER BY ix) FILTER (WHERE level = 0 AND NOT (quoting
           AND regexp_matches(text, '(?i)^\s*(on\b.{1,200}\bwrote|.{1,80}\bschrieb|le\b.{1,200}a écrit)\s*:\s*$'))),
           '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || ' '), '') AS body
  FROM (SELECT *, bool_or(level > 0) OVER (PARTITION BY rid) AS quoting FROM line) GROUP BY rid
), run AS (
  SELECT rid, any_value(conv_id) AS conv_id, any_value(turn) AS turn, any_value(level) AS level, grp,
         string_agg(text, chr(10) ORDER BY ix) AS whole
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY rid ORDER BY ix) AS grp
        FROM (SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY rid ORDER BY ix) THEN 0 ELSE 1 END AS fresh FROM line))
  GROUP BY rid, grp HAVING any_value(level) > 0
), unit AS (
  SELECT DISTINCT conv_id, turn, own, level, trim(regexp_replace(lower(unit), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') AS unit FROM (
    SELECT conv_id, turn, true AS own, 0 AS level, unnest([body] || string_split_regex(body, '\n\s*\n') || string_split(body, chr(10))) AS unit FROM said
    UNION ALL
    SELECT conv_id, turn, false, level, unnest([whole] || string_split(whole, chr(10))) FROM run)
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), found AS (
  SELECT q.conv_id, q.turn, q.level, length(q.unit) AS size, max(o.turn) AS source
  FROM unit q JOIN unit o ON NOT q.own AND o.own AND q.conv_id = o.conv_id AND q.unit = o.unit AND o.turn < q.turn AND q.unit <> ''
  GROUP BY ALL
), best AS (
  SELECT conv_id, turn, level, arg_max(source, size * 1000000000 + source) AS source FROM found GROUP BY ALL
), reply AS (
  SELECT conv_id, turn, arg_min(source, level) AS parent_turn, count(*) AS n_linked FROM best GROUP BY ALL
), up AS (
  SELECT conv_id, turn, parent_turn AS root_turn, CAST(1 AS BIGINT) AS depth FROM reply
  UNION ALL
  SELECT up.conv_id, up.turn, reply.parent_turn, up.depth + 1 FROM up JOIN reply ON up.conv_id = reply.conv_id AND up.root_turn = reply.turn
), root AS (
  SELECT conv_id, turn, arg_max(root_turn, depth) AS root_turn, max(depth) AS depth FROM up GROUP BY ALL
)
SELECT s.conv_id, s.turn, s.role, s.body, '<|' || coalesce(s.role, 'unknown') || '|>' || chr(10) || s.body AS formatted,
       coalesce((SELECT count(*) FROM run WHERE run.rid = s.rid), 0) AS n_quotes, coalesce(r.n_linked, 0) AS n_linked,
       r.parent_turn, coalesce(root.root_turn, s.turn) AS root_turn, coalesce(root.depth, 0) AS depth
FROM said s LEFT JOIN reply r ON s.conv_id = r.conv_id AND s.turn = r.turn
LEFT JOIN root ON s.conv_id = root.conv_id AND s.turn = root.turn
"""
