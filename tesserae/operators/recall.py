"""Recall, profile, extraction from what was said, and learning of dictionary terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import documents, scope, scoring, text, thai
from tesserae.operators import lexical

RECALL_BUDGET, PROFILE_BUDGET, RECENT = 2000, 3000, 20


def matching(preferences: DataFrame, lessons: DataFrame, topic: str, limit: int, uid: int) -> DataFrame:
    """Rows of (section, id): the first rows by id that the lexical index finds, then what of them is shared or the caller's own.

    Below strict hits come those of the loose channel, while there are fewer than `limit`.
    """
    rows = preferences.select(F.lit("preferences").alias("section"), "id", F.concat_ws(" ", documents.preference_title("category", "key"), documents.preference_body("key", "value")).alias("body"), "user_id")
    rows = rows.unionByName(lessons.select(F.lit("lessons").alias("section"), "id", documents.lesson_body("situation", "mistake", "correction").alias("body"), "user_id"))
    strict, fuzzy = thai.query_phrases(topic), thai.query_phrases(topic, True)
    if not strict:
        return rows.limit(0).select("section", "id")
    rows = rows.withColumn("body", thai.fold(thai.expanded(thai.segmented(F.col("body")))))
    hit = lambda body, phrases: F.lit(False) if not phrases else _any([lexical.holds(body, p) for p in phrases])
    found = rows.select("section", "id", "user_id", F.when(hit(F.col("body"), strict), 0).when(hit(thai.loose(F.col("body")), fuzzy), 1).alias("channel")).where("channel IS NOT NULL")
    first = found.orderBy("channel", F.desc("section"), "id").limit(limit)
    return first.where(scope.personal(uid)).select("section", "id")


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def recent(interactions: DataFrame, topic: str, uid: int, owner: bool) -> DataFrame:
    """Rows of (section, id): the latest interactions of the caller that contain the topic."""
    mine = interactions.where(F.coalesce(scope.interaction_owner(uid, owner), F.lit(False)) & scope.contains_text("content", topic))
    return mine.orderBy(F.desc("id")).limit(RECENT).select(F.lit("interactions").alias("section"), "id")


def scoped_vectors(embeddings: DataFrame, memories: DataFrame) -> DataFrame:
    """Vectors (ref_table, id, vec) of visible active memories, and all those of other tables."""
    own = embeddings.where("ref_table = 'memories'").join(memories.select("id"), "id", "left_semi").select("ref_table", "id", "vec")
    return own.unionByName(embeddings.where("ref_table <> 'memories'").select("ref_table", "id", "vec"))


def blend(embeddings: DataFrame, memories: DataFrame, vector: list[float], limit: int, shown: DataFrame, floor: float = 0.15) -> DataFrame:
    """The nearest rows to a topic's vector that aren't shown already. Memories compete for the places and aren't shown."""
    wide = F.array(*[F.lit(float(x)) for x in vector])
    rows = scoped_vectors(embeddings, memories).select("ref_table", "id", F.round(scoring.dot(F.col("vec"), wide), 5).alias("score")).where(F.col("score") >= floor)
    top = rows.orderBy(F.desc("score"), "ref_table", "id").limit(limit)
    return top.where("ref_table <> 'memories'").join(shown, ["ref_table", "id"], "left_anti")


def recalled(lines: DataFrame, topic: str) -> DataFrame:
    """One row, `shown`: few lines (section, place, line) as sections, cut to the budget and wrapped."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n")
    sections = lines.groupBy("section").agg(F.concat(F.lit("["), F.first("section"), F.lit("]\n"), ordered).alias("body"))
    block = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((F.col("section") != "preferences").alias("a"), (F.col("section") != "lessons").alias("b"), "body"))), lambda x: x["body"]), "\n\n")
    none = f'no memory found for "{topic[:100]}"'
    return sections.agg(block.alias("t")).select(F.when(F.length("t") > 0, documents.wrap(text.truncate(F.col("t"), RECALL_BUDGET))).otherwise(none).alias("shown"))


def profile(preferences: DataFrame, lessons: DataFrame, memories: DataFrame, uid: int, **who) -> DataFrame:
    """One row, `profile`: the best preferences, the latest lessons and the top memories, within the budget and wrapped.

    Each section is a top-k of a few rows before anything meets in one task.
    """
    cut = text.truncate
    p = preferences.where(scope.personal(uid)).orderBy(F.desc("confidence"), F.desc("updated_at"), "id").limit(15)
    p_line = F.concat(F.lit("- ("), documents.two_digits(F.col("confidence")), F.lit(") "), cut(F.col("category"), 30), F.lit("/"), F.col("key"), F.lit(": "), cut(F.col("value"), 120))
    lines_p = p.select(F.lit(1).alias("part"), F.struct((-F.col("confidence")).alias("a"), (-F.unix_micros(F.coalesce("updated_at", F.lit(0).cast("timestamp")))).cast("double").alias("b"), F.col("id").cast("double").alias("c"), p_line.alias("line")).alias("x"))
    le = lessons.where(scope.personal(uid)).orderBy(F.desc("created_at"), F.desc("id")).limit(5)
    l_line = F.concat(F.lit("- "), cut(F.col("situation"), 100), F.lit(" | mistake: "), cut(F.col("mistake"), 120), F.lit(" -> "), cut(F.col("correction"), 150))
    lines_l = le.select(F.lit(2).alias("part"), F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).cast("double").alias("a"), F.lit(0.0).alias("b"), (-F.col("id")).cast("double").alias("c"), l_line.alias("line")).alias("x"))
    weight = F.round(F.col("importance") * F.col("confidence"), 9)
    m = memories.where((F.col("status") == "active") & scope.visible(**who)).orderBy(F.desc(weight), F.desc("updated_at"), "id").limit(15)
    tag = F.when(scope.untrusted("metadata"), f" {documents.UNTRUSTED_TAG} ({documents.UNTRUSTED_NOTE})").otherwise("")
    m_line = F.concat(F.lit("- ("), F.col("type"), F.lit(" c"), documents.two_digits(F.col("confidence")), F.lit(")"), tag, F.lit(" "), cut(F.col("content"), 200))
    lines_m = m.select(F.lit(3).alias("part"), F.struct((-weight).alias("a"), (-F.unix_micros("updated_at")).cast("double").alias("b"), F.col("id").cast("double").alias("c"), m_line.alias("line")).alias("x"))
    every = lines_p.unionByName(lines_l).unionByName(lines_m)  # at most 35 rows

    def block(part: int, title: str, empty: str | None = None) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("part") == part, F.col("x"))))
        body = F.array_join(F.transform(rows, lambda x: x["line"]), "\n")
        some = F.concat(F.lit(f"[{title}]\n"), body)
        return F.when(F.size(rows) > 0, some).otherwise(F.lit(f"[{title}]\n{empty}") if empty else F.lit(None))

    parts = F.concat_ws("\n\n", block(1, "preferences", "(none yet)"), block(2, "lessons"), block(3, "memories"))
    most = PROFILE_BUDGET - len(documents.GUIDANCE + documents.OPEN + documents.CLOSE) - 8
    whole = F.concat(F.lit(f"{documents.GUIDANCE}\n{documents.OPEN}\n"), cut(text.sanitize(F.col("t")), most), F.lit(f"\n{documents.CLOSE}"))
    return every.agg(parts.alias("t")).select(whole.alias("profile"))


def intents(rows: DataFrame) -> DataFrame:
    """Rows whose content states an intent: (id, type, content) with what is to be remembered."""
    kind, what = text.first_intent(F.col("content"))
    return rows.select("id", kind.alias("type"), what.alias("content")).where(F.length("content") >= 3)


def extract(interactions: DataFrame, memories: DataFrame, limit: int, kind: str) -> DataFrame:
    """What the latest interactions of a kind ask to remember and no memory of that type has yet."""
    latest = interactions.where(F.col("kind") == kind).orderBy(F.desc("id")).limit(max(1, min(limit, 200)))
    found = intents(latest).withColumn("norm", text.normalize(F.col("content"), compatibility=True))
    known = memories.where("status <> 'deleted'").select("type", text.normalize(F.col("content"), compatibility=True).alias("norm"))
    return found.join(known, ["type", "norm"], "left_anti").select("id", "type", "content")


def exact_matches(candidates: DataFrame, visible: DataFrame) -> DataFrame:
    """For each candidate the least visible row of its type with the same normalised content."""
    norm = F.sha2(text.normalize(F.col("content"), compatibility=True), 256)
    known = visible.select("id", "type", norm.alias("norm")).groupBy("type", "norm").agg(F.min("id").alias("existing"))
    return candidates.select("id", "type", norm.alias("norm")).join(known, ["type", "norm"]).select("id", "existing")


def learned(rows: DataFrame, dictionary: DataFrame, order: str, columns: list[str], most: int = 500) -> DataFrame:
    """Thai terms (term, pair) of the latest rows that have a counterpart and that the dictionary lacks."""
    table = {k: v[0] for k, v in thai.counterparts().items() if not k.isascii()}
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    latest = rows.orderBy(F.desc(order)).limit(most).select(F.concat_ws(" ", *columns).alias("t"))
    words = latest.select(F.explode(F.array_distinct(thai.word_tokens(F.col("t"), tuple(table)))).alias("term")).distinct()
    return words.withColumn("pair", F.try_element_at(pairs, F.col("term"))).where("pair IS NOT NULL").join(dictionary.select("term"), "term", "left_anti")


def changed(rows: DataFrame, signature: tuple[int, int]) -> bool:
    """Whether a table's count and greatest id differ from those seen last: learning is skipped where they don't."""
    got = rows.agg(F.count("*").alias("n"), F.coalesce(F.max("id"), F.lit(0)).alias("last")).first()
    return (got.n, got.last) != signature


def usage(interactions: DataFrame) -> DataFrame:
    """Rows of (kind, name, n): the ten most used tools and the five folders, from metadata that is an object."""
    rows = interactions.select(documents.metadata_field(F.col("meta"), "tool").alias("tool"), documents.metadata_field(F.col("meta"), "directory").alias("dir"))
    top = lambda c, k: rows.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(k).select(F.lit(c).alias("kind"), "name", "n")
    return top("tool", 10).unionByName(top("dir", 5))
