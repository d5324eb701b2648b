"""Writing memories, entities and links: new tables from current ones and what is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tesserae.functions import documents, scope, text
from tesserae.schema import LINKS, MEMORY_TYPES, SCOPES, SOURCE_TYPES, STATES
from tesserae.sources.shared import durable

#: Categories of preferences.
CATEGORIES = ("work_style", "coding_pref", "language", "domain", "other")


def numbered(rows: DataFrame, order: list[str], name: str, after: DataFrame | None = None) -> DataFrame:
    """The rows with consecutive numbers from 1, or from the one after `after` (one row, one number), in an order.

    Rows are sorted by ranges; only the row counts of the ranges meet in a task.
    """
    durable(rows.sparkSession)
    rows = rows.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()).checkpoint()
    counts = rows.groupBy("part_").count()
    before = counts.select("part_", (F.sum("count").over(W.orderBy("part_")) - F.col("count")).alias("before_"))
    out = rows.join(F.broadcast(before), "part_")  # a row for each partition
    place = F.row_number().over(W.partitionBy("part_").orderBy(*order)) + F.col("before_")
    if after is None:
        return out.withColumn(name, place.cast("long")).drop("part_", "before_")
    first = after.toDF("after_")
    return out.join(F.broadcast(first)).withColumn(name, (place + F.coalesce("after_", F.lit(0))).cast("long")).drop("part_", "before_", "after_")


def scope_of(session: str = "session_id", project: str = "project_id", user: str = "user_id") -> Column:
    return F.when(F.col(session).isNotNull(), "SESSION").when(F.col(project).isNotNull(), "PROJECT").when(F.col(user).isNotNull(), "USER").otherwise("GLOBAL")


def create(memories: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """The memories and the new ones (seq, type, content and any other column), redacted, with ids and defaults."""
    new = numbered(new, ["seq"], "id", memories.agg(F.max("id")))
    half = F.lit(0.5)
    default = {"status": F.lit("active"), "source": F.lit("explicit"), "confidence": half, "importance": half, "salience": half, "access_count": F.lit(0)}
    for c in memories.columns:
        kind = memories.schema[c].dataType
        value = F.coalesce(F.col(c), default[c]) if c in new.columns and c in default else F.col(c) if c in new.columns else default.get(c, F.lit(None))
        new = new.withColumn(c, value.cast(kind))
    new = new.withColumn("content", text.redact(F.col("content"))).withColumn("scope", scope_of())
    if "summary" in memories.columns:
        new = new.withColumn("summary", text.redact(F.col("summary")))
    for c in ("created_at", "updated_at"):
        if c in memories.columns:
            new = new.withColumn(c, now)
    return memories.unionByName(new.select(*memories.columns))


def update(memories: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """`changes` (id, content, summary, importance, confidence, valid_from, valid_until, replace): nulls ask for no change.

    New content makes a new row that supersedes the old one, unless `replace`, which edits in place.
    Unknown and deleted rows, and validity that would be reversed, change nothing. One change for an id.
    """
    fields = [c for c in ("summary", "importance", "confidence", "valid_from", "valid_until") if c in changes.columns]
    asked = changes.select("id", F.struct("content", "replace", *fields).alias("new"))
    rows = memories.join(asked, "id", "left")
    value = {c: F.coalesce(F.col(f"new.{c}"), F.col(c)) if c in fields else F.col(c) for c in ("summary", "importance", "confidence", "valid_from", "valid_until") if c in memories.columns}
    reversed_ = F.coalesce(value["valid_from"] > value["valid_until"], F.lit(False)) if "valid_from" in value else F.lit(False)
    ok = F.col("new").isNotNull() & (F.col("status") != "deleted") & ~reversed_
    apart = ok & F.col("new.content").isNotNull() & ~F.coalesce(F.col("new.replace"), F.lit(False))
    rows = rows.withColumns({"ok_": ok, "apart_": apart})
    any_field = F.greatest(F.lit(0), *[F.col(f"new.{c}").isNotNull().cast("int") for c in ["content", *fields]]) == 1
    touched = F.col("ok_") & ~F.col("apart_") & any_field
    kept = rows.withColumns({c: F.when(touched, v).otherwise(F.col(c)) for c, v in value.items()})
    kept = kept.withColumn("content", F.when(touched, F.coalesce(text.redact(F.col("new.content")), F.col("content"))).otherwise(F.col("content")))
    kept = kept.withColumn("status", F.when(F.col("apart_"), "superseded").otherwise(F.col("status"))).withColumn("updated_at", F.when(touched | F.col("apart_"), now).otherwise(F.col("updated_at")))
    fresh = rows.where("apart_").withColumns({**value, "content": text.redact(F.col("new.content")), "status": F.lit("active"), "updated_at": now, "supersedes_id": F.col("id"), "seq": F.col("id")})
    fresh = numbered(fresh.drop("id"), ["seq"], "id", memories.agg(F.max("id")))
    return kept.select(*memories.columns).unionByName(fresh.select(*memories.columns))


def get_or_create(current: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """`current` and a row for each key of `wanted` (with seq) that it lacks, with ids after the greatest; null parts of keys are equal."""
    columns = [c for c in current.columns if c != "id"]
    rest = [c for c in columns if c not in key]
    first = wanted.groupBy(*key).agg(F.min_by(F.struct("seq", *rest), "seq").alias("first"))
    same = None
    for k in key:
        one = F.col(f"w.{k}").eqNullSafe(F.col(f"c.{k}"))
        same = one if same is None else same & one
    missing = first.alias("w").join(current.alias("c"), same, "left_anti").select(*key, "first.*")
    return current.unionByName(numbered(missing, ["seq"], "id", current.agg(F.max("id"))).select(*current.columns))


def resolve(memories: DataFrame, links: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`found` (candidate, id, relation): duplicates reinforce the row and delete the candidate, updates supersede the row, contradictions are linked.

    One relation for a candidate; a row that several candidates update is superseded by the least of them.
    """
    from tesserae.operators import mutate

    doubled, updated, against = (found.where(F.col("relation") == r) for r in ("duplicate", "update", "contradiction"))
    out = mutate.reinforce(memories, doubled.select("id"))
    gone = doubled.select(F.col("candidate").alias("id"), F.lit(True).alias("gone_")).distinct()
    out = out.join(gone, "id", "left").withColumn("status", F.when(F.col("gone_"), "deleted").otherwise(F.col("status"))).drop("gone_")
    out = mutate.supersede(out, updated.groupBy(F.col("id").alias("old")).agg(F.min("candidate").alias("new")))
    new = against.select(F.col("candidate").alias("source_memory_id"), F.lit("contradicts").alias("relation"), F.col("id").alias("target_memory_id"), F.lit(0.8).alias("confidence")).distinct()
    return out, upsert_links(links, new)


def upsert_links(links: DataFrame, new: DataFrame) -> DataFrame:
    """Links with the confidences of `new` where it has them."""
    key = ["source_memory_id", "relation", "target_memory_id"]
    return links.join(new.select(*key), key, "left_anti").unionByName(new.select(*links.columns))


def backfill(memories: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (type, content) that the memories don't have yet, added once; running it again adds nothing."""
    columns = rows.columns
    missing = rows.distinct().join(memories.select(*columns).distinct(), columns, "left_anti")
    return memories.unionByName(missing.select(*memories.columns))


def derive(memories: DataFrame, members: DataFrame, clusters: str = "component") -> DataFrame:
    """A row for each cluster of `members` (component, id): content, scope and its owner, trust and source ids.

    Contents are joined in the order of ids. The scope is the members' if it is one, else the narrowest;
    with several owners at that rank the cluster has no scope and no derived row.
    """
    level = F.when(F.col("scope") == "SESSION", 4).when(F.col("scope") == "USER", 3).when(F.col("scope") == "PROJECT", 2).otherwise(1)
    owner = F.when(F.col("scope") == "SESSION", F.col("session_id")).when(F.col("scope") == "USER", F.col("user_id").cast("string")).when(F.col("scope") == "PROJECT", F.col("project_id")).otherwise("")
    rows = members.join(memories, "id").withColumn("level", level).withColumn("owner", F.coalesce(owner, F.lit("")))
    top = rows.groupBy(clusters).agg(F.max("level").alias("top"), F.count("*").alias("size"), F.array_sort(F.collect_list(F.struct("id", "content"))).alias("m"), F.bool_or(scope.untrusted("metadata")).alias("untrusted"))
    owners = rows.groupBy(clusters, "level").agg(F.countDistinct("owner").alias("owners"), F.min("owner").alias("owner")).withColumnRenamed("level", "top")
    out = top.join(owners, [clusters, "top"]).where("owners = 1")
    named = F.when(F.col("top") == 4, "SESSION").when(F.col("top") == 3, "USER").when(F.col("top") == 2, "PROJECT").otherwise("GLOBAL")
    content = F.concat(F.lit("Consolidated: "), F.array_join(F.transform("m", lambda x: x["content"]), " | "))
    return out.select(clusters, "size", named.alias("scope"), F.when(F.col("top") > 1, F.col("owner")).alias("owner"), content.alias("content"), "untrusted", F.transform("m", lambda x: x["id"]).alias("derived_from"))


def _text_of(column: str, most: int) -> Column:
    return F.coalesce(F.length(column).between(1, most), F.lit(False))


def _between(column: str) -> Column:
    return F.col(column).isNull() | F.coalesce(F.col(column).between(0, 1), F.lit(False))


def _optional(column: str, most: int) -> Column:
    return F.col(column).isNull() | F.length(column).between(1, most)


def valid_memory(forced_user: bool = False) -> Column:
    """Whether a row of an import (typed columns; dates as text) is a memory."""
    ordered = ~F.coalesce(F.try_to_timestamp("valid_from") > F.try_to_timestamp("valid_until"), F.lit(False))
    tests = [
        _text_of("content", 2000), F.coalesce(F.col("type").isin(MEMORY_TYPES), F.lit(False)), F.col("summary").isNull() | (F.length("summary") <= 2000),
        F.col("source").isNull() | F.col("source").isin(SOURCE_TYPES), _between("confidence"), _between("importance"), _between("salience"),
        F.col("status").isNull() | F.col("status").isin(STATES), _optional("project_id", 200), _optional("session_id", 200), F.lit(True) if forced_user else _optional("user_ref", 200),
        F.col("valid_from").isNull() | documents.is_iso(F.col("valid_from")), F.col("valid_until").isNull() | documents.is_iso(F.col("valid_until")), ordered,
        F.col("metadata").isNull() | (F.octet_length("metadata") <= 64 * 1024),
    ]
    return _all(tests)


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return F.coalesce(out, F.lit(False))


def valid_link() -> Column:
    return _all([F.col("source_id").isNotNull(), F.col("target_id").isNotNull(), F.col("relation").isin(LINKS), _between("confidence")])


def valid_relation() -> Column:
    ordered = ~F.coalesce(F.try_to_timestamp("valid_from") > F.try_to_timestamp("valid_until"), F.lit(False))
    dates = [F.col(c).isNull() | documents.is_iso(F.col(c)) for c in ("valid_from", "valid_until")]
    return _all([F.col("source_entity_id").isNotNull(), F.col("target_entity_id").isNotNull(), _text_of("relation", 200), _between("confidence"), *dates, ordered])


def valid_entity() -> Column:
    return _all([_text_of("name", 500), _text_of("canonical_name", 500)])


def valid_user() -> Column:
    return _all([_text_of("external_id", 200), ~F.col("external_id").rlike(r"[\x00-\x1f]")])


def valid_preference() -> Column:
    return _all([F.col("category").isin(*CATEGORIES), _text_of("key", 200), _text_of("value", 2000), _between("confidence")])


def valid_lesson() -> Column:
    return _all([_text_of(c, 1000) for c in ("situation", "mistake", "correction")])


def valid_profile() -> Column:
    return _all([_text_of("section", 200), _text_of("content", 10_000)])


def import_plan(items: DataFrame, current: DataFrame) -> DataFrame:
    """The items (idx, scope, owner, type, content, good) with `verdict`: invalid, duplicate, repeated or import.

    A duplicate has the normalised content of a current row of its type that isn't deleted; of items that
    repeat in scope, owner, type and content the first is taken.
    """
    norm = lambda c: F.sha2(text.normalize(F.col(c), compatibility=True), 256)
    known = current.where("status <> 'deleted'").select("type", norm("content").alias("norm")).distinct().withColumn("known", F.lit(True))
    rows = items.withColumn("norm", norm("content")).join(known, ["type", "norm"], "left")
    fresh = F.col("good") & F.col("known").isNull()
    first = rows.where(fresh).groupBy("scope", "owner", "type", F.sha2(F.lower(F.trim("content")), 256).alias("same")).agg(F.min("idx").alias("idx")).select("idx", F.lit(True).alias("first"))
    rows = rows.join(first, "idx", "left")
    return rows.withColumn("verdict", F.when(~F.col("good"), "invalid").when(F.col("known"), "duplicate").when(F.col("first"), "import").otherwise("repeated")).drop("norm", "known", "first")


def import_links(links: DataFrame, planned: DataFrame, ids: DataFrame) -> DataFrame:
    """Links whose two ends are imported and may be linked, with their new ids. `planned`: (old, scope, user_id, session_id, project_id); `ids`: (old, id)."""
    a, b = (planned.alias(x) for x in ("a", "b"))
    ok = links.where(valid_link()).join(a, F.col("source_id") == F.col("a.old")).join(b, F.col("target_id") == F.col("b.old")).where(scope.may_link("a", "b")).select("source_id", "relation", "target_id")
    ids_a, ids_b = ids.select(F.col("old").alias("source_id"), F.col("id").alias("source_memory_id")), ids.select(F.col("old").alias("target_id"), F.col("id").alias("target_memory_id"))
    return ok.join(ids_a, "source_id").join(ids_b, "target_id").select("source_memory_id", "relation", "target_memory_id")


def import_relations(relations: DataFrame, batch: DataFrame, known: DataFrame, memories: DataFrame) -> DataFrame:
    """Valid relations whose entities are in the batch (old, id) or known already (id); a memory that isn't imported becomes null."""
    ids = known.select(F.col("id").alias("old"), "id").join(batch.select("old"), "old", "left_anti").unionByName(batch.select("old", "id"))
    out = relations.where(valid_relation())
    for side in ("source_entity_id", "target_entity_id"):
        out = out.join(ids.select(F.col("old").alias(side), F.col("id").alias(f"new_{side}")), side)
    out = out.join(memories.select(F.col("old").alias("source_memory_id"), F.col("id").alias("new_memory_id")), "source_memory_id", "left")
    return out.select("new_source_entity_id", "relation", "new_target_entity_id", "new_memory_id")
