"""Changes as dataflow: the current table and a change set give the next table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tesserae.functions import scope


def remember(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Upsert by (category, key): new ones at confidence 0.5, known ones with the new value and 0.1 more."""
    key = ["category", "key"]
    rows = current.join(changes.select(*key, F.col("value").alias("new_value")), key, "full_outer")
    changed = F.col("new_value").isNotNull()
    sure = F.when(F.col("confidence").isNull(), 0.5).when(changed, F.least(F.col("confidence") + 0.1, F.lit(1.0))).otherwise(F.col("confidence"))
    return rows.select(*key, F.coalesce("new_value", "value").alias("value"), F.round(sure, 6).alias("confidence"))


def supersede(memories: DataFrame, pairs: DataFrame) -> DataFrame:
    """`pairs` (old, new): old rows become superseded, new ones active with `supersedes_id`."""
    old = pairs.select(F.col("old").alias("id"), F.lit(True).alias("_old")).distinct()
    new = pairs.groupBy(F.col("new").alias("id")).agg(F.min("old").alias("_from"))
    rows = memories.join(old, "id", "left").join(new, "id", "left")
    status = F.when(F.col("_old"), "superseded").when(F.col("_from").isNotNull(), "active").otherwise(F.col("status"))
    return rows.withColumn("status", status).withColumn("supersedes_id", F.coalesce("_from", "supersedes_id")).drop("_old", "_from")


def merge(memories: DataFrame, pairs: DataFrame) -> DataFrame:
    """`pairs` (source, target): the source is superseded by the target, whose metadata lists it under `merged_from`.

    Pairs of deleted rows, of a row with itself and of rows that may not be linked change nothing.
    """
    from tesserae.functions import documents

    side = memories.select("id", "status", "scope", "user_id", "session_id", "project_id").where("status <> 'deleted'")
    ok = pairs.where("source <> target").join(side.alias("a"), F.col("source") == F.col("a.id")).join(side.alias("b"), F.col("target") == F.col("b.id")).where(scope.may_link("a", "b")).select("source", "target")
    taken = ok.groupBy(F.col("target").alias("id")).agg(F.array_sort(F.collect_set("source")).alias("_sources"))
    out = supersede(memories, ok.select(F.col("source").alias("old"), F.col("target").alias("new"))).join(taken, "id", "left")
    merged = documents.merged_from(F.col("metadata"), F.coalesce("_sources", F.array().cast("array<bigint>")))
    return out.withColumn("metadata", F.when(F.col("_sources").isNotNull(), merged).otherwise(F.col("metadata"))).drop("_sources")


def transition(memories: DataFrame, moves: DataFrame) -> DataFrame:
    """`moves` (id, to): statuses change where the move is allowed; `moved` tells."""
    rows = memories.join(moves, "id", "left")
    ok = F.coalesce(scope.may_move(F.col("status"), F.col("to")), F.lit(False))
    return rows.withColumn("moved", ok).withColumn("status", F.when(ok, F.col("to")).otherwise(F.col("status"))).drop("to")


def set_status(memories: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """`changes` (id, status): the status is set without asking whether the move is allowed."""
    rows = memories.join(changes.select("id", F.col("status").alias("_to")), "id", "left")
    return rows.withColumn("updated_at", F.when(F.col("_to").isNotNull(), now).otherwise(F.col("updated_at"))).withColumn("status", F.coalesce("_to", "status")).drop("_to")


def retained(rows: DataFrame, day: str, today: Column, days: int = 30) -> DataFrame:
    """Rows of the last days; with a table partitioned by day, older folders aren't read."""
    return rows.where(F.col(day) >= F.date_sub(today, days))


def reinforce(memories: DataFrame, ids: DataFrame) -> DataFrame:
    hit = memories.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    can = F.col("_hit") & F.col("status").isin("active", "reinforced", "stale", "superseded")
    sure = F.when(can, F.least(F.col("confidence") + 0.05, F.lit(1.0))).otherwise(F.col("confidence"))
    return hit.withColumn("confidence", F.round(sure, 6)).withColumn("status", F.when(can, "active").otherwise(F.col("status"))).drop("_hit")


def insert_missing(current: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Insert or ignore by key; null parts of a key are equal."""
    first = new.withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy(*[c for c in new.columns]))).where("_k = 1").drop("_k")
    on = [F.col(f"n.{k}").eqNullSafe(F.col(f"c.{k}")) for k in key]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return current.unionByName(first.alias("n").join(current.alias("c"), cond, "left_anti"))


def forget(memories: DataFrame, links: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete memories; their links go, and references to them become null."""
    gone = ids.select("id").distinct()
    left = memories.join(gone, "id", "left_anti")
    ref = gone.select(F.col("id").alias("supersedes_id"), F.lit(True).alias("_gone"))
    left = left.join(ref, "supersedes_id", "left").withColumn("supersedes_id", F.when(F.col("_gone"), None).otherwise(F.col("supersedes_id"))).drop("_gone")
    kept = links
    for side in ("source_memory_id", "target_memory_id"):
        kept = kept.join(gone.withColumnRenamed("id", side), side, "left_anti")
    return left, kept


def scrub(rows: DataFrame, columns: list[str], redact) -> tuple[DataFrame, Column]:
    """Redacted columns, and the expression that counts changed rows."""
    changed = F.lit(False)
    for c in columns:
        rows = rows.withColumn(f"_{c}", F.col(c)).withColumn(c, redact(F.col(c)))
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows, F.count_if(changed)


def verdicts(rows: DataFrame) -> DataFrame:
    """Validate imported memories: `reason` is null for a good row."""
    from tesserae.schema import MEMORY_TYPES, SCOPES

    reason = (
        F.when(F.col("content").isNull() | (F.length(F.trim("content")) == 0), "content missing").when(F.length("content") > 2000, "content too long")
        .when(~F.coalesce(F.col("type").isin(MEMORY_TYPES), F.lit(False)), "unknown type").when(~F.coalesce(F.col("scope").isin(SCOPES), F.lit(False)), "unknown scope")
        .when((F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence out of range").when(F.col("valid_from") > F.col("valid_until"), "validity reversed")
    )
    return rows.withColumn("reason", reason)
