"""What an export holds: rows that its caller may see, and what they refer to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import scope


def memories(rows: DataFrame, users: DataFrame, **who) -> DataFrame:
    """Visible memories that aren't deleted, with the outer name of their user."""
    owners = users.select(F.col("id").alias("user_id"), F.col("external_id").alias("user_ref"))
    return rows.where((F.col("status") != "deleted") & scope.visible(**who)).join(owners, "user_id", "left")


def links(rows: DataFrame, exported: DataFrame) -> DataFrame:
    """Links of which both ends are exported."""
    for side in ("source_memory_id", "target_memory_id"):
        rows = rows.join(exported.select(F.col("id").alias(side)), side, "left_semi")
    return rows


def relations(rows: DataFrame, exported: DataFrame) -> DataFrame:
    """Relations without a source memory, or with an exported one."""
    seen = exported.select(F.col("id").alias("source_memory_id"), F.lit(True).alias("seen"))
    return rows.join(seen, "source_memory_id", "left").where("source_memory_id IS NULL OR seen").drop("seen")


def entities(rows: DataFrame, exported_relations: DataFrame) -> DataFrame:
    """Entities that an exported relation names."""
    used = exported_relations.select(F.col("source_entity_id").alias("id")).union(exported_relations.select("target_entity_id")).distinct()
    return rows.join(used, "id", "left_semi")


def users(rows: DataFrame, personal: list[DataFrame], uid: int) -> DataFrame:
    """The caller, and the owners of the personal rows that the caller may see."""
    ids = rows.where(F.col("id") == uid).select("id")
    for p in personal:
        ids = ids.union(p.where((F.col("user_id") == uid)).select(F.col("user_id").alias("id")))
    return rows.join(ids.distinct(), "id", "left_semi")
