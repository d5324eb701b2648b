"""Graph and time: traversal, provenance, chains, components, co-occurrence, validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tesserae.sources.shared import durable, written


def traverse(links: DataFrame, starts: DataFrame, depth: int = 2, relations: list[str] | None = None, first_relation: bool = False) -> DataFrame:
    """Rows of (id, depth) of the nodes first met at 1..depth along outgoing links; at most five steps.

    With `first_relation` also the least relation by which a node was met first. Fronts are written out, so no step is walked twice.
    """
    if relations:
        links = links.where(F.col("relation").isin(relations))
    edges = links.select(F.col("source_memory_id").alias("id"), F.col("target_memory_id").alias("to"), "relation")
    seen = starts.select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("relation")).distinct()
    front = seen
    for step in range(1, max(1, min(depth, 5)) + 1):
        met = front.select("id").join(edges, "id").groupBy(F.col("to").alias("id")).agg(F.min("relation").alias("relation"))
        front = written(met.join(seen.select("id"), "id", "left_anti").select("id", F.lit(step).alias("depth"), "relation"), "front")
        seen = seen.unionByName(front)
    return seen.where("depth > 0").select("id", "depth", *(["relation"] if first_relation else []))


def chain(rows: DataFrame, start: int) -> DataFrame:
    """The supersession chain through a row, oldest first: (id, position). `rows`: (id, supersedes_id).

    Steps are doubled each round, until a round meets no new id; a chain that comes back to itself ends there.
    """
    spark = rows.sparkSession
    durable(spark)
    rows = rows.where("supersedes_id IS NOT NULL")
    back = rows.select(F.lit(-1).alias("way"), "id", F.col("supersedes_id").alias("to"))
    forth = rows.groupBy(F.col("supersedes_id").alias("at")).agg(F.min("id").alias("to")).select(F.lit(1), "at", "to")
    jump = back.union(forth).distinct().checkpoint()
    seen = spark.createDataFrame([(way, int(start), 0) for way in (-1, 1)], "way int, id long, far long")
    length = 1
    while True:
        met = seen.join(jump, ["way", "id"]).groupBy("way", F.col("to").alias("id")).agg((F.min("far") + length).alias("far"))
        new = met.join(seen.select("way", "id"), ["way", "id"], "left_anti").checkpoint()
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
        after = jump.select("way", F.col("id").alias("to"), F.col("to").alias("_to"))
        jump = jump.join(after, ["way", "to"]).select("way", "id", F.col("_to").alias("to")).distinct().checkpoint()
        length *= 2
    both_ways = seen.groupBy("id").agg(F.min(F.col("way") * F.col("far")).alias("step"))
    return both_ways.select("id", F.row_number().over(W.orderBy("step", "id")).alias("position"))


def components(links: DataFrame) -> DataFrame:
    """Rows of (id, component) for links (a, b) by minimum labels, until no label changes.

    A node takes the least label near it, so does the node that its label names, and labels jump to their own labels.
    """
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("n"))
        met = labels.join(near, "id")
        hooked = met.select(F.col("component").alias("id"), F.lit(None).cast("long").alias("component"), F.col("n").alias("to"))
        step = met.select("id", "component", F.least("component", "n").alias("to")).union(hooked)
        step = step.groupBy("id").agg(F.max("component").alias("component"), F.min("to").alias("to"))
        further = labels.select(F.col("id").alias("to"), F.col("component").alias("further"))
        step = step.join(further, "to").select("id", F.least("to", "further").alias("component"), (F.least("to", "further") < F.col("component")).alias("moved"))
        step = written(step, "labels")
        labels = step.drop("moved")
        if step.where("moved").isEmpty():
            return labels


def co_occurring(found: DataFrame) -> DataFrame:
    """Rows of (source, target, n): entities in one row's list, in the order of the list."""
    flat = found.select("id", F.posexplode("entities").alias("i", "e"))
    pairs = flat.alias("x").join(flat.alias("y"), (F.col("x.id") == F.col("y.id")) & (F.col("x.i") < F.col("y.i")))
    return pairs.groupBy(F.col("x.e").alias("source"), F.col("y.e").alias("target")).agg(F.count("*").alias("n"))


def shared(found: DataFrame) -> DataFrame:
    """Rows of (source, target): members (component, id, entities) of one cluster that share an entity."""
    flat = found.select("component", "id", F.explode("entities").alias("e")).distinct()
    pairs = flat.alias("x").join(flat.alias("y"), (F.col("x.component") == F.col("y.component")) & (F.col("x.e") == F.col("y.e")) & (F.col("x.id") < F.col("y.id")))
    return pairs.select(F.col("x.id").alias("source"), F.col("y.id").alias("target")).distinct()


def changes(rows: DataFrame, start: Column, end: Column, limit: int = 100) -> DataFrame:
    return rows.where(F.col("updated_at").between(start, end)).orderBy(F.desc("updated_at"), "id").limit(limit)


def derived_scope(members: DataFrame, key: str) -> DataFrame:
    """The scope of what is derived from groups: unanimous, else the narrowest; several owners give no scope id."""
    rank = F.when(F.col("scope") == "SESSION", 4).when(F.col("scope") == "USER", 3).when(F.col("scope") == "PROJECT", 2).otherwise(1)
    owner = F.coalesce("session_id", F.col("user_id").cast("string"), "project_id", F.lit(""))
    ranks = members.withColumn("_r", rank).withColumn("_o", owner).groupBy(key, "_r").agg(F.first("scope").alias("scope"), F.countDistinct("_o").alias("owners"), F.min("_o").alias("owner"))
    top = ranks.groupBy(key).agg(F.max_by(F.struct("scope", "owners", "owner"), "_r").alias("top"))
    return top.select(key, "top.scope", F.when(F.col("top.owners") == 1, F.col("top.owner")).alias("owner"))
