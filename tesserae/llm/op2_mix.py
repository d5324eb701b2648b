"""Operator 2: mixing sources to target weights by Pareto order sampling.

A source's target is its share of the budget by weight, at most `most` times its own size; what
is above goes to the other sources by weight until no target is above. A source with the target
t and the size s is taken t / s times: every document floor(t / s) times with certainty, and a
fixed-size sample for the rest. The sample is in Pareto order: a document draws u from a keyed
hash and is ranked by u / (1 - u) divided by p / (1 - p), p being its inclusion probability; the
documents of least rank are taken up to the source's remaining words. Within a source p is
proportional to the document's weight, by default log2(2 + words), so that longer documents are
likelier; those that would reach p = 1 are certain, and their excess goes to the others.

The size is held in words, so taken words differ from the target by less than the document on the
boundary. Nothing about sources or documents comes to the driver but a few sums: shares, targets
and probabilities are settled by rounds over tables. The boundary is found without gathering a
source: ranks are cut into cells for each source, about ROWS documents in each, words are summed
for each cell (combined before the shuffle), and only the cell that holds the boundary is ordered
row by row. A hot source makes more cells, not a fuller task.

A null or empty text has size 0 and takes 0 words; texts of any length are counted whole. Null
sources are one source, listed last. Rows without a doc_id draw by their text. Documents that tie
in rank are ordered by id, text hash and size, so only rows equal in all of these are taken or
left in no particular order. Reruns agree. An empty table gives an empty result. A source whose
size is 0 has the target 0. Other columns don't matter; `keep` carries them in a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import GAP, IDS_MOST, documents, materialize, release

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
SEED = "mix-1"
#: Documents in a cell of the rank, about, and the cells of a source at least.
ROWS, CELLS = 2000, 512


def words(text: Column) -> Column:
    """The number of words without building them: gaps become one mark, edges go, marks are counted."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), GAP, " ")
    n = F.length(squeezed) - F.length(F.translate(squeezed, " ", "")) + 1
    bare = F.length(F.translate(squeezed, " ", "")) == 0
    edges = squeezed.startswith(" ").cast("int") + squeezed.endswith(" ").cast("int")
    return F.when(bare, 0).otherwise(n - edges).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """The rows of (source, n) with `place`, their rank from 0 by code point, null last; only counts of ranges meet in a task."""
    parts = materialize(sources.withColumn("none", F.col("source").isNull()).repartitionByRange("none", "source").withColumn("part", F.spark_partition_id()), "sources")
    before = parts.groupBy("part").count().select("part", (F.sum("count").over(W.orderBy("part")) - F.col("count")).alias("before"))
    place = F.row_number().over(W.partitionBy("part").orderBy("none", "source")) + F.col("before") - 1
    return parts.join(F.broadcast(before), "part").select("source", "n", place.alias("place"))  # a row for each partition


def targets(sources: DataFrame, weights=WEIGHTS, share: float = 1.0, most: float = MOST) -> DataFrame:
    """`sources` (source, n, place) with `target`: shares of the budget by weight, none above `most` * n; the excess is reshared."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = materialize(sources.withColumn("weight", weight), "weighted")
    budget = share * (rows.agg(F.sum("n")).first()[0] or 0)
    level, bound = None, F.lit(most) * F.col("n") / F.col("weight")
    while True:  # those whose bound is under the level are full; the others share what is left
        full = F.lit(False) if level is None else bound < level
        got = rows.where("n > 0").agg(F.sum(F.when(full, most * F.col("n"))).alias("taken"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        following = (budget - (got.taken or 0.0)) / got.open if got.open else float("inf")
        if level is not None and following <= level:
            break
        level = following
    return rows.withColumn("target", F.when(F.col("n") > 0, F.least(F.lit(most) * F.col("n"), F.col("weight") * F.lit(level))).otherwise(0.0)).drop("weight", "place")


def _by_source(rows: DataFrame, few: DataFrame) -> DataFrame:
    """Join a row for each source to rows; it is broadcast only if the sources are counted to be few."""
    few = few.withColumnRenamed("source", "_source")
    few = F.broadcast(few) if few.count() <= IDS_MOST else few
    return rows.join(few, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def scales(sized: DataFrame, goal: DataFrame) -> DataFrame:
    """`goal` (source, n, target) with whole copies, the words that the sample takes, and the factor from weights to probabilities."""
    times = F.when(F.col("n") > 0, F.col("target") / F.col("n")).otherwise(0.0)
    goal = goal.withColumn("whole", F.floor(times + 1e-9).cast("long")).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("n")))
    goal, factor = materialize(goal.withColumn("factor", F.lit(0.0)), "goal"), F.col("factor")
    while True:
        sure = F.col("_w") * factor >= 1
        rows = _by_source(sized, goal).groupBy("source").agg(F.sum(F.when(sure, F.col("size")).otherwise(0)).alias("certain"), F.sum(F.when(~sure, F.col("_w") * F.col("size")).otherwise(0.0)).alias("open"))
        rows = rows.withColumnRenamed("source", "_source")
        step = goal.join(rows, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
        new = F.when((F.col("open") > 0) & (F.col("rest") > 0), F.greatest(factor, (F.col("rest") - F.col("certain")) / F.col("open"))).otherwise(factor)
        step = materialize(step.withColumn("to", F.coalesce(new, factor)).withColumn("moved", F.col("to") > factor * (1 + 1e-9)), "goal")
        settled = step.where("moved").isEmpty()
        release(goal)
        goal = step.select("source", "n", "target", "whole", "rest", F.col("to").alias("factor"))
        goal.written_to = step.written_to
        if settled:
            return goal


def uniform(*by: Column) -> Column:
    """A keyed draw from the open interval (0, 1)."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), *by)), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def mix(df: DataFrame, weights=WEIGHTS, share: float = 1.0, weight: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row with size, source_size, target, copies; `keep` names columns that stay, in the struct `kept`.

    `weight` is a positive Column over the columns of `df` (null counts as 1).
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("string")
    drawn = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.xxhash64("text").cast("string")))
    given = [] if weight is None else [weight.cast("double").alias("_w")]
    sized = df.select("doc_id", "source", kept.alias("kept"), words(F.col("text")).alias("size"), *given, uniform(drawn).alias("_u"), F.xxhash64("text").alias("_h"))
    sized = materialize(sized, "sized")  # words are counted once, and what follows reads a few numbers a document
    own = F.log2(F.lit(2.0) + F.col("size")) if weight is None else F.coalesce("_w", F.lit(1.0))
    sized = sized.withColumn("_w", F.greatest(own, F.lit(1e-6)))
    numbers = sized.drop("kept", "doc_id", "_u", "_h")
    sources = numbers.groupBy("source").agg(F.sum("size").alias("n"))
    goal = scales(numbers, targets(ranked(sources), weights, share))
    p = F.when(F.col("rest") > 0, F.least(F.col("_w") * F.col("factor"), F.lit(1.0))).otherwise(0.0)
    rows = _by_source(sized, goal).withColumn("_p", p)
    odds = F.when(F.col("_p") >= 1, 0.0).when(F.col("_p") <= 0, F.lit(float("inf"))).otherwise(F.col("_u") / (1 - F.col("_u")) / (F.col("_p") / (1 - F.col("_p"))))
    cells = max(CELLS, sized.count() // ROWS)
    # odds / (1 + odds) lies in [0, 1] and keeps the order; its cells are even enough for any p
    rows = rows.withColumn("_rank", odds).withColumn("_cell", F.least(F.floor(F.when(F.col("_rank") == float("inf"), 1.0).otherwise(F.col("_rank") / (1 + F.col("_rank"))) * cells), F.lit(cells - 1)).cast("long"))
    sums = rows.where("rest > 0.5").groupBy("source", "_cell").agg(F.sum("size").alias("_n"), F.first("rest").alias("_rest"))
    by = W.partitionBy("source").orderBy("_cell")
    edge = sums.withColumn("_before", F.sum("_n").over(by) - F.col("_n")).where("_before < _rest and _before + _n >= _rest")
    edge = materialize(edge.select(F.col("source").alias("_source"), F.col("_cell").alias("_edge"), "_before"), "edge")
    edge = F.broadcast(edge) if edge.count() <= IDS_MOST else edge  # at most one row for each source
    rows = rows.join(edge, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    inside = F.coalesce(F.col("_cell") == F.col("_edge"), F.lit(False))
    order = W.partitionBy("source").orderBy("_rank", "doc_id", "_h", "size").rowsBetween(W.unboundedPreceding, 0)
    edges = rows.where(inside).withColumn("_upto", F.sum("size").over(order))
    # the document on the boundary is taken if that brings the sum nearer
    edges = edges.withColumn("_take", F.col("_before") + F.col("_upto") - F.col("size") / 2 <= F.col("rest"))
    others = rows.where(~inside).withColumn("_upto", F.lit(0).cast("long")).withColumn("_take", F.coalesce(F.col("_cell") < F.col("_edge"), F.lit(False)))
    out = others.unionByName(edges)
    return out.select("doc_id", "source", "kept", "size", F.col("n").alias("source_size"), "target", (F.col("whole") + F.col("_take").cast("long")).alias("copies"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(documents(spark, sf_dir)).drop("kept")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")
