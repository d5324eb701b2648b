"""Connected components of a link table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IDS_MOST, materialize, release


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows of (node, component) for every node of a link; component: its smallest reachable node.

    Each round takes the least label among a node's neighbours and then that label's own label,
    so labels travel twice as far each round; it ends when no label changes. Rounds are written
    to the shared folder. Labels are broadcast only while they are counted to be few. A node with
    very many links is combined before the shuffle on the one side and split by the skew join on
    the other. An empty table gives an empty result.
    """
    both = links.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src <> dst")
    both = materialize(both.union(both.select("dst", "src")).distinct(), "links")
    labels = materialize(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("src")).alias("component")), "labels")
    few = labels.count() <= IDS_MOST
    while True:
        known = F.broadcast(labels) if few else labels
        near = both.join(known, both.dst == labels.node).groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        step = near.join(known, "node").select("node", "component", F.least("component", "near").alias("to"))
        own = known.select(F.col("node").alias("to"), F.col("component").alias("further"))
        step = step.join(own, "to").select("node", F.least("to", "further").alias("component"), (F.least("to", "further") < F.col("component")).alias("moved"))
        step = materialize(step, "labels")
        release(labels)
        labels = step.drop("moved")
        labels.written_to = step.written_to
        if step.where("moved").isEmpty():
            release(both)
            return labels
