"""Connected components of a table of links, without links or labels on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import counted, drop, join_counted, materialize


def components(links: DataFrame) -> DataFrame:
    """links (a, b) → node, label: the least node that a node is linked with, directly or over others.

    Each round takes the least label among neighbours and then the label's own label, so that chains
    halve; it ends when nothing changed. Self links, repeated links and an empty table are fine.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null").distinct()
    both = materialize(both, "links", "fewer")
    # n: how many links a node has, so that the rows of a hub are not joined in one task
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label"), F.count(F.lit(1)).alias("n")), "labels", "fewer")
    size = counted(labels)
    while True:
        there = labels.select(F.col("node").alias("b"), F.col("label").alias("there"), "n")
        best = join_counted(both, there, "b", size=size).groupBy(F.col("a").alias("node")).agg(F.min("there").alias("best"))
        near = materialize(labels.join(best, "node").select("node", "n", F.col("label").alias("old"), F.least("label", "best").alias("label")), "near", "fewer")
        if not near.where("old <> label").limit(1).count():
            for x in (both, near):
                drop(x)
            return labels.select("node", "label")
        # labels that have a lesser label themselves, and how many nodes have them
        up = labels.where("label < node").select(F.col("node").alias("label"), F.col("label").alias("up"))
        used = materialize(near.groupBy("label").agg(F.count(F.lit(1)).alias("m")).join(up, "label"), "up", "fewer")
        new = join_counted(near, used, "label", n="m", how="left")
        new = materialize(new.select("node", F.least("label", F.coalesce("up", "label")).alias("label"), "n"), "labels", "fewer")
        for x in (labels, near, used):
            drop(x)
        labels = new
