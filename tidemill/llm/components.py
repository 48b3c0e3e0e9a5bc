"""Connected components over an edge table, by least labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import saved


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a long, b long) -> (node, component), component the least node reachable.

    Each round takes the least label among the neighbours, then the label of
    that label.  Every state is written to the shared folder, so a lost
    executor costs one round at most.  An empty table gives an empty table.
    """
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    both = saved(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = saved(labels.join(near, labels.node == near.a).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")), "step")
        jump = step.select(F.col("node").alias("k"), F.col("label").alias("further"))
        labels = saved(step.join(jump, step.label == jump.k, "left").select("node", "was", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        if labels.where("label <> was").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        labels = labels.select("node", "label")
    raise RuntimeError("components did not settle")
