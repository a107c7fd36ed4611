"""Connected components of a graph of links, as joins that halve distances, with checkpoints between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedspread.llm.session import checkpointed


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node that is reachable) of the nodes in ``links`` (a, b: long, either direction).

    Each round gives a node the least label of its neighbours and then the label of that label. Rounds grow with the
    logarithm of the longest shortest path. Nulls and loops are dropped; repeated links do not matter."""
    pairs = links.where("a <> b").select("a", "b")
    both = checkpointed(pairs.union(pairs.select("b", "a")).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label")))
    while True:
        reached = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        best = both.join(reached, "b").groupBy("a").agg(F.min("near").alias("near"))
        hop = labels.join(best, labels["node"] == best["a"]).select("node", "label", F.least("label", "near").alias("low"))
        target = labels.select(F.col("node").alias("low"), F.col("label").alias("jump"))
        step = checkpointed(hop.join(target, "low").select("node", F.col("label").alias("old"), F.least("low", "jump").alias("label")))
        labels = step.select("node", "label")
        if step.where("old <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")
