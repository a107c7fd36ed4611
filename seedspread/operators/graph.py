"""Degrees, statistics, components and PageRank of a graph (src, dst, p)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedspread.operators.paths import vertices
from seedspread.session import checkpointed


def degrees(edges: DataFrame) -> DataFrame:
    """vid, degree, weighted: out-edges and the sum of their probabilities."""
    own = edges.groupBy(F.col("src").alias("vid")).agg(F.count(F.lit(1)).alias("degree"), F.sum("p").alias("weighted"))
    return vertices(edges).join(own, "vid", "left").select("vid", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"), F.coalesce("weighted", F.lit(0.0)).alias("weighted"))


def components(edges: DataFrame) -> DataFrame:
    """vid, component: the least vertex that edges, in either direction, connect. Labels jump, so rounds are few."""
    both = checkpointed(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("vid")).agg(F.min("b").alias("label")).select("vid", F.least("vid", "label").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("vid", "b"), "b").groupBy(F.col("a").alias("vid")).agg(F.min("label").alias("near"))
        low = labels.join(near, "vid").select("vid", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("vid").alias("low"), F.col("label").alias("jump"))
        step = checkpointed(low.join(jump, "low").select("vid", F.col("label").alias("old"), F.least("low", "jump").alias("label")))
        labels = step.select("vid", "label")
        if step.where("old <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")


def statistics(edges: DataFrame) -> DataFrame:
    """One row: vertices, edges, density, mean and largest degree, components, largest and mean component."""
    degree = degrees(edges).agg(F.count(F.lit(1)).alias("n"), F.sum("degree").cast("long").alias("m"), F.avg("degree").alias("mean_degree"), F.max("degree").alias("max_degree"))
    size = components(edges).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    parts = size.agg(F.count(F.lit(1)).alias("components"), F.max("size").alias("largest_component"), F.avg("size").alias("mean_component"))
    return degree.join(F.broadcast(parts)).withColumn("density", F.col("m") / F.col("n") / (F.col("n") - 1))  # one row beside one row


def pagerank(edges: DataFrame, restart: float = 0.15, tolerance: float = 1e-3, rounds: int = 10_000) -> DataFrame:
    """vid, rank: restart + (1 - restart) x what the edges' targets pass back in proportion to p; sinks' rank is lost.

    Stops when the ranks' changes sum up to at most ``tolerance``, or after ``rounds``. Nothing is broadcast: a table of ranks small enough
    for that would pass through the driver in every round."""
    shares = edges.join(edges.groupBy("dst").agg(F.sum("p").alias("all")).hint("merge"), "dst").select("src", "dst", (F.col("p") / F.col("all")).alias("share"))
    shares = checkpointed(shares)
    ranks = checkpointed(vertices(edges).withColumn("rank", F.lit(1.0)))
    for _ in range(rounds):
        passed = shares.join(ranks.withColumnRenamed("vid", "dst").hint("merge"), "dst").select(F.col("src").alias("vid"), (F.col("rank") * F.col("share")).alias("got"), F.lit(0.0).alias("old"))
        both = passed.unionByName(ranks.select("vid", F.lit(0.0).alias("got"), F.col("rank").alias("old")))  # each vertex's old rank once
        step = checkpointed(both.groupBy("vid").agg(F.max("old").alias("old"), (restart + (1 - restart) * F.sum("got")).alias("rank")))
        ranks = step.select("vid", "rank")
        if (step.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0) <= tolerance:
            break
    return ranks
