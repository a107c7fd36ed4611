"""Bounded closures of maximum-probability paths, the base of all tree operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedspread.session import BROADCAST_ROWS, checkpointed, small_side


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "p")


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("vid")).union(edges.select("dst")).distinct()


def closure(
    edges: DataFrame,
    theta: float | Column,
    sources: DataFrame | None = None,
    inclusive: bool = False,
    avoid: list[int] | None = None,
    stop: list[int] | None = None,
    barred: DataFrame | None = None,
    by: tuple[str, ...] = (),
    routes: bool = False,
) -> DataFrame:
    """s, v, p, hops, parent, edge_p: the best path from each source to each vertex it reaches with p > theta.

    ``inclusive``: p >= theta. ``avoid``: vertices that no path enters. ``stop``: vertices that paths enter but don't leave.
    ``barred``: rows of ``by``, s, v, or some of these columns, that paths don't enter. Of equally good paths the one with
    fewest hops counts, then the one with the least parent.

    ``by``: columns of ``sources`` that tell searches apart which run side by side; edges that have some of them hold for those
    only, and ``theta`` may be an expression over them. ``routes``: also verts (array, from s to v) and probs (of its edges).

    A hop extends only what the hop before made better, and adds its finds to those of earlier hops, which are never written again; what
    is known is broadcast while it is small, else only finds are compared with it."""
    shared = [c for c in by if c in edges.columns]
    edges = checkpointed(edges.where("p > 0").select(*shared, "src", "dst", F.col("p").alias("edge_p")))
    if sources is None:
        sources = edges.select(F.col("src").alias("vid")).union(edges.select("dst")).distinct()
    edges = small_side(edges)
    key, route = [*by, "s", "v"], ["verts", "probs"] if routes else []
    values = ["p", "hops", "parent", "edge_p", *route]
    start = sources.select(*by, F.col("vid").alias("s"), F.col("vid").alias("v"), F.lit(1.0).alias("p"), F.lit(0).alias("hops"), F.col("vid").alias("parent"), F.lit(1.0).alias("edge_p"))
    if routes:
        start = start.withColumns({"verts": F.array("s"), "probs": F.array().cast("array<double>")})
    frontier = checkpointed(start.distinct())
    known, rows, hops = [frontier], frontier.count(), 0
    good = (lambda p: p >= theta) if inclusive else (lambda p: p > theta)
    while True:
        hops += 1
        leaving = frontier.where(~(F.col("v").isin(stop) & (F.col("s") != F.col("v")))) if stop else frontier
        step = leaving.select(*by, "s", F.col("v").alias("src"), F.col("p").alias("so_far"), *route).join(edges, [*shared, "src"])
        step = step.withColumn("new", F.col("so_far") * F.col("edge_p")).where(good(F.col("new")) & (F.col("dst") != F.col("s")))
        if avoid:
            step = step.where(~F.col("dst").isin(avoid))
        step = step.withColumnRenamed("dst", "v")
        if barred is not None:
            step = step.join(barred, [c for c in key if c in barred.columns], "left_anti")
        best = step.groupBy(*key).agg(F.min(F.struct((-F.col("new")).alias("minus"), "src", "edge_p", *route)).alias("b"))
        found = {"p": -F.col("b.minus"), "hops": F.lit(hops), "parent": F.col("b.src"), "edge_p": F.col("b.edge_p")}
        if routes:
            found |= {"verts": F.concat("b.verts", F.array("v")), "probs": F.concat("b.probs", F.array("b.edge_p"))}
        best = best.select(*key, *[c.alias(n) for n, c in found.items()])
        old = reduce(DataFrame.unionByName, [d.select(*key, F.col("p").alias("had")) for d in known])
        if rows > BROADCAST_ROWS:
            best = checkpointed(best)
            old = old.join(small_side(best.select(*key)), key, "left_semi")
        old = old.select(*[F.col(c).alias(f"old_{c}") for c in key], "had")
        as_good = [F.col(c) == F.col(f"old_{c}") for c in key] + [F.col("had") >= F.col("p")]
        frontier = checkpointed(best.join(small_side(old, rows), reduce(Column.__and__, as_good), "left_anti"))
        n = frontier.count()
        if not n:
            break
        known.append(frontier)
        rows += n
    if len(known) <= 2:  # no path of one edge is better than another
        return reduce(DataFrame.unionByName, known)
    whole = reduce(DataFrame.unionByName, known).groupBy(*key).agg(F.max(F.struct("p", *values[1:])).alias("b"))
    return checkpointed(whole.select(*key, *[F.col(f"b.{c}").alias(c) for c in values]))
