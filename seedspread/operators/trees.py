"""Activation probabilities on in-trees: the closure of reversed edges, whose sources are the trees' roots."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedspread.session import checkpointed, small_side


#: Rows up to which a tree is evaluated in one group of an Arrow batch; larger ones are evaluated level by level, as joins.
TREE_ROWS = 200_000


def activation(trees: DataFrame, seeds: list[int] | Column, compat_root: bool = False, tree_rows: int = TREE_ROWS) -> DataFrame:
    """s (root), v, ap, alpha: activation probability, and the root's linear dependence on it.

    ap: 1 for seeds, 0 for other leaves, else 1 - prod(1 - ap(c) p(c)) over children c. alpha: 1 for the root, else
    alpha(parent) p prod(1 - ap(y) p(y)) over the siblings y; 0 below seeds. ``seeds`` may be a condition on the trees' rows.
    ``compat_root``: multiplies a root's ap with children by (1 - ap) once more, and derives the alpha of its children from that:
    p (1 - ap(root)) / (1 - ap p). A tree of up to ``tree_rows`` vertices is one group."""
    if isinstance(seeds, list) and not seeds:
        return trees.select("s", "v", F.lit(0.0).alias("ap"), F.col("p").alias("alpha"))
    is_seed = F.col("v").isin(seeds) if isinstance(seeds, list) else seeds
    trees = trees.select("s", "v", "hops", "parent", "edge_p", is_seed.alias("is_seed"))
    large = checkpointed(trees.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tree_rows).select("s"))
    if large.isEmpty():
        return _by_tree(trees, compat_root)
    large = small_side(large)
    return _by_tree(trees.join(large, "s", "left_anti"), compat_root).unionByName(_by_levels(checkpointed(trees.join(large, "s", "left_semi")), compat_root))


def _by_tree(trees: DataFrame, compat_root: bool) -> DataFrame:
    def evaluated(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["hops", "v"], ignore_index=True)
        v, q, seed = rows["v"].to_numpy(), rows["edge_p"].to_numpy(), rows["is_seed"].to_numpy()
        by_id = np.argsort(v)
        parent = by_id[np.searchsorted(v, rows["parent"].to_numpy(), sorter=by_id)]
        hops = rows["hops"].to_numpy()
        starts = np.searchsorted(hops, np.arange(hops[-1] + 2))
        levels = [slice(x, y) for x, y in zip(starts[:-1], starts[1:], strict=True)]
        ap, alpha, factor = np.zeros(len(v)), np.ones(len(v)), np.ones(len(v))
        rest, zeros = np.ones(len(v)), np.zeros(len(v), int)  # of a vertex's children: product of factors other than 0, number of 0
        for at in reversed(levels):
            ap[at] = 1 - np.where(zeros[at] > 0, 0.0, rest[at])
            if compat_root and at.start == 0:
                ap[at] *= 1 - ap[at]
            ap[at][seed[at]] = 1.0
            if at.start:
                factor[at] = 1 - ap[at] * q[at]
                np.multiply.at(rest, parent[at], np.where(factor[at] != 0, factor[at], 1.0))
                np.add.at(zeros, parent[at], factor[at] == 0)
        for at in levels[1:]:
            up, free = parent[at], factor[at] != 0
            apart = np.where(zeros[up] - ~free == 0, rest[up] / np.where(free, factor[at], 1.0), 0.0)
            if compat_root and at is levels[1]:
                apart = np.where(free, (1 - ap[0]) / np.where(free, factor[at], 1.0), apart)
            alpha[at] = np.where(seed[up], 0.0, alpha[up]) * q[at] * apart
        return pd.DataFrame({"s": rows["s"], "v": v, "ap": ap, "alpha": alpha})

    return trees.groupBy("s").applyInPandas(evaluated, "s long, v long, ap double, alpha double")


def _by_levels(trees: DataFrame, compat_root: bool) -> DataFrame:
    """One level of all trees at a time: from the leaves for ap, from the roots for alpha."""
    is_seed = F.col("is_seed")
    depth = trees.agg(F.max("hops")).first()[0]
    levels: list[DataFrame] = []
    below: DataFrame | None = None
    for d in range(depth, -1, -1):
        level = trees.where(F.col("hops") == d).select("s", "v", "parent", "edge_p", "is_seed")
        if below is None:
            level = level.withColumn("grown", F.lit(None).cast("double"))
        else:
            grown = below.groupBy("s", F.col("parent").alias("v")).agg((1 - F.product(1 - F.col("ap") * F.col("edge_p"))).alias("grown"))
            level = level.join(grown, ["s", "v"], "left")
        ap = F.coalesce("grown", F.lit(0.0))
        if compat_root and d == 0:
            ap = ap * (1 - ap)
        level = level.withColumn("ap", F.when(is_seed, F.lit(1.0)).otherwise(ap)).drop("grown")
        below = checkpointed(level)
        levels.append(below)
    above = levels.pop().select("s", "v", "ap", "is_seed", F.lit(1.0).alias("alpha"))
    done = [above]
    while levels:
        level = levels.pop()
        factor = 1 - F.col("ap") * F.col("edge_p")
        siblings = level.groupBy("s", "parent").agg(F.product(F.when(factor != 0, factor).otherwise(1.0)).alias("rest"), F.sum((factor == 0).cast("int")).alias("zeros"))
        over = above.select("s", F.col("v").alias("parent"), F.when(is_seed, F.lit(0.0)).otherwise(F.col("alpha")).alias("over"))
        apart = F.when(factor != 0, F.when(F.col("zeros") == 0, F.col("rest") / factor).otherwise(0.0)).otherwise(F.when(F.col("zeros") == 1, F.col("rest")).otherwise(0.0))
        if compat_root and len(done) == 1:
            over = over.join(above.select("s", F.col("ap").alias("root_ap")), "s")
            apart = F.when(factor != 0, (1 - F.col("root_ap")) / factor).otherwise(apart)
        above = checkpointed(level.join(siblings, ["s", "parent"]).join(over, ["s", "parent"]).select("s", "v", "ap", "is_seed", (F.col("over") * F.col("edge_p") * apart).alias("alpha")))
        done.append(above)
    return reduce(DataFrame.unionByName, done).drop("is_seed")


def seed_counts(trees: DataFrame, seeds: list[int]) -> DataFrame:
    """s, n: how many of the seeds each root's tree holds."""
    return trees.groupBy("s").agg(F.sum(F.col("v").isin(seeds).cast("long")).alias("n"))


def gains(state: DataFrame) -> DataFrame:
    """vid, gain: what each vertex adds over all roots, sum of alpha (1 - ap)."""
    return state.groupBy(F.col("v").alias("vid")).agg(F.sum(F.col("alpha") * (1 - F.col("ap"))).alias("gain"))


def rerouted(back: DataFrame, theta: float, stay: DataFrame, lost: DataFrame) -> DataFrame:
    """New best paths to ``lost`` (s, v) in trees of which ``stay`` is left, in the columns of ``stay``; those without one are not returned.

    ``back``: reversed edges. ``stay``: s, v, p, hops, parent, edge_p, verts (the path from s to v) and seed, beyond which no path goes. Only lost
    vertices and their neighbours are looked at, by rising number of edges, so that ties go as in ``paths.closure``."""
    back = back.where("p > 0").select("src", "dst", F.col("p").alias("q"))
    key, columns = ["s", "v"], ["p", "hops", "parent", "edge_p", "verts"]

    def onward(rows: DataFrame, ends: DataFrame) -> DataFrame:
        step = rows.where("not seed").select("s", F.col("v").alias("src"), F.col("p").alias("so_far"), "hops", "verts").join(ends, ["s", "src"])
        found = {"p": F.col("so_far") * F.col("q"), "hops": F.col("hops") + 1, "parent": F.col("src"), "edge_p": F.col("q"), "verts": F.concat("verts", F.array("v"))}
        return step.select(*key, *[c.alias(n) for n, c in found.items()]).where(F.col("p") > theta)

    ends = checkpointed(lost.join(back.withColumnRenamed("dst", "v"), "v"))  # s, v, src, q
    entry = checkpointed(onward(stay, ends))
    starts = {r.hops for r in entry.select("hops").distinct().collect()}  # at most the depth of a tree
    known: list[DataFrame] = []
    frontier, hops = None, 0
    while starts or frontier is not None:
        hops = hops + 1 if frontier is not None else min(starts)
        step = [entry.where(F.col("hops") == hops)] if hops in starts else []
        starts.discard(hops)
        if frontier is not None:
            step.append(onward(frontier, ends))
        best = reduce(DataFrame.unionByName, step).groupBy(*key).agg(F.min(F.struct((-F.col("p")).alias("minus"), "parent", "edge_p", "verts")).alias("b"))
        best = best.select(*key, (-F.col("b.minus")).alias("p"), F.lit(hops).alias("hops"), "b.parent", "b.edge_p", "b.verts", F.lit(False).alias("seed"))
        if known:
            had = reduce(DataFrame.unionByName, [d.select(F.col("s").alias("_s"), F.col("v").alias("_v"), F.col("p").alias("had")) for d in known])
            best = best.join(had, (F.col("s") == F.col("_s")) & (F.col("v") == F.col("_v")) & (F.col("had") >= F.col("p")), "left_anti")
        best = checkpointed(best)
        frontier = None if best.isEmpty() else best
        if frontier is not None:
            known.append(frontier)
    if not known:
        return stay.limit(0)
    whole = reduce(DataFrame.unionByName, known).groupBy(*key).agg(F.max(F.struct(*columns)).alias("b"))
    return whole.select(*key, *[F.col(f"b.{c}").alias(c) for c in columns], F.lit(False).alias("seed"))
