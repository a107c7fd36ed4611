"""Greedy selection for many queries at once, with gains that are kept from round to round.

A query has an id, a number of seeds and a set of native vertices; all queries go a round forward together, in the same
jobs, and each row of the state carries its query's id. A pair is a candidate and a native that its best path reaches; what the candidate adds
to the native's activation is kept with the pair. A new seed changes that only for pairs of natives that it reaches or in whose
stored paths it is, and for candidates whose paths go through it: those pairs are evaluated again, others are copied.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedspread.operators.paths import closure, vertices
from seedspread.session import checkpointed, small_side

#: Gains that agree to so many digits tie, and the least id wins, however sums were ordered.
DIGITS = 9
TREE = "array<struct<v: bigint, next: bigint, p: double, sure: boolean>>"


class Round(NamedTuple):
    """chosen: qid, rank, vid, gain of all seeds so far. scores: qid, vid, gain of all other candidates (None after the last
    round). rescored: qid, s, root of the pairs that were evaluated since the round before."""

    chosen: DataFrame
    scores: DataFrame | None
    rescored: DataFrame


def root_activation(root: int, verts: list[int], probs: list[float], tree: list[dict]) -> float:
    """Activation of ``root`` by the seeds (``sure``) of its stored tree and by ``verts[0]``, whose path replaces stored edges."""
    if len(verts) == 1:
        return 1.0
    children: dict[int, list[tuple[int, float, bool]]] = {}
    for i, p in enumerate(probs):
        children.setdefault(verts[i + 1], []).append((verts[i], p, i == 0))
    own = set(verts[:-1])
    for e in tree:
        if e["v"] not in own:
            children.setdefault(e["next"], []).append((e["v"], e["p"], e["sure"]))
    order, at = [], 0
    order.append(root)
    while at < len(order):  # vertices above their children; seeds' children don't matter
        order += [v for v, _, sure in children.get(order[at], ()) if not sure]
        at += 1
    value: dict[int, float] = {}
    for v in reversed(order):
        rest = 1.0
        for child, p, sure in children.get(v, ()):
            rest *= 1 - (1.0 if sure else value[child]) * p
        value[v] = 1 - rest
    return value[root]


def evaluated(pairs: DataFrame, trees: DataFrame) -> DataFrame:
    """``pairs`` (qid, s, root, p, verts, probs) with ``add``: what s adds to the root's activation by its stored tree (qid, root, tree, ap)."""
    met = pairs.join(trees.select("qid", "root", "tree", "ap"), ["qid", "root"], "left")
    names = ["qid", "s", "root", "p", "verts", "probs"]
    alone = met.where("tree is null").select(*names, F.col("p").alias("add"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("root", "verts", "probs", "tree", "ap")), strict=True)
            add = [root_activation(root, verts, probs, tree) - ap for root, verts, probs, tree, ap in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(add, pa.float64())], names=[*names, "add"])

    shared = met.where("tree is not null").select(*names, "tree", "ap").mapInArrow(run, alone.schema)
    return alone.unionByName(shared)


def _grown(trees: DataFrame, own: DataFrame, new: DataFrame) -> DataFrame:
    """qid, root, tree, ap, dirty after new seeds (qid, seed): their paths ``own`` (qid, root, verts, probs, add) replace stored edges."""
    flagged = F.transform("tree", lambda e: F.struct(e["v"].alias("v"), e["next"].alias("next"), e["p"].alias("p"), (e["sure"] | (e["v"] == F.col("seed"))).alias("sure")))
    hit = F.exists("tree", lambda e: (e["v"] == F.col("seed")) & ~e["sure"])
    old = trees.join(new, "qid", "left").select("qid", "root", F.when(F.col("seed").isNull(), F.col("tree")).otherwise(flagged).alias("tree"), "ap", F.coalesce(hit, F.lit(False)).alias("hit"))
    path = F.transform("probs", lambda p, i: F.struct(F.get("verts", i).alias("v"), F.get("verts", i + 1).alias("next"), p.alias("p"), (i == 0).alias("sure")))
    both = old.join(own, ["qid", "root"], "full")
    kept = F.filter("tree", lambda e: ~F.array_contains(F.slice("verts", 1, F.size("probs")), e["v"]))
    none = F.array().cast(TREE)
    tree = F.when(F.col("verts").isNull(), F.col("tree")).otherwise(F.concat(path.cast(TREE), F.coalesce(kept, none)))
    dirty = F.col("verts").isNotNull() | F.coalesce("hit", F.lit(False))
    return both.select("qid", "root", tree.alias("tree"), (F.coalesce("ap", F.lit(0.0)) + F.coalesce("add", F.lit(0.0))).alias("ap"), dirty.alias("dirty"))


def stored_paths(edges: DataFrame, theta: float, natives: DataFrame) -> DataFrame:
    """The best paths, with their vertices, from all vertices and natives (vid)."""
    return closure(edges, theta, vertices(edges).union(natives.select("vid")).distinct(), routes=True)


def rounds(edges: DataFrame, queries: DataFrame, natives: DataFrame, theta: float | None = None, first: DataFrame | None = None, base: DataFrame | None = None) -> Iterator[Round]:
    """The state before each round's pick, and after the last one.

    ``queries``: qid, k, and a column theta if ``theta`` is None. ``natives``: qid, vid. ``first``: qid, vid, gain of the candidates, if
    they are known from lists; else candidates are the vertices that reach a native. They stay candidates, with gain 0, when seeds cut
    them off. A query ends when it has k seeds or no candidate is left. ``base``: ``stored_paths`` of these edges, natives and theta (the least), if they
    are there already."""
    spark = edges.sparkSession
    edges = checkpointed(edges.select("src", "dst", "p"))
    queries = checkpointed(queries.select("qid", F.col("k").cast("int").alias("k"), (F.col("theta") if theta is None else F.lit(float(theta))).alias("theta")))
    spec = queries.agg(F.max("k").alias("k"), F.min("theta").alias("theta"), F.count(F.lit(1)).alias("n")).first()
    native = checkpointed(natives.select("qid", F.col("vid").alias("root")).distinct())
    base = stored_paths(edges, spec.theta if spec.n else 1.0, native.select(F.col("root").alias("vid"))) if base is None else base
    names = ["qid", "s", "root", "p", "verts", "probs"]
    pairs = base.withColumnRenamed("v", "root").join(native, "root").join(small_side(queries.select("qid", "theta"), spec.n), "qid")
    pairs = checkpointed(pairs.where((F.col("p") > F.col("theta")) | (F.col("s") == F.col("root"))).select(*names, F.col("p").alias("add")))
    candidates = pairs.groupBy("qid", F.col("s").alias("vid")).agg(F.sum("add").alias("gain")) if first is None else first.select("qid", "vid", "gain")
    candidates = scores = checkpointed(candidates)
    trees = spark.createDataFrame([], f"qid {dict(native.dtypes)['qid']}, root long, tree {TREE}, ap double, dirty boolean")
    chosen = candidates.limit(0).select("qid", F.lit(0).alias("rank"), "vid", "gain")
    rescored, taken = pairs.select("qid", "s", "root"), 0
    for n in range(1, (spec.k or 0) + 1):
        yield Round(chosen, scores, rescored)
        open_ = scores.join(small_side(queries.where(F.col("k") >= n).select("qid"), spec.n), "qid", "left_semi")
        best = open_.groupBy("qid").agg(F.min(F.struct((-F.round("gain", DIGITS)).alias("minus"), "vid", "gain")).alias("b"))
        new = checkpointed(best.select("qid", F.lit(n).alias("rank"), "b.vid", "b.gain"))
        found = new.count()
        if not found:
            break
        chosen, taken = checkpointed(chosen.unionByName(new)), taken + found
        if n == spec.k:
            break
        going = small_side(queries.where(F.col("k") > n).select("qid", "theta"), spec.n)
        seeds = small_side(new.select("qid", F.col("vid").alias("seed")), found)
        with_seed = pairs.join(going, "qid").join(seeds, "qid")
        own = with_seed.where("s = seed").select("qid", "root", "verts", "probs", "add")
        trees = checkpointed(_grown(trees.drop("dirty"), own, seeds))
        stale = checkpointed(with_seed.where(F.array_contains("verts", F.col("seed"))).select("qid", "theta", "s", (F.col("s") == F.col("seed")).alias("gone")).distinct())
        barred = chosen.select("qid", F.col("vid").alias("v"))
        again = closure(edges, F.col("theta"), stale.where("not gone").select("qid", "theta", F.col("s").alias("vid")), barred=small_side(barred, taken), by=("qid", "theta"), routes=True)
        again = again.withColumnRenamed("v", "root").join(native, ["qid", "root"]).select(*names)
        touched = trees.where("dirty").select("qid", "root")
        touched = small_side(touched)
        rest = pairs.join(going.select("qid"), "qid", "left_semi").join(small_side(stale.select("qid", "s")), ["qid", "s"], "left_anti")
        redo = checkpointed(rest.join(touched, ["qid", "root"], "left_semi").select(*names).unionByName(again))
        rescored = redo.select("qid", "s", "root")
        pairs = checkpointed(rest.join(touched, ["qid", "root"], "left_anti").unionByName(evaluated(redo, trees)))
        sums = pairs.groupBy("qid", F.col("s").alias("vid")).agg(F.sum("add").alias("sum"))
        free = candidates.join(going.select("qid"), "qid", "left_semi").join(small_side(chosen.select("qid", "vid"), taken), ["qid", "vid"], "left_anti").select("qid", "vid")
        scores = checkpointed(free.join(sums, ["qid", "vid"], "left").select("qid", "vid", F.coalesce("sum", F.lit(0.0)).alias("gain")))
    yield Round(chosen, None, rescored)


def expansions(edges: DataFrame, queries: DataFrame, natives: DataFrame, theta: float | None = None, base: DataFrame | None = None) -> DataFrame:
    """qid, rank, vid, gain: the best k seeds of each of ``queries`` (qid, k, and theta if it isn't one for all) for its ``natives`` (qid, vid)."""
    chosen = None
    for chosen, _, _ in rounds(edges, queries, natives, theta, base=base):  # noqa: B007
        pass
    return chosen
