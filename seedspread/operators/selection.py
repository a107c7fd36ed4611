"""Choosing k seeds. A round's argmax (one row) is all that reaches the driver; ties go to the least id.

What differs from other formulations on purpose: trees don't depend on the order in which seeds or candidates were looked
at, seeds always have activation 1, and a root's own activation is not discounted twice unless ``compat_root`` asks for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedspread.operators.batch import DIGITS, expansions, rounds
from seedspread.operators.graph import degrees, pagerank
from seedspread.operators.paths import closure, reverse, vertices
from seedspread.operators.probability import degree_discount, hash_coin
from seedspread.operators.trees import activation, rerouted
from seedspread.session import checkpointed, small_side

SEEDS = "rank int, vid long, gain double"


def top(scores: DataFrame, k: int, by: str) -> DataFrame:
    """rank, vid, ``by`` of the k best by a score; the limit is taken before ranks are given."""
    best = scores.orderBy(F.desc(by), "vid").limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.desc(by), "vid")).alias("rank"), "vid", by)


def by_degree(edges: DataFrame, k: int) -> DataFrame:
    return top(degrees(edges), k, "degree")


def by_weighted_degree(edges: DataFrame, k: int) -> DataFrame:
    return top(degrees(edges), k, "weighted")


def by_pagerank(edges: DataFrame, k: int, **options) -> DataFrame:
    """Ranks that agree to ``DIGITS`` digits tie, however sums were ordered."""
    return top(pagerank(edges, **options).select("vid", F.round("rank", DIGITS).alias("score")), k, "score")


def at_random(edges: DataFrame, k: int, seed: int = 0) -> DataFrame:
    return top(vertices(edges).withColumn("coin", hash_coin(F.lit(seed), F.col("vid"))), k, "coin")


def first_gains(mip: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """vid, gain: expected influence of each vertex alone, the sum of its path probabilities (to ``counted`` vertices)."""
    kept = mip if counted is None else mip.join(counted.select(F.col("vid").alias("v")), "v", "left_semi")
    return kept.groupBy(F.col("s").alias("vid")).agg(F.sum("p").alias("gain"))


def upper_gains(mip: DataFrame, ap: DataFrame) -> DataFrame:
    """vid, gain: sum of p (1 - ap): never below the exact gain."""
    return mip.join(ap.select("v", "ap"), "v").groupBy(F.col("s").alias("vid")).agg(F.sum(F.col("p") * (1 - F.col("ap"))).alias("gain"))


def lower_gains(mip: DataFrame, ap: DataFrame) -> DataFrame:
    """vid, gain: sum of max(0, p - ap): never above the exact gain."""
    return mip.join(ap.select("v", "ap"), "v").groupBy(F.col("s").alias("vid")).agg(F.sum(F.greatest(F.lit(0.0), F.col("p") - F.col("ap"))).alias("gain"))


def claimed(mip: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row, bound: what ranked seeds (rank, vid) reach at least, each vertex counted for its first seed only."""
    first = mip.join(ranked.select(F.col("vid").alias("s"), "rank"), "s").groupBy("v").agg(F.min_by("p", "rank").alias("p"))
    return first.agg(F.sum("p").alias("bound"))


def listed(spark, chosen: list[tuple[int, float]]) -> DataFrame:
    return spark.createDataFrame([(i, v, float(g)) for i, (v, g) in enumerate(chosen, 1)], SEEDS)


def pick(scores: DataFrame, taken: list[int]) -> tuple[int, float] | None:
    free = scores.where(~F.col("vid").isin(taken)) if taken else scores
    row = free.orderBy(F.desc("gain"), "vid").limit(1).collect()
    return (row[0].vid, row[0].gain) if row else None


def mia(edges: DataFrame, k: int, theta: float, roots: DataFrame | None = None) -> DataFrame:
    """rank, vid, gain: greedy on trees that stay as they are; seeds only change activations.

    ``roots`` (vid): the vertices that count, e.g. the natives of a rectangle; all by default."""
    return _on_trees(edges, k, theta, roots, blocking=False)


def pmia(edges: DataFrame, k: int, theta: float, roots: DataFrame | None = None, compat_root: bool = False) -> DataFrame:
    """rank, vid, gain: greedy on trees in which earlier seeds block paths.

    Paths don't go on past seeds, and avoid the seeds that are not valid for the root, because a later seed lay on their way to it.
    So a new seed matters to the roots whose trees hold it, and there only what lies beyond it is taken out: seeds for good, other
    vertices until they find another way (``trees.rerouted``). A seed's own tree is itself."""
    return _on_trees(edges, k, theta, roots, blocking=True, compat_root=compat_root)


def _on_trees(edges: DataFrame, k: int, theta: float, roots: DataFrame | None, blocking: bool, compat_root: bool = False) -> DataFrame:
    """Greedy whose rounds read and write only the trees that hold the new seed.

    A tree's rows carry the round (``at``) that wrote them; ``last`` tells each root's latest. What a vertex adds to all roots is kept as a
    total: a round takes away what the old rows of its trees gave and adds what the new ones give."""
    spark = edges.sparkSession
    back = checkpointed(reverse(edges))
    grown = closure(back, theta, roots, routes=blocking)
    grown = grown.withColumns({"seed": F.lit(False), "ap": F.lit(0.0), "alpha": F.col("p"), "at": F.lit(0)})
    written = [checkpointed(grown.drop("probs"))]
    last = checkpointed(written[0].select("s", "at").distinct())

    def given(rows: DataFrame, sign: int) -> DataFrame:
        added = F.sum(F.col("alpha") * (1 - F.col("ap"))) * sign
        return rows.groupBy(F.col("v").alias("vid")).agg(added.alias("gain"), (F.count_if(~F.col("seed")) * sign).alias("n"))

    totals = checkpointed(given(written[0], 1))
    chosen: list[tuple[int, float]] = []
    while len(chosen) < k:
        best = totals.where("n > 0").orderBy(F.desc(F.round("gain", DIGITS)), "vid").limit(1).collect()
        if not best:
            break
        new = best[0].vid
        chosen.append((new, best[0].gain))
        if len(chosen) == k:
            break
        every = reduce(DataFrame.unionByName, written)
        held = checkpointed(every.where(F.col("v") == new).select("s", "at").join(last, ["s", "at"], "left_semi"))
        old = checkpointed(every.join(small_side(held), ["s", "at"], "left_semi"))
        rows = old.drop("ap", "alpha", "at").withColumn("seed", F.col("seed") | (F.col("v") == new))
        if blocking:
            beyond = F.array_contains("verts", F.lit(new)) & (F.col("v") != new)
            stay = rows.where(~beyond)
            rows = stay.unionByName(rerouted(back, theta, stay, rows.where(beyond & ~F.col("seed") & (F.col("s") != new)).select("s", "v")))
        rows = checkpointed(rows)
        fresh = rows.join(activation(rows, F.col("seed"), compat_root), ["s", "v"]).withColumn("at", F.lit(len(chosen)))
        written.append(checkpointed(fresh))
        last = checkpointed(last.join(held, "s", "left_anti").unionByName(held.withColumn("at", F.lit(len(chosen)))))
        changed = totals.unionByName(given(old, -1)).unionByName(given(written[-1], 1))
        totals = checkpointed(changed.groupBy("vid").agg(F.sum("gain").alias("gain"), F.sum("n").alias("n")))
    return listed(spark, chosen)


def expanding(edges: DataFrame, k: int, theta: float, natives: DataFrame, first: DataFrame | None = None, base: DataFrame | None = None) -> Iterator[tuple[list[tuple[int, float]], DataFrame | None]]:
    """Rounds of greedy on the natives' activation, evaluated on the union of the seeds' stored paths to each native: the seeds
    chosen so far with their gains, and the gains (vid, gain) of all other candidates beside them (None after the last round).

    A candidate's paths skip the chosen seeds; its gain is what they add to the stored ones, where a vertex goes on as in the newest
    path through it. Every candidate's gain is exact in every round: a lazy queue gives other seeds where a gain grows, as gains here
    aren't submodular; but only what a new seed can change is evaluated again (``batch.rounds``, here for one query). ``first``: the
    gains of the first round, if they are known from lists. ``base``: ``batch.stored_paths`` if they are there already."""
    query = edges.sparkSession.createDataFrame([(0, k)], "qid int, k int")
    found = rounds(edges, query, natives.select(F.lit(0).alias("qid"), "vid"), theta, first.select(F.lit(0).alias("qid"), "vid", "gain") if first is not None else None, base)
    for chosen, scores, _ in found:
        yield [(r.vid, r.gain) for r in chosen.orderBy("rank").collect()], scores.select("vid", "gain") if scores is not None else None


def expansion(edges: DataFrame, k: int, theta: float, natives: DataFrame, first: DataFrame | None = None, base: DataFrame | None = None) -> DataFrame:
    """rank, vid, gain of the best k seeds for the natives (see ``expanding``)."""
    chosen: list[tuple[int, float]] = []
    for chosen, _ in expanding(edges, k, theta, natives, first, base):  # noqa: B007
        pass
    return listed(edges.sparkSession, chosen)


def reached_by_vertices(base: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of ``batch.stored_paths`` that the closure of the edges has: without natives that have no edge."""
    return base.join(vertices(edges).withColumnRenamed("vid", "s"), "s", "left_semi")


def region_lists(mip: DataFrame, placed: DataFrame) -> DataFrame:
    """rid, vid, dp, rank: for each region of natives (vid, rid; null: the fringe), the vertices that reach any, best first."""
    reach = mip.join(placed.select(F.col("vid").alias("v"), F.coalesce("rid", F.lit("fringe")).alias("rid")), "v")
    sums = reach.groupBy("rid", F.col("s").alias("vid")).agg(F.sum("p").alias("dp"))
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("dp"), "vid")))


def leading(lists: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of each region's list; all if ``n`` is negative."""
    return lists if n < 0 else lists.where(F.col("rank") <= n)


def merged_top(lists: DataFrame, k: int, depth: int = 8) -> DataFrame:
    """rank, vid, gain: the k vertices with the largest sums over all lists, by the threshold algorithm.

    Lists are read down to ``depth``, which doubles until the k-th sum is above what a vertex below it can have at most: the sum of
    the lists' values at that depth (an equal sum could have a smaller id). So the long tails of the lists are summed for vertices of their heads only."""
    while True:
        heads = lists.where(F.col("rank") <= depth).select("vid").distinct()
        best = top(lists.join(heads, "vid").groupBy("vid").agg(F.sum("dp").alias("gain")), k, "gain")
        below = lists.where(F.col("rank") == depth).agg(F.sum("dp")).first()[0]
        kth = best.agg(F.count(F.lit(1)).alias("n"), F.min("gain").alias("least")).first()
        if below is None or kth.n == k and kth.least > below:
            return best
        depth *= 2


def assembly(edges: DataFrame, k: int, theta: float, placed: DataFrame, lists: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """rank, vid, gain: ``expansion`` whose first gains come from ready lists of the natives' (vid, rid) regions and fringe."""
    first = lists.groupBy("vid").agg(F.sum("dp").alias("gain"))
    return expansion(edges, k, theta, placed.select("vid"), first, base)


def region_seeds(edges: DataFrame, theta: float, placed: DataFrame, tau: int, ratio: int = 1, base: DataFrame | None = None) -> DataFrame:
    """rid, pos, vid, gain: the best seeds of each region of natives (vid, rid; null: the fringe) alone: ``tau``, at most its natives /
    ``ratio``. All regions are selected for side by side."""
    named = checkpointed(placed.select("vid", F.coalesce("rid", F.lit("fringe")).alias("qid")))
    size = F.least(F.lit(tau), F.floor(F.count(F.lit(1)) / ratio).cast("int"))
    found = expansions(edges, named.groupBy("qid").agg(size.alias("k")).where("k > 0"), named, theta, base)
    return found.select(F.col("qid").alias("rid"), F.col("rank").alias("pos"), "vid", "gain")


def merged_hints(ready: DataFrame, k: int) -> tuple[DataFrame, float]:
    """(rank, vid of the k hints; the gain of all that was taken) from ``region_seeds``.

    The lists' heads compete: the largest gain goes next, a seed that was taken before adds its gain but takes no place. A
    seed can't go before those above it in its list, so it competes with the least gain down to its own."""
    least = F.min("gain").over(Window.partitionBy("rid").orderBy("pos"))
    placed = checkpointed(ready.withColumn("at", F.struct((-least).alias("w"), "rid", "pos")))
    first = placed.groupBy("vid").agg(F.min("at").alias("at")).orderBy("at").limit(k)
    hints = checkpointed(first.select("vid", "at", F.row_number().over(Window.orderBy("at")).alias("rank")))  # k rows
    end = hints.agg(F.max("at").alias("end"))
    taken = placed.join(F.broadcast(end)).where("at <= end").agg(F.sum("gain")).first()[0]
    return hints.select("rank", "vid"), taken or 0.0


def upper_rest(scores: DataFrame, n: int) -> float:
    """What ``n`` more seeds add at most: the sum of the n largest gains."""
    return scores.orderBy(F.desc("gain"), "vid").limit(n).agg(F.sum("gain")).first()[0] or 0.0


def hinted(edges: DataFrame, k: int, theta: float, placed: DataFrame, lists: DataFrame, ready: DataFrame, accept: float, base: DataFrame | None = None) -> DataFrame:
    """rank, vid, gain: as ``assembly``, but the merged hints of ``region_seeds`` are returned, with null gains, as soon as their
    gain is above ``accept`` times the upper bound, from the second seed on."""
    hints, lower = merged_hints(ready, k)
    first = lists.groupBy("vid").agg(F.sum("dp").alias("gain"))
    chosen: list[tuple[int, float]] = []
    for chosen, scores in expanding(edges, k, theta, placed.select("vid"), first, base):
        if scores is not None and len(chosen) >= 2 and lower > accept * (sum(g for _, g in chosen) + upper_rest(scores, k - len(chosen))):
            return hints.select("rank", "vid", F.lit(None).cast("double").alias("gain"))
    return listed(edges.sparkSession, chosen)


def hinted_by_bounds(edges: DataFrame, k: int, theta: float, placed: DataFrame, lists: DataFrame, accept: float, base: DataFrame | None = None) -> DataFrame:
    """rank, vid, gain: as ``hinted``, with a lower bound from the seeds alone: their gains, and what they and the vertices of
    the largest ``lower_gains`` claim among natives that no seed reaches. On success the best scores fill the places left."""
    native = placed.select(F.col("vid").alias("v")).distinct()
    found = closure(edges.select("src", "dst", "p"), theta) if base is None else reached_by_vertices(base, edges)
    mip = checkpointed(found.select("s", "v", "p").join(native, "v", "left_semi"))
    first = lists.groupBy("vid").agg(F.sum("dp").alias("gain"))
    chosen: list[tuple[int, float]] = []
    for chosen, scores in expanding(edges, k, theta, placed.select("vid"), first, base):
        if scores is None or len(chosen) < 2:
            continue
        seeds, total, rest = [v for v, _ in chosen], sum(g for _, g in chosen), k - len(chosen)
        hit = checkpointed(mip.where(F.col("s").isin(seeds)).groupBy("v").agg((1 - F.product(1 - F.col("p"))).alias("ap")))
        untouched = mip.join(hit, "v", "left_anti")
        next_ = top(lower_gains(mip.where(~F.col("s").isin(seeds)), native.join(hit, "v", "left").select("v", F.coalesce("ap", F.lit(0.0)).alias("ap"))), rest, "gain")
        lower = total + (claimed(untouched, next_.select("rank", "vid")).first()[0] or 0.0)
        if lower > accept * (total + upper_rest(scores, rest)):
            fill = scores.orderBy(F.desc("gain"), "vid").limit(rest).collect()
            return listed(edges.sparkSession, [*chosen, *((r.vid, r.gain) for r in fill)])
    return listed(edges.sparkSession, chosen)


def reranked(shortlist: DataFrame, k: int, spread: Callable[[DataFrame], float], most: int = 1000) -> DataFrame:
    """rank, vid, gain: greedy over ``spread`` among a shortlist (vid, gain) of the best of a cheaper method."""
    return celf(shortlist, k, spread, shortlist, most)


def swept(edges: DataFrame, k: int, bounds: tuple[int, int], natives: DataFrame | None = None) -> DataFrame:
    """bound, rank, vid, gain: ``expansion`` at theta = 1 / bound for each bound of ``theta_sweep``, all side by side; for all vertices unless
    ``natives`` (vid) are given."""
    every = [bounds[0] << i for i in range(64) if bounds[0] << i < bounds[1]]
    queries = edges.sparkSession.createDataFrame([(b, k, 1 / b) for b in every], "qid long, k int, theta double")
    natives = vertices(edges) if natives is None else natives.select("vid")
    found = expansions(edges, queries, natives.join(F.broadcast(queries.select("qid"))))  # a few bounds
    return found.withColumnRenamed("qid", "bound")


def theta_sweep(edges: DataFrame, k: int, bounds: tuple[int, int], select: Callable[[DataFrame, int, float], DataFrame]) -> DataFrame:
    """bound, tree_size, rank, vid, gain: ``select`` at theta = 1 / bound, bounds doubling from the first while below the second."""
    out, bound = None, bounds[0]
    while bound < bounds[1]:
        sizes = closure(reverse(edges), 1 / bound).groupBy("s").agg(F.count(F.lit(1)).alias("n")).agg(F.avg(F.col("n") * F.col("n")).alias("tree_size"))
        own = select(edges, k, 1 / bound).withColumn("bound", F.lit(bound)).join(F.broadcast(sizes))  # one row
        out = own if out is None else out.unionByName(own)
        bound *= 2
    return out.select("bound", "tree_size", "rank", "vid", "gain")




def degree_discount_seeds(edges: DataFrame, k: int, p: float = 0.01) -> DataFrame:
    """rank, vid, gain (the discounted degree): a pick discounts its out-neighbours, by the edges' multiplicity ``c`` if there is one."""
    times = F.sum("c") if "c" in edges.columns else F.count(F.lit(1))
    degree = checkpointed(degrees(edges).select("vid", "degree"))
    chosen: list[tuple[int, float]] = []
    for _ in range(k):
        taken = [v for v, _ in chosen]
        hits = edges.where(F.col("src").isin(taken)).groupBy(F.col("dst").alias("vid")).agg(times.alias("t")) if taken else degree.select("vid", F.lit(0).alias("t"))
        scores = degree.join(hits, "vid", "left").select("vid", degree_discount(F.col("degree"), F.coalesce("t", F.lit(0)), p).cast("double").alias("gain"))
        best = pick(scores, taken)
        if best is None:
            break
        chosen.append(best)
    return listed(edges.sparkSession, chosen)


def celf(edges: DataFrame, k: int, spread: Callable[[DataFrame], float], candidates: DataFrame, most: int = 10_000) -> DataFrame:
    """rank, vid, gain: lazy greedy over ``spread`` (a function of a seed table); old gains are upper bounds.

    ``candidates`` (vid, gain): at most ``most``, else an error, with upper bounds of their gains, e.g. from ``first_gains``; they
    reach the driver, which keeps the queue and asks for the exact gain of its head only."""
    rows = candidates.select("vid", "gain").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} candidates; take the best of them first")
    spark = edges.sparkSession
    queue = {r.vid: (r.gain, 0) for r in rows}
    chosen: list[tuple[int, float]] = []
    total = 0.0
    while len(chosen) < k and queue:
        vid = min(queue, key=lambda v: (-queue[v][0], v))
        gain, seen = queue.pop(vid)
        if seen == len(chosen) + 1:
            chosen.append((vid, gain))
            total += gain
            continue
        seeds = spark.createDataFrame([(v,) for v, _ in chosen] + [(vid,)], "vid long")
        queue[vid] = spread(seeds) - total, len(chosen) + 1
    return listed(spark, chosen)


def overlap(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row, accuracy: the share of ``one``'s seeds that are in ``two``."""
    hit = one.join(two.select("vid").withColumn("hit", F.lit(1)), "vid", "left")
    return hit.agg((F.count("hit") / F.count(F.lit(1))).alias("accuracy"))
