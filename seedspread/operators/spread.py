"""How many vertices a set of seeds activates: Monte Carlo on live edges, and the shortest-path models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedspread.operators.paths import vertices
from seedspread.operators.probability import hash_coin, uniform
from seedspread.session import checkpointed, small_side


#: Pairs of a run and an edge up to which all coins are thrown at once; beyond, those of the edges that are met.
LIVE_ROWS = 10_000_000
#: Rows of a step up to which they are broadcast to the live edges, which are then read but not shuffled.
FRONT_ROWS = 50_000


def reached(edges: DataFrame, seeds: DataFrame, runs: int) -> DataFrame:
    """run, vid: the vertices that the seeds (vid) reach over the live edges of each run; an edge's coin is its key's hash."""
    start = seeds.select("vid").distinct().withColumn("run", F.explode(run_numbers(runs)))
    return _reached(live_edges(edges, runs), start, ["run"])


def run_numbers(runs: int) -> Column:
    return F.sequence(F.lit(0), F.lit(runs - 1)).cast("array<long>")


def live_edges(edges: DataFrame, runs: int, most: int | None = LIVE_ROWS) -> DataFrame:
    """run, vid, dst of the live edges of all runs, if ``most`` doesn't speak against it; else ``edges``, whose coins are thrown where they are met."""
    edges = checkpointed(edges.select("src", "dst", "p"))
    if most is not None and edges.count() * runs > most:
        return edges
    thrown = edges.withColumn("run", F.explode(run_numbers(runs)))
    return checkpointed(thrown.where(hash_coin(F.col("run"), F.col("src"), F.col("dst")) < F.col("p")).select("run", F.col("src").alias("vid"), "dst"))


def _reached(live: DataFrame, start: DataFrame, key: list[str], past: DataFrame | None = None) -> DataFrame:
    """``key``, vid: what each key's start vertices reach over ``live_edges``; ``key`` has a column run. Steps are kept as they come.
    ``past`` (run, vid): vertices that are neither reached nor passed."""
    start = start.select(*key, "vid").distinct()
    seen = [checkpointed(start if past is None else start.join(past, ["run", "vid"], "left_anti"))]
    rows = last = seen[0].count()
    while last:
        front = small_side(seen[-1], last, FRONT_ROWS)
        if "run" in live.columns:
            step = live.join(front, ["run", "vid"])
        else:
            step = front.join(live.withColumnRenamed("src", "vid"), "vid").where(hash_coin(F.col("run"), F.col("vid"), F.col("dst")) < F.col("p"))
        step = step.select(*key, F.col("dst").alias("vid")).distinct()
        step = step if past is None else step.join(past, ["run", "vid"], "left_anti")
        known = small_side(reduce(DataFrame.unionByName, seen), rows)
        seen.append(checkpointed(step.join(known, [*key, "vid"], "left_anti")))
        last = seen[-1].count()
        rows += last
    return reduce(DataFrame.unionByName, seen)


def monte_carlo(edges: DataFrame, seeds: DataFrame, runs: int, counted: DataFrame | None = None) -> DataFrame:
    """One row, spread: mean number of activated vertices, or of those in ``counted`` (vid)."""
    found = reached(edges, seeds, runs)
    if counted is not None:
        found = found.join(counted.select("vid"), "vid", "left_semi")
    return found.agg((F.count(F.lit(1)) / F.lit(float(runs))).alias("spread"))


def all_reached(live: DataFrame) -> DataFrame:
    """run, s, vid, far: what every vertex s reaches over ``live`` (run, vid, dst) beside itself, and in how many edges.

    Distances double: what s reaches in more than h and up to 2 h edges is what those vertices that are h away reach in up to h."""
    key, h = ["run", "s", "vid"], 1
    known = [checkpointed(live.where("vid <> dst").select("run", F.col("vid").alias("s"), F.col("dst").alias("vid"), F.lit(1).alias("far")).distinct())]
    while not known[-1].where(F.col("far") == h).isEmpty():
        found = reduce(DataFrame.unionByName, known)
        ends = known[-1].where(F.col("far") == h).select("run", "s", F.col("vid").alias("at"))
        step = ends.join(found.select("run", F.col("s").alias("at"), "vid", "far"), ["run", "at"]).where("s <> vid")
        step = step.groupBy(*key).agg((F.min("far") + h).alias("far"))
        known.append(checkpointed(step.join(found.select(*key), key, "left_anti")))
        h *= 2
    return reduce(DataFrame.unionByName, known)


def lazy_greedy(edges: DataFrame, k: int, runs: int, candidates: DataFrame, few: int = 64) -> DataFrame:
    """rank, vid, gain: greedy on the mean number of vertices activated over ``runs`` live-edge graphs, among ``candidates`` (vid).

    What each candidate reaches in each run is found once and kept. A round takes from each candidate's count what the new seed reaches
    and no seed before it did, so all gains are exact and none is evaluated again. Up to ``few`` candidates, or a tenth of the
    vertices, are followed step by step; if there are more, all vertices are followed (``all_reached``). A round's best row is all that the driver names."""
    spark = edges.sparkSession
    names = checkpointed(candidates.select("vid").distinct())
    size = names.count()
    if size > few and size * 10 > vertices(edges).count():
        reach = all_reached(live_edges(edges, runs, None)).select("run", "s", "vid")
        reach = reach.join(small_side(names.select(F.col("vid").alias("s")), size), "s", "left_semi")
    else:
        start = names.select(F.col("vid").alias("s"), "vid", F.explode(run_numbers(runs)).alias("run"))
        reach = _reached(live_edges(edges, runs), start, ["s", "run"]).where("s <> vid").select("run", "s", "vid")
    reach, every = checkpointed(reach), F.explode(run_numbers(runs))
    own = reach.groupBy(F.col("s").alias("vid")).agg(F.count(F.lit(1)).alias("n"))
    left = checkpointed(names.join(own, "vid", "left").select("vid", (F.coalesce("n", F.lit(0)) + runs).alias("n")))
    taken = spark.createDataFrame([], "run long, vid long")
    chosen: list[tuple[int, int, float]] = []
    while len(chosen) < k:
        best = left.orderBy(F.desc("n"), "vid").limit(1).collect()
        if not best:
            break
        seed = best[0].vid
        chosen.append((len(chosen) + 1, seed, best[0].n / runs))
        if len(chosen) == k:
            break
        held = reach.where(F.col("s") == seed).select("run", "vid").unionByName(spark.range(1).select(every.alias("run"), F.lit(seed).alias("vid")))
        new = checkpointed(held.join(taken, ["run", "vid"], "left_anti"))
        taken = checkpointed(taken.unionByName(new))
        met = reach.join(small_side(new), ["run", "vid"]).select(F.col("s").alias("vid")).unionByName(new.select("vid"))
        lost = met.groupBy("vid").agg(F.count(F.lit(1)).alias("lost"))
        left = checkpointed(left.where(F.col("vid") != seed).join(lost, "vid", "left").select("vid", (F.col("n") - F.coalesce("lost", F.lit(0))).alias("n")))
    return spark.createDataFrame(chosen, "rank int, vid long, gain double")


def constant_ratio(edges: DataFrame, ratio: float = 0.01) -> DataFrame:
    """src, dst, p of edges (src, dst, c) whose c parallel edges each have the same probability."""
    return edges.select("src", "dst", uniform(F.col("c"), ratio).alias("p"))


def curve(edges: DataFrame, ranked: DataFrame, runs: int) -> DataFrame:
    """rank, spread of each prefix of ranked seeds (rank, vid): one Monte Carlo, in which a vertex has the rank of the first seed
    that reaches it.

    A run's live edges are the same for all prefixes, so a vertex that counts for a prefix counts for all longer ones."""
    start = ranked.select("vid", "rank").withColumn("run", F.explode(run_numbers(runs)))
    first = _reached(live_edges(edges, runs), start, ["run", "rank"]).groupBy("run", "vid").agg(F.min("rank").alias("rank"))
    new = first.groupBy("rank").agg(F.count(F.lit(1)).alias("new"))
    all_ = ranked.select("rank").distinct().join(new, "rank", "left")
    return all_.select("rank", (F.sum(F.coalesce("new", F.lit(0))).over(Window.orderBy("rank")) / F.lit(float(runs))).alias("spread"))  # a row for each seed


def shortest_path_model(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """vid, ring, p: vertices by their distance from the seeds; activated only by the ring before, independently."""
    rings = checkpointed(seeds.select("vid").distinct().select("vid", F.lit(0).alias("ring"), F.lit(1.0).alias("p")))
    last, ring = rings, 0
    while not last.isEmpty():
        ring += 1
        step = last.withColumnRenamed("p", "before").join(edges, F.col("vid") == F.col("src")).groupBy(F.col("dst").alias("vid")).agg((1 - F.product(1 - F.col("before") * F.col("p"))).alias("p"))
        last = checkpointed(step.join(rings.select("vid"), "vid", "left_anti").select("vid", F.lit(ring).alias("ring"), "p"))
        rings = checkpointed(rings.unionByName(last))
    return rings


def shortest_path_plus_one_model(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """vid, ring, p, late: as ``shortest_path_model``, and the probability of activation one step later than by a shortest path.

    A vertex that isn't activated in its ring's turn is so one step later, by vertices of its own ring that were in theirs, or by
    vertices of the ring before that were late."""
    rings = shortest_path_model(edges, seeds)
    late = checkpointed(rings.where("ring = 0").select("vid", F.lit(0.0).alias("late")))
    known, ring = [late], 0
    while not late.isEmpty():
        ring += 1
        own = rings.where(F.col("ring") == ring).select("vid", "p")
        given = own.withColumnRenamed("p", "of").unionByName(late.withColumnRenamed("late", "of"))
        come = given.join(edges, F.col("vid") == F.col("src")).groupBy(F.col("dst").alias("vid")).agg(F.product(1 - F.col("of") * F.col("p")).alias("rest"))
        late = checkpointed(own.join(come, "vid", "left").select("vid", ((1 - F.col("p")) * (1 - F.coalesce("rest", F.lit(1.0)))).alias("late")))
        known.append(late)
    return rings.join(reduce(DataFrame.unionByName, known), "vid")
