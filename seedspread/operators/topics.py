"""Items as topic vectors: graphs for an item, bounds, nearest samples, clusters."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedspread.operators.batch import DIGITS
from seedspread.operators.paths import closure, vertices
from seedspread.operators.probability import divergence, strongest_topic, topic
from seedspread.operators.selection import listed, pick
from seedspread.operators.spread import monte_carlo
from seedspread.session import checkpointed, small_side


#: Each batch of a lazy round is so many times the one before: where bounds are loose, or many candidates tie, batches stay few.
WIDER = 8


def for_item(tedges: DataFrame, item: list[float]) -> DataFrame:
    """src, dst, p: the graph of one item."""
    return tedges.select("src", "dst", topic(F.col("w"), F.array(*map(F.lit, item))).alias("p")).where("p > 0")


def both_directions(edges: DataFrame) -> DataFrame:
    """u, v, p, p_back of each pair with an edge in either direction; 0 where there is none."""
    ahead = edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), F.when(F.col("src") < F.col("dst"), F.col("p")).otherwise(0.0).alias("p"), F.when(F.col("src") > F.col("dst"), F.col("p")).otherwise(0.0).alias("b"))
    return ahead.groupBy("u", "v").agg(F.max("p").alias("p"), F.max("b").alias("p_back"))


def topic_statistics(tedges: DataFrame) -> DataFrame:
    """One row: vertices, edges, topics, mean of the edges' largest weights."""
    ends = tedges.select(F.explode(F.array("src", "dst")).alias("vid"))
    one = tedges.agg(F.count(F.lit(1)).alias("m"), F.max(F.size("w")).cast("long").alias("z"), F.avg(strongest_topic(F.col("w"))).alias("mean_max"))
    return ends.agg(F.countDistinct("vid").alias("n")).join(F.broadcast(one))  # one row beside one row


def vertex_bounds(tedges: DataFrame, theta: float, coarse: float) -> DataFrame:
    """vid, infl, infl2: sums of the best path probabilities under each edge's largest weight, p >= theta; and of those above
    theta / coarse."""
    reach = closure(tedges.select("src", "dst", strongest_topic(F.col("w")).alias("p")), theta, inclusive=True)
    return reach.groupBy(F.col("s").alias("vid")).agg(F.sum("p").alias("infl"), F.sum(F.when(F.col("p") > theta / coarse, F.col("p")).otherwise(0.0)).alias("infl2"))


def _distribution(v: Column) -> Column:
    """Whether an array has components and all are known, finite and at least 0."""
    return (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (x >= 0) & (x < float("inf")))


def _l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def _scaled(df: DataFrame, item: str, floor: float = 1e-7) -> DataFrame:
    """``df`` with z, total and unit of an item: its number of components, their sum, and the item over it; zeros count as ``floor``."""
    filled = F.transform(item, lambda x: F.when(x == 0, F.lit(floor)).otherwise(x))
    sized = df.where(_distribution(F.col(item))).withColumn("filled", filled).withColumn("total", F.aggregate("filled", F.lit(0.0), lambda s, x: s + x))
    return sized.withColumns({"z": F.size(item), "unit": F.transform("filled", lambda x: x / F.col("total"))}).drop("filled")


def sample_cells(samples: DataFrame, pivots: int = 256, width: float = 1 / 32, part: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(sid, sample, z, cell, ring, part; z, cells): samples (sid, item) by their nearest pivot and their distance to it, and what bounds
    each cell and ring: least and largest distance, largest total, parts.

    Pivots are at most ``pivots`` samples of each number of components, by hash; distances are L1 between units (see ``_scaled``). Of
    equal samples the least sid stays. Rings of more than ``part`` samples are dealt into parts."""
    once = checkpointed(_scaled(samples.groupBy("item").agg(F.min("sid").alias("sid")), "item").withColumnRenamed("item", "sample"))
    order = Window.partitionBy("z").orderBy(F.xxhash64("sample"), "sid")
    chosen = checkpointed(once.withColumn("cell", F.row_number().over(order)).where(F.col("cell") <= pivots).select("z", "cell", "sample", "unit"))
    table = chosen.groupBy("z").agg(F.collect_list(F.struct("cell", F.col("unit").alias("centre"))).alias("pivots"))  # ``pivots`` of each
    near = F.array_min(F.transform("pivots", lambda c: F.struct(_l1(F.col("unit"), c["centre"]).alias("apart"), c["cell"].alias("cell"))))
    placed = once.join(small_side(table, most=1000), "z").withColumn("near", near)
    placed = checkpointed(placed.select("sid", "sample", "z", "total", "near.cell", "near.apart", F.floor(F.col("near.apart") / width).alias("ring")))
    bounds = F.min("apart").alias("lo"), F.max("apart").alias("hi"), F.max("total").alias("top")
    rings = checkpointed(placed.groupBy("z", "cell", "ring").agg(*bounds, F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts")))
    crowded = small_side(rings.where("parts > 1").select("z", "cell", "ring", "parts"))
    placed = placed.join(crowded, ["z", "cell", "ring"], "left").withColumn("part", F.pmod(F.xxhash64("sid"), F.coalesce("parts", F.lit(1))).cast("int"))
    cells = rings.groupBy("z", "cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("top").alias("top"), F.collect_list(F.struct("ring", "lo", "hi", "top", "parts")).alias("rings"))
    cells = cells.join(chosen, ["z", "cell"]).groupBy("z").agg(F.collect_list(F.struct("cell", "sample", "unit", "lo", "hi", "top", "rings")).alias("cells"))
    return placed.select("sid", "sample", "z", "cell", "ring", "part"), checkpointed(cells)


def near_pairs(items: DataFrame, samples: DataFrame, most: float = 1.0, pivots: int = 256, hot: int = 1_000_000) -> DataFrame:
    """qid, sid, distance of the items (qid, item) and the samples that could be their nearest with a divergence below ``most``.

    By Pinsker's inequality KL(p || q) is at least P (l1^2 / 2 + ln(P / Q)), for totals P and Q and units l1 apart, and by the triangle
    inequality l1 is at least what the distances of both to a pivot differ by. So an item meets only the rings of samples where that
    bound isn't above its least divergence from a pivot. A ring that more than ``hot`` items ask for is copied to parts of them."""
    placed, cells = sample_cells(samples, pivots)
    ready = _scaled(items.select("qid", "item"), "item").join(small_side(cells, most=1000), "z")

    def open_(c: Column, apart: Column) -> Column:
        gap = F.greatest(F.lit(0.0), c["lo"] - apart, apart - c["hi"])
        return F.col("total") * (gap * gap / 2 + F.ln(F.col("total") / c["top"])) <= F.col("best") + 2 * 10.0**-DIGITS * (1 + F.col("total"))

    met = F.transform("cells", lambda c: F.struct(_l1(F.col("unit"), c["unit"]).alias("apart"), divergence(F.col("item"), c["sample"]).alias("kl"), *[c[n].alias(n) for n in ("cell", "lo", "hi", "top", "rings")]))
    asked = ready.withColumn("cells", met).withColumn("best", F.least(F.lit(float(most)), F.array_min(F.transform("cells", lambda c: c["kl"]))))
    asked = asked.withColumn("c", F.explode(F.filter("cells", lambda c: open_(c, c["apart"])))).drop("cells")
    asked = asked.withColumn("r", F.explode(F.filter("c.rings", lambda r: open_(r, F.col("c.apart")))))
    asked = checkpointed(asked.select("qid", "item", "z", "c.cell", "r.ring", F.explode(F.sequence(F.lit(0), F.col("r.parts") - 1)).alias("part")))
    key = ["z", "cell", "ring", "part"]
    crowds = asked.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select(*key, F.ceil(F.col("n") / hot).cast("int").alias("deals"))
    crowds, deals = small_side(checkpointed(crowds)), F.coalesce("deals", F.lit(1))
    asked = asked.join(crowds, key, "left").withColumn("deal", F.pmod(F.xxhash64("qid", "item"), deals).cast("int")).drop("deals")
    placed = placed.join(crowds, key, "left").withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("deals")
    return asked.join(placed, [*key, "deal"]).select("qid", "sid", divergence(F.col("item"), F.col("sample")).alias("distance"))


def nearest_sample(items: DataFrame, samples: DataFrame, most: float = 1.0, few: int = 1000) -> DataFrame:
    """qid, sid, distance: the sample (sid, item) of least divergence below ``most``, ties (to ``DIGITS`` digits) to the least sid; null without one.

    Up to ``few`` samples are broadcast and compared with every item; of more, an item meets those of ``near_pairs``. Items and samples
    without components, or with one that is null, negative or not finite, are near nothing, as are those of different lengths."""
    items = items.select("qid", "item")
    samples = samples.select("sid", "item").where(_distribution(F.col("item")))
    if samples.limit(few + 1).count() <= few:
        pairs = items.where(_distribution(F.col("item"))).join(F.broadcast(samples.withColumnRenamed("item", "sample")))
        pairs = pairs.withColumn("distance", divergence(F.col("item"), F.col("sample")))
    else:
        pairs = near_pairs(items, samples, most)
    best = pairs.where(F.col("distance") < most).groupBy("qid").agg(F.min(F.struct(F.round("distance", DIGITS), "sid", "distance")).alias("b"))
    return items.select("qid").join(best, "qid", "left").select("qid", "b.sid", "b.distance")


def in_order(needs: DataFrame, start: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``by``, v, tap: 1 - prod(1 - p a(src)) of each vertex that ``needs`` (``by``, src, v, p, ap, earlier) has, where a is the new value of
    an in-neighbour that is ``earlier``, else its ``ap``; ``start`` (``by``, v, tap) is known beforehand. Vertices whose earlier
    in-neighbours are done are done together."""
    both, earlier = checkpointed(needs), F.coalesce("earlier", F.lit(False))
    waits = both.where(earlier).select(*by, "src", "v", "p")
    left = both.groupBy(*by, "v").agg(F.sum(earlier.cast("long")).alias("n"), F.product(F.when(earlier, 1.0).otherwise(1 - F.col("p") * F.col("ap"))).alias("rest"))
    left, new = checkpointed(left), start.select(*by, "v", "tap")
    done = new
    while not left.isEmpty():
        come = waits.join(new.withColumnRenamed("v", "src"), [*by, "src"]).groupBy(*by, "v").agg(F.count(F.lit(1)).alias("m"), F.product(1 - F.col("p") * F.col("tap")).alias("more"))
        step = checkpointed(left.join(come, [*by, "v"], "left").select(*by, "v", (F.col("n") - F.coalesce("m", F.lit(0))).alias("n"), (F.col("rest") * F.coalesce("more", F.lit(1.0))).alias("rest")))
        new, left = step.where("n = 0").select(*by, "v", (1 - F.col("rest")).alias("tap")), step.where("n > 0")
        done = done.unionByName(new)
    return done


def activated(trees: DataFrame, edges: DataFrame, ap: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """s, v, tap: activation of each tree's vertices if its source is one more seed beside those that gave ``ap`` (v, ap).

    One pass in nearest-first order (then fewest hops, then the least vertex): 1 - prod(1 - p(u, v) a(u)) over all in-neighbours,
    with the new activation of those that came earlier in the tree and the old one of all others. ``by``: columns of all three
    tables (items side by side)."""
    place = F.struct(-F.col("p"), "hops", "v")
    at = checkpointed(trees.select(*by, "s", "v", place.alias("place")))
    rest = at.where("s <> v").join(edges.withColumnRenamed("dst", "v"), [*by, "v"])
    both = rest.join(at.select(*by, "s", F.col("v").alias("src"), F.col("place").alias("other")), [*by, "s", "src"], "left")
    both = both.join(ap.select(*by, F.col("v").alias("src"), "ap"), [*by, "src"], "left").select(*by, "s", "src", "v", "p", (F.col("other") < F.col("place")).alias("earlier"), F.coalesce("ap", F.lit(0.0)).alias("ap"))
    return in_order(both, at.where("s = v").select(*by, "s", "v", F.lit(1.0).alias("tap")), (*by, "s"))


def topic_greedies(tedges: DataFrame, items: DataFrame, theta: float) -> DataFrame:
    """qid, rank, vid, gain of the best k seeds for each of ``items`` (qid, item, k), side by side: what a candidate's one-pass
    activation (``activated``) adds to that of the seeds before it, on its best paths past no seed.

    No candidate is left out for want of a bound, but only those are evaluated again whose tree a new seed cuts, or holds a vertex
    whose activation, or that of an in-neighbour, it changed."""
    items = checkpointed(items.select("qid", "item", F.col("k").cast("int").alias("k")))
    n, most = items.count(), items.agg(F.max("k")).first()[0] or 0
    by, item = ("qid",), small_side(items.select("qid", "item"), n)
    edges = checkpointed(tedges.join(item).select("qid", "src", "dst", topic(F.col("w"), F.col("item")).alias("p")).where("p > 0"))
    ends = edges.select("qid", F.explode(F.array("src", "dst")).alias("vid")).distinct()
    trees = closure(edges, theta, ends, by=by)
    spark, kind = edges.sparkSession, dict(items.dtypes)["qid"]
    ap = spark.createDataFrame([], f"qid {kind}, v long, ap double")
    after = spark.createDataFrame([], f"qid {kind}, s long, v long, tap double")
    chosen = spark.createDataFrame([], f"qid {kind}, rank int, vid long, gain double")
    dirty = checkpointed(trees.select("qid", "s").distinct())
    for rank in range(1, most + 1):
        again = activated(trees.join(dirty, ["qid", "s"], "left_semi"), edges, ap, by)
        after = checkpointed(after.join(trees.select("qid", "s").distinct(), ["qid", "s"], "left_semi").join(dirty, ["qid", "s"], "left_anti").unionByName(again))
        scores = after.join(ap, ["qid", "v"], "left").groupBy("qid", F.col("s").alias("vid")).agg(F.sum(F.col("tap") - F.coalesce("ap", F.lit(0.0))).alias("gain"))
        open_ = scores.join(small_side(items.where(F.col("k") >= rank).select("qid"), n), "qid", "left_semi")
        best = open_.groupBy("qid").agg(F.min(F.struct((-F.round("gain", DIGITS)).alias("minus"), "vid", "gain")).alias("b"))
        new = checkpointed(best.select("qid", F.lit(rank).alias("rank"), "b.vid", "b.gain"))
        if not (found := new.count()):
            break
        chosen = checkpointed(chosen.unionByName(new))
        if rank == most:
            break
        seed = small_side(new.select("qid", F.col("vid").alias("seed")), found)
        own = checkpointed(after.join(seed, "qid").where("s = seed").select("qid", "v", F.col("tap").alias("ap")))
        ap = checkpointed(own.unionByName(ap.join(own, ["qid", "v"], "left_anti")))
        stale = checkpointed(trees.join(seed, "qid").where("v = seed").select("qid", "s", (F.col("s") == F.col("seed")).alias("gone")))
        barred = small_side(chosen.select("qid", F.col("vid").alias("v")))
        fresh = closure(edges, theta, stale.where("not gone").select("qid", F.col("s").alias("vid")), barred=barred, by=by)
        trees = checkpointed(trees.join(stale, ["qid", "s"], "left_anti").unionByName(fresh))
        beside = edges.join(own.select("qid", F.col("v").alias("src")), ["qid", "src"], "left_semi").select("qid", F.col("dst").alias("v"))
        changed = own.select("qid", "v").unionByName(beside).distinct()
        dirty = checkpointed(trees.join(changed, ["qid", "v"], "left_semi").select("qid", "s").unionByName(stale.where("not gone").select("qid", "s")).distinct())
    return chosen


def topic_greedy(tedges: DataFrame, item: list[float], k: int, theta: float) -> DataFrame:
    """rank, vid, gain of the best seeds for one item (see ``topic_greedies``)."""
    query = tedges.sparkSession.createDataFrame([(0, item, k)], "qid int, item array<double>, k int")
    return topic_greedies(tedges, query, theta).select("rank", "vid", "gain")


def border(trees: DataFrame) -> DataFrame:
    """The rows of trees (s, v, parent) whose vertex is no other's parent: where paths end for want of probability."""
    return trees.join(trees.where("s <> v").select("s", F.col("parent").alias("v")).distinct(), ["s", "v"], "left_anti")


def exact_gains(edges: DataFrame, theta: float, ap: DataFrame, candidates: DataFrame, seeds: list[int]) -> DataFrame:
    """vid, gain of candidates (vid): what their one-pass activation on paths past no seed adds to ``ap``."""
    after = activated(closure(edges, theta, candidates, avoid=seeds), edges, ap)
    return _added(after, ap).groupBy(F.col("s").alias("vid")).agg(F.sum("add").alias("gain"))


def bounded_gains(edges: DataFrame, theta: float, ap: DataFrame, candidates: DataFrame, seeds: list[int], bounds: DataFrame) -> DataFrame:
    """vid, gain: as ``exact_gains`` at a coarser ``theta``, where each border vertex adds its ``infl2`` (vid, infl2) times its
    increase for what lies behind it."""
    trees = closure(edges, theta, candidates, avoid=seeds)
    added = checkpointed(_added(activated(trees, edges, ap), ap))
    behind = added.join(border(trees).select("s", "v"), ["s", "v"], "left_semi").join(bounds.select(F.col("vid").alias("v"), "infl2"), "v")
    parts = added.select("s", "add").unionByName(behind.select("s", (F.col("add") * F.col("infl2")).alias("add")))
    return parts.groupBy(F.col("s").alias("vid")).agg(F.sum("add").alias("gain"))


def _added(after: DataFrame, ap: DataFrame) -> DataFrame:
    return after.join(ap, "v", "left").select("s", "v", (F.col("tap") - F.coalesce("ap", F.lit(0.0))).alias("add"))


def best_first(tedges: DataFrame, item: list[float], k: int, theta: float, bounds: DataFrame, coarse: float | None = None, batch: int = 64) -> Iterator[tuple[list[tuple[int, float]], DataFrame]]:
    """Lazy greedy for an item: after each round, the seeds so far with their gains, and their activations (v, ap).

    ``bounds`` (vid, infl, infl2): see ``vertex_bounds``. A vertex's score is its ``infl`` at first, and then the last gain that was
    computed. In a round the ``batch`` vertices of the best scores are evaluated, then ``WIDER`` times as many at a time, until no score left
    is above the best gain; with ``coarse``, their ``bounded_gains`` at that theta come first, and only those still above are evaluated exactly.
    Where a one-pass activation exceeds the sum of paths, a vertex whose score is too low is passed over; ``topic_greedy``
    evaluates all."""
    edges = checkpointed(for_item(tedges, item))
    known = vertices(edges)
    scores = checkpointed(bounds.join(known, "vid").select("vid", F.col("infl").alias("score")))
    ap = edges.sparkSession.createDataFrame([], "v long, ap double")
    chosen: list[tuple[int, float]] = []
    while len(chosen) < k:
        seeds, best = [v for v, _ in chosen], None
        stale, size = scores.where(~F.col("vid").isin(seeds)) if seeds else scores, batch
        while True:
            above = stale if best is None else stale.where((F.col("score") > best[1]) | (F.col("score") == best[1]) & (F.col("vid") < best[0]))
            head = checkpointed(above.orderBy(F.desc("score"), "vid").limit(size))
            if not (n := head.count()):
                break
            stale, size = stale.join(small_side(head.select("vid"), n), "vid", "left_anti"), size * WIDER
            if coarse is not None:
                upper = bounded_gains(edges, coarse, ap, head.select("vid"), seeds, bounds)
                head = checkpointed(head.join(upper, "vid").select("vid", F.least("score", "gain").alias("score")))
            live = head if best is None else head.where(F.col("score") >= best[1])
            gains = checkpointed(exact_gains(edges, theta, ap, live.select("vid"), seeds))
            newer = checkpointed(head.join(gains, "vid", "left").select("vid", F.coalesce("gain", "score").alias("new")))
            scores = checkpointed(scores.join(small_side(newer, n), "vid", "left").select("vid", F.coalesce("new", "score").alias("score")))
            found = pick(gains, seeds)
            if found is not None and (best is None or (-found[1], found[0]) < (-best[1], best[0])):
                best = found
        if best is None:
            return
        chosen.append(best)
        after = activated(closure(edges, theta, edges.sparkSession.createDataFrame([(best[0],)], "vid long"), avoid=seeds), edges, ap)
        own = checkpointed(after.select("v", F.col("tap").alias("ap")))
        ap = checkpointed(own.unionByName(ap.join(own, "v", "left_anti")))
        yield list(chosen), ap


def topic_best_first(tedges: DataFrame, item: list[float], k: int, theta: float, bounds: DataFrame, coarse: float | None = None) -> DataFrame:
    """rank, vid, gain of the seeds that ``best_first`` chooses."""
    chosen: list[tuple[int, float]] = []
    for chosen, _ in best_first(tedges, item, k, theta, bounds, coarse):  # noqa: B007
        pass
    return listed(tedges.sparkSession, chosen)


def reach_bounds(tedges: DataFrame, theta: float, sweeps: int = 4) -> DataFrame:
    """s, v, y: for every item (weights of at most 1 in sum), what s alone activates v with at most, in any order of evaluation.

    Under each edge's largest weight, vertices within reach of s (p >= theta) start at 1, s stays there, and ``sweeps`` times all get
    1 - prod(1 - p y) over all in-neighbours within reach. The values fall towards a fixed point from above, so they bound what any
    passes reach from below, however paths meet."""
    edges = checkpointed(tedges.select("src", "dst", strongest_topic(F.col("w")).alias("p")))
    inside = checkpointed(closure(edges, theta, inclusive=True).select("s", "v"))
    into = inside.where("s <> v").join(edges.withColumnRenamed("dst", "v"), "v")
    into = checkpointed(into.join(inside.withColumnRenamed("v", "src"), ["s", "src"], "left_semi"))
    state = inside.withColumn("y", F.lit(1.0))
    for _ in range(sweeps):
        met = into.join(state.select("s", F.col("v").alias("src"), "y"), ["s", "src"]).groupBy("s", "v").agg((1 - F.product(1 - F.col("p") * F.col("y"))).alias("y"))
        state = checkpointed(met.unionByName(inside.where("s = v").withColumn("y", F.lit(1.0))))
    return state


def settled(edges: DataFrame, ap: DataFrame, seeds: list[int], slack: float = 1e-5, rounds: int = 60) -> DataFrame:
    """v, up: activations of at least ``ap`` (v, ap) that no further pass over in-neighbours would raise; seeds have 1, all others a
    little (``slack``) more than where passes lead. What is returned is verified, with more slack if it takes that."""
    start = vertices(edges).withColumnRenamed("vid", "v").join(ap, "v", "left").select("v", F.coalesce("ap", F.lit(0.0)).alias("least"))
    fixed = F.col("v").isin(seeds)

    def passed(state: DataFrame, name: str) -> DataFrame:
        into = edges.join(state.select(F.col("v").alias("src"), F.col(name).alias("a")), "src").groupBy(F.col("dst").alias("v")).agg((1 - F.product(1 - F.col("p") * F.col("a"))).alias("come"))
        return state.join(into, "v", "left").withColumn("come", F.when(fixed, 1.0).otherwise(F.coalesce("come", F.lit(0.0))))

    now = checkpointed(start.select("v", "least", F.col("least").alias("up")))
    for _ in range(rounds):
        step = checkpointed(passed(now, "up").select("v", "least", F.greatest("least", "come", "up").alias("next"), "up"))
        rise = step.agg(F.max(F.col("next") - F.col("up"))).first()[0] or 0.0
        now = step.select("v", "least", F.col("next").alias("up"))
        if rise < slack / 100:
            break
    while slack < 1:
        held = checkpointed(passed(now.select("v", F.least(F.lit(1.0), F.col("up") + F.when(fixed, 0.0).otherwise(slack)).alias("up")), "up"))
        if held.where("come > up").isEmpty():
            return held.select("v", "up")
        slack *= 10
    return now.select("v", F.lit(1.0).alias("up"))


def gain_bounds(reach: DataFrame, ap: DataFrame, up: DataFrame | None) -> DataFrame:
    """vid, bound: what no gain beside ``ap`` exceeds: sum of (up - ap) + (1 - up) y over what s may reach (``reach_bounds``, ``settled``)."""
    if up is None:  # no seed yet
        return reach.groupBy(F.col("s").alias("vid")).agg(F.sum("y").alias("bound"))
    both = checkpointed(up.join(ap, "v", "left").select("v", "up", F.least("up", F.coalesce("ap", F.lit(0.0))).alias("ap")))
    met = reach.join(both, "v")
    return met.groupBy(F.col("s").alias("vid")).agg(F.sum((F.col("up") - F.col("ap")) + (1 - F.col("up")) * F.col("y")).alias("bound"))


def topic_lazy(tedges: DataFrame, item: list[float], k: int, theta: float, reach: DataFrame, batch: int = 64) -> DataFrame:
    """rank, vid, gain: the seeds of ``topic_greedy``, evaluating few candidates: the ``batch`` of the largest ``gain_bounds`` first, then ``WIDER``
    times as many at a time, until no bound left is above the best gain. ``reach``: built in advance by ``reach_bounds``, for all items."""
    edges = checkpointed(for_item(tedges, item))
    spark, near = edges.sparkSession, 10.0**-DIGITS
    reach = reach.join(small_side(checkpointed(vertices(edges).withColumnRenamed("vid", "s"))), "s", "left_semi")
    ap = spark.createDataFrame([], "v long, ap double")
    chosen: list[tuple[int, float]] = []
    while len(chosen) < k:
        seeds, best = [v for v, _ in chosen], None
        bounds = gain_bounds(reach, ap, settled(edges, ap, seeds) if seeds else None)
        left, size = checkpointed(bounds.where(~F.col("vid").isin(seeds)) if seeds else bounds), batch
        while True:
            above = left if best is None else left.where(F.col("bound") >= best[1] - near)
            head = checkpointed(above.orderBy(F.desc("bound"), "vid").limit(size))
            if not (n := head.count()):
                break
            left, size = left.join(small_side(head.select("vid"), n), "vid", "left_anti"), size * WIDER
            gains = exact_gains(edges, theta, ap, head.select("vid"), seeds)
            found = gains.select("vid", F.round("gain", DIGITS).alias("rounded"), "gain").orderBy(F.desc("rounded"), "vid").limit(1).collect()
            if found and (best is None or (-found[0].rounded, found[0].vid) < (-round(best[1], DIGITS), best[0])):
                best = found[0].vid, found[0].gain
        if best is None:
            break
        chosen.append(best)
        if len(chosen) < k:
            own = activated(closure(edges, theta, spark.createDataFrame([(best[0],)], "vid long"), avoid=seeds), edges, ap)
            own = checkpointed(own.select("v", F.col("tap").alias("ap")))
            ap = checkpointed(own.unionByName(ap.join(own, "v", "left_anti")))
    return listed(spark, chosen)


def sweep(edges: DataFrame, now: DataFrame, fixed: DataFrame, ascending: bool) -> DataFrame:
    """v, now: every vertex but ``fixed`` (v) gets 1 - prod(1 - p a(src)) over its in-neighbours, one after the other by id, each with the
    values that those before it have got. Done in levels: as many as the longest path of falling (rising) ids has edges."""
    free = now.join(fixed, "v", "left_anti")
    before = (F.col("src") < F.col("v")) if ascending else (F.col("src") > F.col("v"))
    into = edges.select("src", F.col("dst").alias("v"), "p").join(free.select("v"), "v")
    into = into.join(now.select(F.col("v").alias("src"), F.col("now").alias("ap")), "src")
    into = into.join(fixed.select(F.col("v").alias("src"), F.lit(True).alias("held")), "src", "left")
    needs = into.select("src", "v", "p", "ap", (before & F.col("held").isNull()).alias("earlier"))
    none = free.join(edges.select(F.col("dst").alias("v")), "v", "left_anti").select("v", F.lit(0.0).alias("tap"))  # no in-neighbours
    done = in_order(needs, none, ())
    return done.select("v", F.col("tap").alias("now")).unionByName(now.join(fixed, "v", "left_semi").select("v", "now"))


def set_gain(edges: DataFrame, ap: DataFrame, candidates: list[int], taken: list[int] = ()) -> float:
    """What a set of candidates adds to ``ap`` (v, ap) at least: they are active, as are the seeds ``taken``, and all other vertices are
    activated anew in two ``sweep``s, by descending and then by ascending id."""
    spark = edges.sparkSession
    edges = checkpointed(edges.select("src", "dst", "p"))
    active = spark.createDataFrame([(v,) for v in {*candidates, *taken}], "v long")
    every = vertices(edges).withColumnRenamed("vid", "v").union(active).distinct()
    state = checkpointed(every.join(ap, "v", "left").join(F.broadcast(active.withColumn("on", F.lit(True))), "v", "left").select("v", F.coalesce("ap", F.lit(0.0)).alias("ap"), "on"))
    now = state.select("v", F.when(F.col("on"), 1.0).otherwise(F.col("ap")).alias("now"))
    now = checkpointed(sweep(edges, now, active, ascending=False))
    now = checkpointed(sweep(edges, now, active, ascending=True))
    return now.join(state, "v").agg(F.sum(F.col("now") - F.col("ap"))).first()[0] or 0.0


def topic_approximate(tedges: DataFrame, item: list[float], k: int, theta: float, bounds: DataFrame, upper: DataFrame, lower: DataFrame, epsilon: float, coarse: float | None = None) -> DataFrame:
    """rank, vid, gain: seeds of the nearest ``lower`` sample (sid, item, seeds), with null gains, once they are shown to be good
    enough; until then seeds of ``best_first``.

    Every k / 10 rounds (each one for a small k), the gains so far and the ``set_gain`` of the sample's seeds left are held
    against ``epsilon`` times the bound of the nearest ``upper`` sample (sid, item, ub). A seed that is chosen goes from the sample's,
    else the sample's last does."""
    spark = tedges.sparkSession
    query = spark.createDataFrame([(0, item)], "qid long, item array<double>")

    def nearest(samples: DataFrame, value: str):
        row = nearest_sample(query, samples.select("sid", "item"), float("inf")).join(samples.select("sid", value), "sid").select(value).first()
        return row[0] if row is not None else None

    left, most = list(nearest(lower, "seeds") or [])[:k], nearest(upper, "ub")
    edges, step = checkpointed(for_item(tedges, item)), max(1, k // 10)
    chosen, ap = [], spark.createDataFrame([], "v long, ap double")
    rounds = best_first(tedges, item, k, theta, bounds, coarse)
    while len(chosen) < k:
        if left and most is not None and (len(chosen) + 1) % step == 0:
            free = [v for v in left if v not in {v for v, _ in chosen}]
            if sum(g for _, g in chosen) + set_gain(edges, ap, free, [v for v, _ in chosen]) > epsilon * most:
                rows = [(i, v, g) for i, (v, g) in enumerate([*chosen, *((v, None) for v in left)][:k], 1)]
                return spark.createDataFrame(rows, "rank int, vid long, gain double")
        if (found := next(rounds, None)) is None:
            break
        chosen, ap = found
        left = [v for v in left if v != chosen[-1][0]] if chosen[-1][0] in left else left[:-1]
    return listed(spark, chosen)


def _samples(tedges: DataFrame, items: dict[int, list[float]], k: int) -> DataFrame:
    return tedges.sparkSession.createDataFrame([(sid, item, k) for sid, item in items.items()], "qid long, item array<double>, k int")


def sample_seeds(tedges: DataFrame, items: dict[int, list[float]], k: int, theta: float) -> DataFrame:
    """qid (the sample's number), rank, vid, gain: the seeds that upper and lower samples are made of."""
    return topic_greedies(tedges, _samples(tedges, items, k), theta)


def upper_samples(tedges: DataFrame, items: dict[int, list[float]], k: int, theta: float, factor: float = 1.0, ranked: DataFrame | None = None) -> DataFrame:
    """sid, ub, item: ``factor`` times the sum of gains of each sample item's seeds; all samples are selected for side by side.
    ``ranked``: the samples' ``sample_seeds``, if they are there already."""
    samples = _samples(tedges, items, k)
    sums = (sample_seeds(tedges, items, k, theta) if ranked is None else ranked).groupBy("qid").agg((F.sum("gain") * factor).alias("ub"))
    return samples.join(sums, "qid", "left").select(F.col("qid").alias("sid"), F.coalesce("ub", F.lit(0.0)).alias("ub"), "item")


def lower_samples(tedges: DataFrame, items: dict[int, list[float]], k: int, theta: float, ranked: DataFrame | None = None) -> DataFrame:
    """sid, item, seeds: each sample item's seeds in rank order; all samples are selected for side by side. ``ranked``: see ``upper_samples``."""
    samples = _samples(tedges, items, k)
    ranked = (sample_seeds(tedges, items, k, theta) if ranked is None else ranked).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "vid"))).alias("r"))  # k of each
    seeds = F.transform("r", lambda r: r["vid"])
    return samples.join(ranked, "qid", "left").select(F.col("qid").alias("sid"), "item", F.coalesce(seeds, F.array().cast("array<long>")).alias("seeds"))


def topic_spread(tedges: DataFrame, item: list[float], seeds: DataFrame, runs: int = 1000) -> DataFrame:
    """One row, spread: Monte Carlo over the graph of an item."""
    return monte_carlo(for_item(tedges, item), seeds, runs)


def clusters(items: DataFrame, k: int, seed: int = 0, rounds: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(qid, cluster) of items; (cluster, top, total): each cluster's largest weight by topic, and their sum; (cluster, centre)."""
    ready = items.withColumn("features", array_to_vector("item"))
    model = KMeans(k=k, seed=seed, maxIter=rounds, predictionCol="cluster").fit(ready)
    found = model.transform(ready)
    centres = items.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.clusterCenters())], "cluster int, centre array<double>")
    return found.select("qid", "cluster"), _peaks(found), centres


def _peaks(found: DataFrame) -> DataFrame:
    """cluster, top, total: each cluster's largest weight by topic, and their sum, of items with their cluster."""
    peaks = found.select("cluster", F.posexplode("item").alias("z", "w")).groupBy("cluster", "z").agg(F.max("w").alias("w"))
    return peaks.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("z", "w"))), lambda x: x["w"]).alias("top"), F.sum("w").alias("total"))


def nearest_centre(centres: Column) -> Column:
    """distance (squared), cluster of an item's nearest of an array of centres; ties to the first."""
    apart = lambda c: F.aggregate(F.zip_with("item", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return F.array_min(F.transform(centres, lambda c, i: F.struct(apart(c).alias("distance"), i.alias("cluster"))))


def restarted_clusters(items: DataFrame, k: int, runs: int = 10, rounds: int = 20, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """As ``clusters``, and the sum of squared distances, of the best of ``runs`` k-means that go on side by side.

    A run starts from k different items by hash. A round is one pass over the items, each beside the centres of all runs, and sums by
    run and cluster; centres (runs x k) are all that reaches the driver. Clusters that lose all items keep their centre. Ties go
    to the first run; fewer than ``k`` different items give as many clusters."""
    spark = items.sparkSession
    items = checkpointed(items.select("qid", "item"))
    start = items.select("item").distinct().orderBy(F.xxhash64(F.lit(seed), "item"), "item").limit(runs * k).collect()
    if not start:
        none = spark.createDataFrame([], "cluster int, top array<double>, total double")
        return items.select("qid", F.lit(0).alias("cluster")).limit(0), none, spark.createDataFrame([], "cluster int, centre array<double>"), 0.0
    n = min(k, len(start))
    state = {r: [list(start[(r * n + i) % len(start)].item) for i in range(n)] for r in range(runs)}
    cost: dict[int, float] = {}
    for _ in range(rounds + 1):
        table = F.broadcast(spark.createDataFrame(list(state.items()), "run int, centres array<array<double>>"))  # a row for each run
        placed = items.join(table).select("run", "item", nearest_centre(F.col("centres")).alias("near"))
        mean = F.array(*[F.avg(F.get("item", F.lit(z))) for z in range(len(start[0].item))])
        found = placed.groupBy("run", "near.cluster").agg(mean.alias("centre"), F.sum("near.distance").alias("cost")).collect()
        cost = {r: sum(f.cost for f in found if f.run == r) for r in state}
        moved = {r: list(c) for r, c in state.items()}
        for f in found:
            moved[f.run][f.cluster] = f.centre
        if moved == state or len(cost) < len(state):
            break
        last, state = state, moved
    else:
        state = last  # the costs are those of these centres
    best = min(cost, key=lambda r: (cost[r], r))
    centres = spark.createDataFrame(list(enumerate(state[best])), "cluster int, centre array<double>")
    chosen = F.broadcast(spark.createDataFrame([(state[best],)], "centres array<array<double>>"))
    assigned = items.join(chosen).select("qid", "item", nearest_centre(F.col("centres"))["cluster"].alias("cluster"))
    return assigned.select("qid", "cluster"), _peaks(assigned), centres, cost[best]
