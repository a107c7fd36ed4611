"""Rectangles, their users, and a quadtree of regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedspread.session import checkpointed, small_side

QUADRANTS = ("NW", "NE", "SW", "SE")


def in_box(x: Column, y: Column, cx: Column, cy: Column, hx: Column, hy: Column) -> Column:
    """Whether a point is in a box given by centre and half sizes; borders count."""
    return x.between(cx - hx, cx + hx) & y.between(cy - hy, cy + hy)


def boxes_meet(a: tuple, b: tuple) -> Column:
    """Whether two boxes (cx, cy, hx, hy) overlap; touching borders don't count."""
    return (F.abs(a[0] - b[0]) < a[2] + b[2]) & (F.abs(a[1] - b[1]) < a[3] + b[3])


def box_holds(a: tuple, b: tuple) -> Column:
    """Whether box ``a`` strictly contains box ``b``."""
    return (b[0] + b[2] < a[0] + a[2]) & (b[0] - b[2] > a[0] - a[2]) & (b[1] + b[3] < a[1] + a[3]) & (b[1] - b[3] > a[1] - a[3])


def natives(users: DataFrame, cx: float, cy: float, hx: float, hy: float) -> DataFrame:
    """Users (user_id, x, y) in one rectangle; the comparison reaches the scan."""
    return users.where(in_box(F.col("x"), F.col("y"), *map(F.lit, (cx, cy, hx, hy)))).select(F.col("user_id").alias("vid"))


def native_locations(users: DataFrame, cx: float, cy: float, hx: float, hy: float) -> DataFrame:
    """vid, x, y of the users in one rectangle."""
    return users.where(in_box(F.col("x"), F.col("y"), *map(F.lit, (cx, cy, hx, hy)))).select(F.col("user_id").alias("vid"), "x", "y")


def within(users: DataFrame, cx: float = 0.0, cy: float = 0.0, hx: float = 1.0, hy: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(users inside the world's box, users outside it or without a place)."""
    inside = F.coalesce(in_box(F.col("x"), F.col("y"), *map(F.lit, (cx, cy, hx, hy))), F.lit(False))
    return users.where(inside), users.where(~inside)


def natives_of(users: DataFrame, queries: DataFrame, most: int = 100_000, hot: int = 1_000_000) -> DataFrame:
    """qid, vid for many rectangles (qid, cx, cy, hx, hy).

    Rectangles are classed by size, in powers of two, and each class has cells as wide as its largest: a rectangle touches at
    most 3 x 3 of its class, and a world-sized one doesn't widen the cells of small ones. A user meets the rectangles of
    their own cell of each class only. Up to ``most`` rectangles are broadcast, so no cell is a hot key. Beyond, both sides are
    shuffled by cell; the users of a cell with more than ``hot`` of them are dealt into parts, and its rectangles go to each."""
    queries = checkpointed(queries)
    few = queries.limit(most + 1).count() <= most
    size = F.greatest("hx", "hy", F.lit(1e-300))
    level = F.ceil(F.log2(size * 2)).cast("int")
    cell = lambda c, level: F.floor(c / F.pow(F.lit(2.0), level)).cast("long")
    sides = {f"i{c}": F.explode(F.sequence(cell(F.col(f"c{c}") - F.col(f"h{c}"), F.col("level")), cell(F.col(f"c{c}") + F.col(f"h{c}"), F.col("level")))) for c in "xy"}
    spread = queries.withColumn("level", level)
    levels = sorted(r.level for r in spread.select("level").distinct().collect())
    if not levels:
        return queries.select("qid").join(users.select(F.col("user_id").alias("vid")).limit(0))
    for name, values in sides.items():
        spread = spread.withColumn(name, values)
    placed = users.select("user_id", "x", "y", F.explode(F.array(*map(F.lit, levels))).alias("level"))
    placed = placed.withColumns({f"i{c}": cell(F.col(c), F.col("level")) for c in "xy"})
    key = ["level", "ix", "iy"]
    if few:
        spread = F.broadcast(spread)
    else:
        crowded = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot)
        crowded = small_side(checkpointed(crowded.select(*key, F.ceil(F.col("n") / hot).cast("int").alias("parts"))))
        parts = F.coalesce("parts", F.lit(1))
        placed = placed.join(crowded, key, "left").withColumn("part", F.pmod(F.xxhash64("user_id"), parts).cast("int")).drop("parts")
        spread = spread.join(crowded, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        key = [*key, "part"]
    inside = in_box(*[F.col(c) for c in ("x", "y", "cx", "cy", "hx", "hy")])
    return placed.join(spread, key).where(inside).select("qid", F.col("user_id").alias("vid"))


def admitted(found: DataFrame, queries: DataFrame, ratio: int = 1, most: int = 5000) -> DataFrame:
    """The queries whose k is at most ``most`` and at most natives / ``ratio``."""
    counts = found.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    return queries.join(counts, "qid").where((F.col("k") <= most) & (F.col("k") * ratio <= F.col("n"))).drop("n")


def quadtree(users: DataFrame, cx: float = 0.0, cy: float = 0.0, hx: float = 1.0, hy: float = 1.0, capacity: int = 4, deepest: int = 20) -> DataFrame:
    """user_id, path: a node keeps its first ``capacity`` users by id, others go on to the first quadrant, NW NE SW SE, whose closed box
    holds them.

    A leaf at depth ``deepest`` keeps all users that come to it, however many share its point or its cell. Rows of a repeated id are
    users of their own."""
    inside = in_box(F.col("x"), F.col("y"), *map(F.lit, (cx, cy, hx, hy)))
    here = users.where(inside).select(F.monotonically_increasing_id().alias("row"), "user_id", "x", "y", F.lit("").alias("path"), *[F.lit(float(v)).alias(n) for n, v in (("cx", cx), ("cy", cy), ("hx", hx), ("hy", hy))])
    here, kept = checkpointed(here), None
    for _ in range(deepest):
        # a limit on the rank is applied before the shuffle, so a cell with all users is not sorted in one task
        first = here.withColumn("rank", F.row_number().over(Window.partitionBy("path").orderBy("user_id", "x", "y", "row"))).where(F.col("rank") <= capacity)
        stay = checkpointed(first.select("row", "user_id", "path"))
        kept = stay.drop("row") if kept is None else kept.unionByName(stay.drop("row"))
        rest = here.join(stay.select("row"), "row", "left_anti")
        east, north = F.col("x") > F.col("cx"), F.col("y") >= F.col("cy")
        name = F.when(north, F.when(east, F.lit("NE")).otherwise(F.lit("NW"))).otherwise(F.when(east, F.lit("SE")).otherwise(F.lit("SW")))
        here = rest.select(
            "row", "user_id", "x", "y", F.concat("path", name).alias("path"),
            (F.col("cx") + F.when(east, F.col("hx") / 2).otherwise(-F.col("hx") / 2)).alias("cx"),
            (F.col("cy") + F.when(north, F.col("hy") / 2).otherwise(-F.col("hy") / 2)).alias("cy"),
            (F.col("hx") / 2).alias("hx"), (F.col("hy") / 2).alias("hy"),
        )
        here = checkpointed(here)
        if here.isEmpty():
            return kept
    last = here.select("user_id", "path")
    return last if kept is None else kept.unionByName(last)


def region_box(path: Column, world: tuple[float, float, float, float] = (0.0, 0.0, 1.0, 1.0)) -> tuple[Column, Column, Column, Column]:
    """Centre and half sizes of the quadtree's cell at ``path``."""
    depth = (F.length(path) / 2).cast("int")
    steps = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))

    def centre(at: float, half: float, letter: int, plus: str) -> Column:
        side = lambda i: F.when(F.substr(path, 2 * i - letter, F.lit(1)) == plus, 1.0).otherwise(-1.0)
        return F.aggregate(steps, F.lit(float(at)), lambda c, i: c + side(i) * half / F.pow(F.lit(2.0), i))

    cx, cy, hx, hy = world
    shrink = F.pow(F.lit(2.0), depth)
    return centre(cx, hx, 0, "E"), centre(cy, hy, 1, "N"), hx / shrink, hy / shrink


def regions(placed: DataFrame, world: tuple[float, float, float, float] = (0.0, 0.0, 1.0, 1.0)) -> DataFrame:
    """path, depth, cx, cy, hx, hy, own, users of the nodes of a quadtree (user_id, path): users kept there, and there or below."""
    ends = placed.groupBy("path").agg(F.count(F.lit(1)).alias("own"))
    ups = F.transform(F.sequence(F.lit(0), (F.length("path") / 2).cast("int")), lambda i: F.substr(F.col("path"), F.lit(1), 2 * i))
    all_ = ends.select(F.explode(ups).alias("node"), F.when(F.col("node") == F.col("path"), F.col("own")).otherwise(0).alias("own"), F.col("own").alias("users"))
    found = all_.groupBy(F.col("node").alias("path")).agg(F.sum("own").alias("own"), F.sum("users").alias("users"))
    box = dict(zip(("cx", "cy", "hx", "hy"), region_box(F.col("path"), world), strict=True))
    return found.select("path", (F.length("path") / 2).cast("int").alias("depth"), *[c.alias(n) for n, c in box.items()], "own", "users")


def covered(tree: DataFrame, cx: float, cy: float, hx: float, hy: float, world: tuple[float, float, float, float] = (0.0, 0.0, 1.0, 1.0)) -> DataFrame:
    """The largest ``regions`` that a rectangle strictly contains: those whose parent it doesn't contain."""
    query = tuple(map(F.lit, (cx, cy, hx, hy)))
    parent = region_box(F.substr(F.col("path"), F.lit(1), F.length("path") - 2), world)
    own = box_holds(query, tuple(map(F.col, ("cx", "cy", "hx", "hy"))))
    return tree.where(own & ((F.col("depth") == 0) | ~box_holds(query, parent)))


def below(placed: DataFrame, path: str) -> DataFrame:
    """The users (user_id, path) of a node and of all nodes below it."""
    return placed.where(F.col("path").startswith(path))


def native_regions(placed: DataFrame, users: DataFrame, box: tuple[float, float, float, float], world: tuple[float, float, float, float] = (0.0, 0.0, 1.0, 1.0)) -> DataFrame:
    """vid, rid of a rectangle's users: the covered region that a user is in, or null for the fringe, users of no such region."""
    inside = users.where(in_box(F.col("x"), F.col("y"), *map(F.lit, box))).select("user_id")
    own = placed.join(inside, "user_id")
    found = covered(regions(placed, world), *box, world).select(F.col("path").alias("rid"))
    ups = F.transform(F.sequence(F.lit(0), (F.length("path") / 2).cast("int")), lambda i: F.substr(F.col("path"), F.lit(1), 2 * i))
    hit = own.select("user_id", F.explode(ups).alias("rid")).join(found, "rid")
    return own.join(hit, "user_id", "left").select(F.col("user_id").alias("vid"), "rid")
