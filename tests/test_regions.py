"""Quadtree regions, lists of regions, assembly and hints against plain Python."""

import random

import pytest

from seedspread.operators import paths, selection, spatial

BOX = (0.1, 0.0, 0.7, 0.8)
THETA = 0.05


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(4)
    found = {tuple(rng.sample(range(14), 2)): round(rng.uniform(0.2, 0.9), 6) for _ in range(30)}
    return spark.createDataFrame([(u, v, p) for (u, v), p in found.items()], "src long, dst long, p double")


@pytest.fixture(scope="module")
def points():
    rng = random.Random(5)
    return {i: (rng.uniform(-0.95, 0.95), rng.uniform(-0.95, 0.95)) for i in range(14)} | {20: (0.0, 0.3), 21: (0.0, -0.3)}


def by_hand(points, capacity):
    """Users' nodes by inserting them one after the other: the first capacity stay, others go to the first closed child."""
    kept, paths_ = {}, {}
    for user, (x, y) in sorted(points.items()):
        path, cx, cy, h = "", 0.0, 0.0, 1.0
        while kept.get(path, 0) >= capacity:
            west, north = x <= cx, y >= cy
            path, h = path + ("N" if north else "S") + ("W" if west else "E"), h / 2
            cx, cy = cx + (-h if west else h), cy + (h if north else -h)
        kept[path] = kept.get(path, 0) + 1
        paths_[user] = path
    return paths_


def box_of(path):
    cx, cy, h = 0.0, 0.0, 1.0
    for i in range(0, len(path), 2):
        h /= 2
        cx, cy = cx + (h if path[i + 1] == "E" else -h), cy + (h if path[i] == "N" else -h)
    return cx, cy, h


def held(box, path):
    cx, cy, h = box_of(path)
    return cx + h < box[0] + box[2] and cx - h > box[0] - box[2] and cy + h < box[1] + box[3] and cy - h > box[1] - box[3]


@pytest.fixture(scope="module")
def placed(spark, points):
    users = spark.createDataFrame([(i, x, y) for i, (x, y) in points.items()], "user_id long, x double, y double")
    return users, selection.checkpointed(spatial.quadtree(users, capacity=2))


def test_quadtree_and_regions(points, placed):
    users, tree = placed
    want = by_hand(points, 2)
    assert {r.user_id: r.path for r in tree.collect()} == want
    nodes = {p[:i] for p in want.values() for i in range(0, len(p) + 1, 2)}
    got = {r.path: r for r in spatial.regions(tree).collect()}
    assert got.keys() == nodes
    for path, r in got.items():
        assert (r.cx, r.cy, r.hx, r.hy) == pytest.approx((*box_of(path), box_of(path)[2]))
        assert (r.own, r.users, r.depth) == (sum(p == path for p in want.values()), sum(p.startswith(path) for p in want.values()), len(path) // 2)
    assert {r.user_id for r in spatial.below(tree, "NE").collect()} == {i for i, p in want.items() if p.startswith("NE")}
    maximal = {p for p in nodes if held(BOX, p) and not held(BOX, p[:-2])}
    assert {r.path for r in spatial.covered(spatial.regions(tree), *BOX).collect()} == maximal
    split = {r.vid: r.rid for r in spatial.native_regions(tree, users, BOX).collect()}
    inside = {i for i, (x, y) in points.items() if abs(x - BOX[0]) <= BOX[2] and abs(y - BOX[1]) <= BOX[3]}
    assert split == {i: next((m for m in maximal if want[i].startswith(m)), None) for i in inside} and any(split.values())
    assert {(r.vid, r.x, r.y) for r in spatial.native_locations(users, *BOX).collect()} == {(i, *points[i]) for i in inside}
    ins, out = spatial.within(users, *BOX)
    assert {r.user_id for r in ins.collect()} == inside and ins.count() + out.count() == len(points)


@pytest.fixture(scope="module")
def lists(spark, graph, placed):
    users, tree = placed
    own = selection.checkpointed(spatial.native_regions(tree, users, BOX))
    return own, selection.checkpointed(selection.region_lists(paths.closure(graph, THETA), own))


def test_lists_and_their_merge(lists):
    _, found = lists
    rows = found.collect()
    for rid in {r.rid for r in rows}:
        own = sorted((r for r in rows if r.rid == rid), key=lambda r: r.rank)
        assert [(-r.dp, r.vid) for r in own] == sorted((-r.dp, r.vid) for r in own) and own[-1].rank == len(own)
    total = {v: sum(r.dp for r in rows if r.vid == v) for v in {r.vid for r in rows}}
    want = sorted(total, key=lambda v: (-total[v], v))[:3]
    for depth in (1, 8):
        got = selection.merged_top(found, 3, depth).orderBy("rank").collect()
        assert [r.vid for r in got] == want and [r.gain for r in got] == pytest.approx([total[v] for v in want])
    assert selection.leading(found, 1).count() == len({r.rid for r in rows}) and selection.leading(found, -1).count() == len(rows)


def test_assembly_and_hints(graph, lists):
    own, found = lists
    plain = [(r.vid, pytest.approx(r.gain)) for r in selection.expansion(graph, 3, THETA, own.select("vid")).orderBy("rank").collect()]
    assert [(r.vid, r.gain) for r in selection.assembly(graph, 3, THETA, own, found).orderBy("rank").collect()] == plain
    ready = selection.checkpointed(selection.region_seeds(graph, THETA, own, 2))
    hints, lower = selection.merged_hints(ready, 3)
    hints = [r.vid for r in hints.orderBy("rank").collect()]
    whole = sum(r.gain for r in selection.expansion(graph, 3, THETA, own.select("vid")).collect())
    assert len(set(hints)) == 3 and 0 < lower
    assert [r.vid for r in selection.hinted(graph, 3, THETA, own, found, ready, 0.0).orderBy("rank").collect()] == hints
    assert [(r.vid, r.gain) for r in selection.hinted(graph, 3, THETA, own, found, ready, 1e9).orderBy("rank").collect()] == plain
    early = selection.hinted_by_bounds(graph, 3, THETA, own, found, 0.0).orderBy("rank").collect()
    assert [(r.vid, r.gain) for r in early[:2]] == plain[:2] and len({r.vid for r in early}) == 3 and sum(r.gain for r in early) >= whole - 1e-9


def test_merged_hints_by_hand(spark):
    ready = spark.createDataFrame(
        [("a", 1, 7, 5.0), ("a", 2, 8, 3.0), ("a", 3, 9, 4.0), ("b", 1, 8, 4.5), ("b", 2, 7, 1.0), ("b", 3, 6, 0.5)], "rid string, pos int, vid long, gain double"
    )
    hints, total = selection.merged_hints(ready, 3)
    assert [r.vid for r in hints.orderBy("rank").collect()] == [7, 8, 9] and total == 5.0 + 4.5 + 3.0 + 4.0
    assert selection.merged_hints(ready.limit(0), 3)[1] == 0.0


def test_many_rectangles_of_all_sizes(spark, points, placed):
    rng = random.Random(1)
    boxes = [(i, rng.uniform(-1, 1), rng.uniform(-1, 1), h, h * rng.uniform(0.2, 1), 1) for i, h in enumerate([1.0, 0.5, 0.3, 0.1, 0.01, 0.0, 5.0])]
    got = {(r.qid, r.vid) for r in spatial.natives_of(placed[0], spark.createDataFrame(boxes, "qid long, cx double, cy double, hx double, hy double, k int")).collect()}
    assert got == {(q, i) for q, cx, cy, hx, hy, _ in boxes for i, (x, y) in points.items() if cx - hx <= x <= cx + hx and cy - hy <= y <= cy + hy}


def test_equal_sums_below_the_depth(spark):
    lists = [("a", v, dp, i) for i, (v, dp) in enumerate([(100, 0.9), (20, 0.5), (50, 0.5)], 1)] + [("b", v, dp, i) for i, (v, dp) in enumerate([(7, 0.6), (30, 0.5), (50, 0.5), (100, 0.1)], 1)]
    found = spark.createDataFrame(lists, "rid string, vid long, dp double, rank int")
    assert {selection.merged_top(found, 1, depth).first().vid for depth in (1, 2, 8)} == {50}


def test_users_of_a_repeated_id(spark):
    users = spark.createDataFrame([(1, 0.1, 0.1), (1, -0.5, -0.5), (2, 0.3, 0.3), (3, None, None)], "user_id long, x double, y double")
    assert sorted((r.user_id, r.path) for r in spatial.quadtree(users, capacity=1).collect()) == [(1, ""), (1, "NE"), (2, "NESW")]


def test_rectangles_beyond_a_broadcast(spark):
    rng = random.Random(8)
    users = [(i, rng.choice([0.3, rng.uniform(-1, 1)]), rng.choice([0.3, rng.uniform(-1, 1)])) for i in range(200)] + [(500, None, 0.0)]
    boxes = [(q, rng.uniform(-1, 1), rng.uniform(-1, 1), rng.choice([0.0, 0.01, 0.2, 2.0]), rng.choice([0.05, 0.4])) for q in range(60)] + [(99, 0.3, 0.3, 0.0, 0.0)]
    want = {(q, i) for q, cx, cy, hx, hy in boxes for i, x, y in users if x is not None and cx - hx <= x <= cx + hx and cy - hy <= y <= cy + hy}
    frames = spark.createDataFrame(users, "user_id long, x double, y double"), spark.createDataFrame(boxes, "qid long, cx double, cy double, hx double, hy double")
    for most, hot in ((1000, 10), (5, 7), (5, 1000)):
        got = [(r.qid, r.vid) for r in spatial.natives_of(*frames, most=most, hot=hot).collect()]
        assert sorted(got) == sorted(want)
