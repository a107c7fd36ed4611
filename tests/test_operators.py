import itertools
import random

import pytest
from pyspark.sql import functions as F

from seedspread import queries, sources
from seedspread.operators import graph, paths, selection, spatial, spread, topics, trees


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, p double")


def random_graph(seed, n=8, m=16):
    rng = random.Random(seed)
    found = {}
    while len(found) < m:
        u, v = rng.sample(range(n), 2)
        found[u, v] = rng.choice([0.2, 0.4, 0.5, 0.8])
    return [(u, v, p) for (u, v), p in sorted(found.items())]


def best_paths(rows, theta):
    best = {(v, v): 1.0 for u, w, _ in rows for v in (u, w)}
    while True:
        new = dict(best)
        for (s, u), p in best.items():
            for a, b, q in rows:
                if a == u and p * q > theta and p * q > new.get((s, b), 0):
                    new[s, b] = p * q
        if new == best:
            return best
        best = new


@pytest.mark.parametrize("seed", [0, 1])
def test_closure_matches_brute_force(spark, seed):
    rows = random_graph(seed)
    got = {(r.s, r.v): r for r in paths.closure(edges(spark, rows), 0.05).collect()}
    want = best_paths(rows, 0.05)
    assert got.keys() == want.keys()
    of = {(u, v): p for u, v, p in rows}
    for (s, v), r in got.items():
        assert r.p == pytest.approx(want[s, v])
        if r.hops:
            assert of[r.parent, v] == r.edge_p and got[s, r.parent].p * r.edge_p == pytest.approx(r.p)
            assert got[s, r.parent].hops == r.hops - 1


def test_closure_cases(spark):
    loop = edges(spark, [(1, 2, 1.0), (2, 1, 1.0), (2, 3, 0.0), (1, 4, 0.5), (1, 4, 0.5)])
    assert {(r.s, r.v, r.p) for r in paths.closure(loop, 0.1).collect()} == {(1, 1, 1.0), (2, 2, 1.0), (4, 4, 1.0), (1, 2, 1.0), (2, 1, 1.0), (1, 4, 0.5), (2, 4, 0.5)}
    assert paths.closure(loop, 0.5).where("v = 4 and s = 1").count() == 0
    assert paths.closure(loop, 0.5, inclusive=True).where("v = 4 and s = 1").count() == 1
    assert paths.closure(loop, 0.1, avoid=[1]).where("s = 2").count() == 1
    assert paths.closure(loop, 0.1, stop=[1]).where("s = 2").count() == 2
    assert paths.closure(loop.limit(0), 0.1).count() == 0


def tree_activation(rows, root, seeds):
    """ap and alpha on a tree of (node, parent, p)."""
    children = {}
    for v, parent, p in rows:
        children.setdefault(parent, []).append((v, p))

    def ap(x):
        if x in seeds:
            return 1.0
        rest = 1.0
        for c, p in children.get(x, []):
            rest *= 1 - ap(c) * p
        return 1 - rest

    out, todo = {}, [(root, 1.0)]
    while todo:
        x, alpha = todo.pop()
        out[x] = ap(x), alpha
        for c, p in children.get(x, []):
            others = 1.0
            for y, q in children[x]:
                others *= 1 - ap(y) * q if y != c else 1.0
            todo.append((c, 0.0 if x in seeds else alpha * p * others))
    return out


def test_activation_matches_recursion(spark):
    rows = [(2, 1, 1.0), (3, 1, 0.5), (4, 2, 0.5), (5, 2, 0.25), (6, 3, 1.0), (7, 3, 0.5)]
    depth = {1: 0, 2: 1, 3: 1, 4: 2, 5: 2, 6: 2, 7: 2}
    prob = {1: 1.0}
    for v, parent, p in rows:
        prob[v] = prob[parent] * p
    tree = spark.createDataFrame([(1, 1, 1.0, 0, 1, 1.0)] + [(1, v, prob[v], depth[v], parent, p) for v, parent, p in rows], "s long, v long, p double, hops int, parent long, edge_p double")
    for seeds in ([], [4], [6, 5], [2], [1], [4, 6, 7]):
        got = {r.v: (r.ap, r.alpha) for r in trees.activation(tree, seeds).collect()}
        levels = {r.v: (r.ap, r.alpha) for r in trees.activation(tree, seeds, tree_rows=1).collect()}
        want = tree_activation(rows, 1, set(seeds))
        assert got.keys() == want.keys()
        for v, pair in want.items():
            assert got[v] == pytest.approx(pair), (seeds, v)
            assert levels[v] == pytest.approx(pair), (seeds, v)


def test_seeds_on_a_star_and_submodular_gains(spark):
    star = edges(spark, [(1, v, 0.5) for v in range(2, 8)] + [(9, v, 0.4) for v in range(2, 5)])
    for choose in (selection.mia, selection.pmia):
        found = choose(star, 3, 0.05).collect()
        assert [r.vid for r in found][:1] == [1] and found[0].gain == pytest.approx(4.0)
        assert [r.gain for r in found] == sorted((r.gain for r in found), reverse=True)
        assert found[1].vid == 9 and found[1].gain == pytest.approx(1 + 3 * 0.5 * 0.4)
    assert selection.mia(star, 99, 0.05).count() == 8


def test_bounds_hold_the_exact_gain(spark):
    rows = random_graph(3)
    e = edges(spark, rows)
    mip = paths.closure(e, 0.05)
    first = selection.mia(e, 1, 0.05).first()
    back = paths.closure(paths.reverse(e), 0.05)
    state = trees.activation(back, [first.vid])
    exact = {r.vid: r.gain for r in trees.gains(state).collect()}
    ap = state.where("s = v").select("v", "ap")
    upper = {r.vid: r.gain for r in selection.upper_gains(mip, ap).collect()}
    lower = {r.vid: r.gain for r in selection.lower_gains(mip, ap).collect()}
    for v in exact:
        if v != first.vid:
            assert lower[v] - 1e-9 <= upper[v] and exact[v] <= upper[v] + 1e-9


def test_components_and_statistics(spark):
    e = edges(spark, [(i, i + 1, 0.5) for i in range(1, 30)] + [(100, 50, 0.5)])
    found = {r.vid: r.component for r in graph.components(e).collect()}
    assert all(found[v] == 1 for v in range(1, 31)) and found[100] == found[50] == 50
    row = graph.statistics(e).first()
    assert (row.n, row.m, row.components, row.largest_component) == (32, 30, 2, 30)


def test_pagerank_runs_to_its_fixed_point(spark):
    rows = [(v, v + 1, 0.5) for v in range(1, 9)] + [(9, 1, 0.5), (9, 4, 0.25), (2, 7, 0.75)]
    total = {}
    for _, v, p in rows:
        total[v] = total.get(v, 0.0) + p
    want = dict.fromkeys(range(1, 10), 1.0)
    for _ in range(2000):
        want = {v: 0.15 + 0.85 * sum(want[b] * p / total[b] for a, b, p in rows if a == v) for v in want}
    e = edges(spark, rows)
    got = {r.vid: r.rank for r in graph.pagerank(e).collect()}
    assert got == pytest.approx(want, abs=0.01)
    five = {r.vid: r.rank for r in graph.pagerank(e, tolerance=-1.0, rounds=5).collect()}
    assert max(abs(five[v] - want[v]) for v in want) > 0.05
    best = sorted(want, key=lambda v: (-want[v], v))[:3]
    assert [r.vid for r in selection.by_pagerank(e, 3).orderBy("rank").collect()] == best
    assert {"pagerank_ranks", "pagerank_seeds", "claimed_bound", "seed_overlap"} <= set(queries.QUERIES)


def test_claims_and_overlap(spark):
    mip = spark.createDataFrame([(1, 5, 0.2), (1, 6, 0.5), (2, 5, 0.9), (2, 7, 0.3), (3, 8, 1.0)], "s long, v long, p double")
    ranked = spark.createDataFrame([(1, 1), (2, 2)], "rank int, vid long")
    assert selection.claimed(mip, ranked).first().bound == pytest.approx(0.2 + 0.5 + 0.3)
    other = spark.createDataFrame([(1, 2), (2, 9), (3, 4)], "rank int, vid long")
    assert selection.overlap(ranked, other).first().accuracy == 0.5


def test_spread(spark):
    sure = edges(spark, [(1, 2, 1.0), (2, 3, 1.0), (3, 4, 0.0)])
    seed = spark.createDataFrame([(1,)], "vid long")
    assert spread.monte_carlo(sure, seed, 5).first().spread == 3.0
    assert spread.monte_carlo(sure, seed, 5, spark.createDataFrame([(3,), (9,)], "vid long")).first().spread == 1.0
    half = edges(spark, [(1, v, 0.5) for v in range(2, 402)])
    assert abs(spread.monte_carlo(half, seed, 20).first().spread - 201) < 10
    diamond = edges(spark, [(1, 2, 0.5), (1, 3, 0.5), (2, 4, 0.5), (3, 4, 0.5)])
    assert {r.vid: r.p for r in spread.shortest_path_model(diamond, seed).collect()} == {1: 1.0, 2: 0.5, 3: 0.5, 4: 1 - 0.75**2}
    ranked = spark.createDataFrame([(1, 1), (2, 9)], "rank int, vid long")
    assert [r.spread for r in spread.curve(sure, ranked, 2).orderBy("rank").collect()] == [3.0, 4.0]


def test_celf_agrees_with_plain_greedy(spark):
    rows = [(1, 2, 1.0), (2, 3, 1.0), (4, 5, 1.0), (6, 5, 1.0)]
    e = edges(spark, rows)
    shortlist = selection.first_gains(paths.closure(e, 0.01))
    value = lambda s: spread.monte_carlo(e, s, 1).first().spread
    found = [(r.vid, r.gain) for r in selection.celf(e, 3, value, shortlist).orderBy("rank").collect()]
    assert found == [(1, 3.0), (4, 2.0), (6, 1.0)]


def test_boxes(spark):
    users = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.5, 0.5), (3, 0.51, 0.0), (4, -0.5, 0.2)], "user_id long, x double, y double")
    assert sorted(r.vid for r in spatial.natives(users, 0.0, 0.0, 0.5, 0.5).collect()) == [1, 2, 4]
    boxes = spark.createDataFrame([(7, 0.0, 0.0, 0.5, 0.5, 2), (8, 5.0, 5.0, 0.1, 0.1, 1), (9, 0.0, 0.0, 9.0, 9.0, 9)], "qid long, cx double, cy double, hx double, hy double, k int")
    found = spatial.natives_of(users, boxes)
    assert sorted((r.qid, r.vid) for r in found.collect()) == [(7, 1), (7, 2), (7, 4), (9, 1), (9, 2), (9, 3), (9, 4)]
    assert [r.qid for r in spatial.admitted(found, boxes).collect()] == [7]
    one = spark.range(1)
    box = lambda *v: tuple(map(F.lit, v))
    row = one.select(spatial.boxes_meet(box(0, 0, 1, 1), box(2, 0, 1, 1)), spatial.boxes_meet(box(0, 0, 1, 1), box(1.9, 0, 1, 1)), spatial.box_holds(box(0, 0, 1, 1), box(0, 0, 1, 1)), spatial.box_holds(box(0, 0, 1, 1), box(0, 0, 0.5, 0.5))).first()
    assert list(row) == [False, True, False, True]


def test_quadtree_keeps_each_user_once(spark):
    rng = random.Random(5)
    users = spark.createDataFrame([(i, rng.uniform(-1, 1), rng.uniform(-1, 1)) for i in range(200)], "user_id long, x double, y double")
    found = spatial.quadtree(users, capacity=4).collect()
    assert sorted(r.user_id for r in found) == list(range(200))
    assert all(len(list(g)) <= 4 for _, g in itertools.groupby(sorted(r.path for r in found)))
    assert sorted(r.user_id for r in found if r.path == "") == [0, 1, 2, 3]


def test_quadtree_keeps_all_users_of_one_point(spark):
    users = spark.createDataFrame([(i, 0.3, 0.3) for i in range(60)] + [(99, -0.5, 0.5)], "user_id long, x double, y double")
    found = spatial.quadtree(users, capacity=2, deepest=3).collect()
    assert sorted(r.user_id for r in found) == [*range(60), 99]
    assert sorted(r.user_id for r in found if r.path == "NESWNE") == list(range(6, 60)) and max(len(r.path) for r in found) == 6
    assert sorted((r.user_id, r.path) for r in spatial.quadtree(users, capacity=2, deepest=0).collect()) == [(i, "") for i in [*range(60), 99]]


def test_topics(spark):
    te = spark.createDataFrame([(1, 2, [0.5, 0.5]), (2, 1, [0.0, 0.9]), (2, 3, [2.0, 0.0])], "src long, dst long, w array<double>")
    assert {(r.src, r.dst): r.p for r in topics.for_item(te, [1.0, 0.0]).collect()} == {(1, 2): 0.5, (2, 3): 1.0}
    items = spark.createDataFrame([(1, [0.5, 0.5]), (2, [1.0, 0.0])], "qid long, item array<double>")
    samples = spark.createDataFrame([(5, [0.5, 0.5]), (4, [0.5, 0.5])], "sid long, item array<double>")
    assert {r.qid: r.sid for r in topics.nearest_sample(items, samples).collect()} == {1: 4, 2: 4}
    assert topics.nearest_sample(items, spark.createDataFrame([(1, [0.0, 1.0])], "sid long, item array<double>")).where("sid is not null").count() == 0


def test_text_sources(spark, tmp_path):
    (tmp_path / "g.inf").write_text("3 2\n0 1 0.5 0.25\n1 0 0.25 0.5\n1 2 0.1 0\n2 1 0 0.1\n")
    found = {(r.src, r.dst): r.p for r in sources.influence_graph(spark, str(tmp_path / "g.inf")).collect()}
    assert found == {(0, 1): 0.5, (1, 0): 0.25, (1, 2): 0.1}
    (tmp_path / "l.loc").write_text("2\n1 3.0 4.0\n2 5.0 6.0\n")
    assert {(r.user_id, r.x, r.y) for r in sources.locations_file(spark, str(tmp_path / "l.loc")).collect()} == {(1, 4.0, 3.0), (2, 6.0, 5.0)}
    (tmp_path / "t.tedge").write_text("2 2\n0 1 0.5 0.25\n1 2 0.1 0\n")
    assert sources.topic_graph(spark, str(tmp_path / "t.tedge"), 2).count() == 2


def nearest(rows, source, theta, seeds):
    """Best paths past no seed: vertex -> (p, vertices from the source), nearest first."""
    found, heap = {}, [(-1.0, 0, source, (source,))]
    while heap:
        p, hops, v, path = min(heap)
        heap.remove((p, hops, v, path))
        if v in found:
            continue
        found[v] = -p, path
        heap += [(p * q, hops + 1, b, (*path, b)) for a, b, q in rows if a == v and b not in seeds and -p * q > theta]
    return found


def expansion_by_hand(rows, k, theta, natives):
    of = {(u, v): p for u, v, p in rows}
    stored, ap, chosen = {t: {} for t in natives}, dict.fromkeys(natives, 0.0), []

    def merged(t, path):
        return stored[t] | dict(zip(path, path[1:], strict=False))

    def reached(t, after, seeds):
        def of_vertex(x):
            if x in seeds:
                return 1.0
            rest = 1.0
            for y, at in after.items():
                rest *= 1 - of_vertex(y) * of[y, x] if at == x else 1.0
            return 1 - rest

        return of_vertex(t)

    for _ in range(k):
        seeds, gains = [v for v, _ in chosen], {}
        for s in sorted({x for u, v, _ in rows for x in (u, v)} - set(seeds)):
            found = nearest(rows, s, theta, seeds)
            gains[s] = sum(reached(t, merged(t, found[t][1]), [*seeds, s]) - ap[t] for t in natives if t in found)
        new = min(gains, key=lambda s: (-round(gains[s], 12), s))
        for t, (_, path) in nearest(rows, new, theta, seeds).items():
            if t in natives:
                stored[t] = merged(t, path)
                ap[t] = reached(t, stored[t], [*seeds, new])
        chosen.append((new, gains[new]))
    return chosen


def topic_by_hand(rows, k, theta):
    everyone = sorted({x for u, v, _ in rows for x in (u, v)})
    ap, chosen = dict.fromkeys(everyone, 0.0), []
    for _ in range(k):
        seeds, best = [v for v, _ in chosen], None
        for s in everyone:
            if s in seeds:
                continue
            now = ap | {s: 1.0}
            for v in nearest(rows, s, theta, seeds):
                if v != s:
                    rest = 1.0
                    for a, b, q in rows:
                        rest *= 1 - q * now[a] if b == v else 1.0
                    now[v] = 1 - rest
            gain = sum(now.values()) - sum(ap.values())
            if best is None or gain > best[0] + 1e-12:
                best = gain, s, now
        chosen.append((best[1], best[0]))
        ap = best[2]
    return chosen


def untied_graph(seed, n=9, m=22):
    rng = random.Random(seed)
    return [(u, v, round(p * rng.uniform(0.9, 1.0), 9)) for u, v, p in random_graph(seed, n, m)]


@pytest.mark.parametrize("seed", [4, 7])
def test_expansion_matches_brute_force(spark, seed):
    rows, natives = untied_graph(seed), [0, 2, 3, 5, 8]
    got = selection.expansion(edges(spark, rows), 4, 0.05, spark.createDataFrame([(v,) for v in natives], "vid long")).orderBy("rank").collect()
    want = expansion_by_hand(rows, 4, 0.05, natives)
    assert [r.vid for r in got] == [v for v, _ in want] and [r.gain for r in got] == pytest.approx([g for _, g in want])


def test_expansion_goes_round_chosen_seeds(spark):
    # once 2 is a seed, 1 goes round it, by a way that is not in the trees of all best paths
    rows = [(9, 2, 0.1), (1, 2, 0.95)] + [e for i in range(10, 16) for e in ((2, i, 0.6), (1, i + 10, 0.95), (i + 10, i, 0.55))]
    natives = spark.createDataFrame([(v,) for v in range(10, 16)], "vid long")
    got = selection.expansion(edges(spark, rows), 2, 0.05, natives).orderBy("rank").collect()
    assert [(r.vid, round(r.gain, 6)) for r in got] == [(2, 3.6), (1, 1.254)]
    assert [r.vid for r in selection.expansion(edges(spark, [(1, 2, 0.5)]), 3, 0.05, natives.where("vid = 10").union(spark.createDataFrame([(2,)], "vid long"))).orderBy("rank").collect()] == [2, 10, 1]


@pytest.mark.parametrize("seed", [4, 7])
def test_topic_greedy_matches_brute_force(spark, seed):
    rows = untied_graph(seed)
    te = spark.createDataFrame([(u, v, [p, 0.0]) for u, v, p in rows], "src long, dst long, w array<double>")
    got = topics.topic_greedy(te, [1.0, 0.0], 4, 0.1).orderBy("rank").collect()
    want = topic_by_hand(rows, 4, 0.1)
    assert [r.vid for r in got] == [v for v, _ in want] and [r.gain for r in got] == pytest.approx([g for _, g in want])
