"""Selection for many queries at once against one at a time, and what is evaluated again."""

import random

import pytest
from test_operators import edges, expansion_by_hand, topic_by_hand, untied_graph

from seedspread import sources
from seedspread.operators import batch, paths, selection, spread, topics, trees


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    out = run()
    spark.sparkContext.setJobGroup("other", "other")
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_many_queries_equal_single_ones(spark):
    rows, rng = untied_graph(4), random.Random(1)
    spec = {q: (sorted(rng.sample(range(9), rng.randint(1, 7))), rng.randint(0, 4), rng.choice([0.05, 0.2])) for q in range(100)}
    queries = spark.createDataFrame([(q, k, theta) for q, (_, k, theta) in spec.items()], "qid long, k int, theta double")
    natives = spark.createDataFrame([(q, v) for q, (own, _, _) in spec.items() for v in own], "qid long, vid long")
    got, many = jobs(spark, "many", lambda: batch.expansions(edges(spark, rows), queries, natives).collect())
    _, one = jobs(spark, "one", lambda: batch.expansions(edges(spark, rows), queries.where("k = 4").limit(1), natives).collect())
    assert many < 1.5 * one
    for q, (own, k, theta) in spec.items():
        found = [(v, g) for _, v, g in sorted((r["rank"], r.vid, r.gain) for r in got if r.qid == q)]
        want = [(v, g) for v, g in expansion_by_hand(rows, k, theta, own) if g > 1e-9]  # who reaches no native at first is no candidate
        assert [(v, pytest.approx(g)) for v, g in want] == found[: len(want)]
        assert all(abs(g) < 1e-9 for _, g in found[len(want) :])


def test_only_what_a_seed_changes_is_evaluated_again(spark):
    rows = [(10 * c, 10 * c + i, 0.5) for c in range(12) for i in range(1, 8)] + [(10 * c + 1, 10 * c + 2, 0.9) for c in range(12)]
    query = spark.createDataFrame([("q", 6)], "qid string, k int")
    natives = spark.createDataFrame([("q", v) for _, v, _ in rows], "qid string, vid long").distinct()
    counts = [(r.rescored.count(), r.chosen.count()) for r in batch.rounds(edges(spark, rows), query, natives, 0.01)]
    whole = counts[0][0]
    assert [n for _, n in counts] == list(range(7))
    assert all(0 < n <= whole / 10 for n, _ in counts[1:-1])  # one of twelve clusters


def test_root_activation_equals_recursion():
    rng = random.Random(2)
    for _ in range(300):
        parent = {v: rng.randrange(v) for v in range(1, 9)}
        p = {v: rng.random() for v in parent}
        sure = set(rng.sample(range(1, 9), 3))
        start = rng.choice([v for v in range(1, 9)])
        path = [start]
        while path[-1]:
            path.append(parent[path[-1]])

        def of(x):
            if x in sure or x == start:
                return 1.0
            rest = 1.0
            for y, at in parent.items():
                rest *= 1 - of(y) * p[y] if at == x else 1.0
            return 1 - rest

        old = dict(parent)
        for v in path[1:-1]:
            old[v] = 0  # replaced by the path
        tree = [{"v": v, "next": n, "p": p[v] if n == parent[v] else 0.5, "sure": v in sure} for v, n in old.items()]
        if not sure & set(path[1:]):
            assert batch.root_activation(0, path, [p[v] for v in path[:-1]], tree) == pytest.approx(of(0))
    assert batch.root_activation(5, [5], [], []) == 1.0


def test_empty_queries(spark):
    e = edges(spark, [(1, 2, 0.5)])
    none = spark.createDataFrame([], "qid long, k int")
    assert batch.expansions(e, none, spark.createDataFrame([], "qid long, vid long"), 0.1).count() == 0
    some = spark.createDataFrame([(1, 3), (2, 0), (3, 2)], "qid long, k int")
    natives = spark.createDataFrame([(1, 2), (2, 2), (3, 99)], "qid long, vid long")
    got = sorted(tuple(r) for r in batch.expansions(e, some, natives, 0.1).collect())
    assert got == [(1, 1, 2, 1.0), (1, 2, 1, 0.0), (3, 1, 99, 1.0)]


def test_regions_and_thetas_side_by_side(spark):
    rows = untied_graph(7)
    placed = spark.createDataFrame([(0, "a"), (2, "a"), (3, "b"), (5, None), (8, None)], "vid long, rid string")
    got = {(r.rid, r.pos): (r.vid, r.gain) for r in selection.region_seeds(edges(spark, rows), 0.05, placed, 2).collect()}
    for rid, own in {"a": [0, 2], "b": [3], "fringe": [5, 8]}.items():
        want = expansion_by_hand(rows, min(2, len(own)), 0.05, own)
        assert [got.pop((rid, i)) for i in range(1, len(want) + 1)] == [(v, pytest.approx(g)) for v, g in want]
    assert not got
    swept = selection.swept(edges(spark, rows), 2, (5, 30)).collect()
    everyone = sorted({x for u, v, _ in rows for x in (u, v)})
    for bound in (5, 10, 20):
        assert sorted((r["rank"], r.vid, r.gain) for r in swept if r.bound == bound) == [(i, v, pytest.approx(g)) for i, (v, g) in enumerate(expansion_by_hand(rows, 2, 1 / bound, everyone), 1)]


def test_items_side_by_side(spark):
    rows = untied_graph(7)
    rng = random.Random(3)
    te = [(u, v, [p, round(p * rng.random(), 6)]) for u, v, p in rows]
    frame = spark.createDataFrame(te, "src long, dst long, w array<double>")
    items = {4: ([1.0, 0.0], 3), 9: ([0.5, 0.5], 2), 1: ([0.2, 0.8], 4)}
    got = topics.topic_greedies(frame, spark.createDataFrame([(q, i, k) for q, (i, k) in items.items()], "qid long, item array<double>, k int"), 0.1).collect()
    for q, (item, k) in items.items():
        graph = [(u, v, sum(a * b for a, b in zip(w, item, strict=True))) for u, v, w in te]
        want = topic_by_hand(graph, k, 0.1)
        assert sorted((r["rank"], r.vid, r.gain) for r in got if r.qid == q) == [(i, v, pytest.approx(g)) for i, (v, g) in enumerate(want, 1)]
    upper = {r.sid: r.ub for r in topics.upper_samples(frame, {7: [0.5, 0.5], 8: [1.0, 0.0]}, 2, 0.1, factor=1.5).collect()}
    assert upper == {s: pytest.approx(1.5 * sum(g for _, g in topic_by_hand([(u, v, sum(a * b for a, b in zip(w, i, strict=True))) for u, v, w in te], 2, 0.1))) for s, i in ((7, [0.5, 0.5]), (8, [1.0, 0.0]))}


def test_lazy_greedy_equals_plain_greedy(spark):
    e = edges(spark, untied_graph(4))
    value = lambda seeds: spread.monte_carlo(e, spark.createDataFrame([(v,) for v in seeds], "vid long"), 8).first().spread
    chosen, base = [], 0.0
    for _ in range(2):
        gain = {v: value([*chosen, v]) - base for v in range(9) if v not in chosen}
        chosen.append(min(gain, key=lambda v: (-round(gain[v], 9), v)))
        base += gain[chosen[-1]]
    for size in (1, 100):
        got = spread.lazy_greedy(e, 2, 8, paths.vertices(e), size).orderBy("rank").collect()
        assert [r.vid for r in got] == chosen and sum(r.gain for r in got) == pytest.approx(base)
    assert spread.lazy_greedy(e, 2, 8, paths.vertices(e).limit(0)).count() == 0


def test_compat_root(spark):
    """A root's ap loses ap (1 - ap) once more, and its children's alpha takes the rest as that of their siblings."""
    rows = [(1, 0, 0.5), (2, 0, 0.4), (3, 1, 0.5), (4, 2, 0.9)]
    state = {(r.s, r.v): (r.ap, r.alpha) for r in trees.activation(paths.closure(paths.reverse(edges(spark, rows)), 0.01), [4], compat_root=True).collect()}
    plain = 0.9 * 0.4
    ap = plain * (1 - plain)
    assert state[0, 0] == (pytest.approx(ap), 1.0)
    assert state[0, 1][1] == pytest.approx(0.5 * (1 - ap)) and state[0, 2][1] == pytest.approx(0.4 * (1 - ap) / (1 - 0.9 * 0.4))
    assert state[0, 3][1] == pytest.approx(0.5 * 0.5 * (1 - ap))


def test_short_vectors_have_no_place(spark, tmp_path):
    spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5]), (3, []), (4, None)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.user_id: (r.x, r.y) for r in sources.locations(spark, str(tmp_path)).collect()}
    assert got == {1: (0.5, 0.25), 2: (0.5, None), 3: (None, None), 4: (None, None)}


@pytest.mark.parametrize("seed", [4, 11])
def test_topic_bounds_hold_and_lazy_order_is_exact(spark, seed):
    rng = random.Random(seed)
    te = [(u, v, [round(p, 6), round(p * rng.random(), 6)]) for u, v, p in untied_graph(seed, n=12, m=34)]
    frame, item = selection.checkpointed(spark.createDataFrame(te, "src long, dst long, w array<double>")), [0.7, 0.3]
    reach = topics.reach_bounds(frame, 0.1)
    want = [(r.vid, pytest.approx(r.gain)) for r in topics.topic_greedy(frame, item, 3, 0.1).orderBy("rank").collect()]
    assert [(r.vid, r.gain) for r in topics.topic_lazy(frame, item, 3, 0.1, reach, batch=2).orderBy("rank").collect()] == want
    e = selection.checkpointed(topics.for_item(frame, item))
    ap, seeds = spark.createDataFrame([], "v long, ap double"), []
    for vid, _ in want[:2]:
        own = topics.activated(paths.closure(e, 0.1, spark.createDataFrame([(vid,)], "vid long"), avoid=seeds), e, ap).select("v", "tap").collect()
        known = {r.v: r.ap for r in ap.collect()} | {r.v: r.tap for r in own}
        ap, seeds = spark.createDataFrame(list(known.items()), "v long, ap double"), [*seeds, vid]
        exact = {r.vid: r.gain for r in topics.exact_gains(e, 0.1, ap, paths.vertices(e), seeds).collect() if r.vid not in seeds}
        bound = {r.vid: r.bound for r in topics.gain_bounds(reach, ap, topics.settled(e, ap, seeds)).collect()}
        assert all(bound[v] >= g - 1e-9 for v, g in exact.items()) and len(exact) > 5


def test_restarted_clusters(spark):
    rng = random.Random(5)
    rows = [(i, [c + rng.uniform(-0.05, 0.05), 1 - c]) for i, c in enumerate([0.1, 0.5, 0.9] * 12)] + [(99, [0.1, 0.9]), (98, [0.1, 0.9])]
    items = spark.createDataFrame(rows, "qid long, item array<double>")
    cost_of = lambda item, centre: sum((a - b) ** 2 for a, b in zip(item, centre, strict=True))
    best = None
    for runs in (1, 6):
        assigned, tops, centres, cost = topics.restarted_clusters(items, 3, runs)
        where = {r.cluster: r.centre for r in centres.collect()}
        got = {r.qid: r.cluster for r in assigned.collect()}
        assert len(got) == len(rows) and all(got[q] == min(where, key=lambda c: (cost_of(v, where[c]), c)) for q, v in rows)
        assert cost == pytest.approx(sum(cost_of(v, where[got[q]]) for q, v in rows))
        assert best is None or cost <= best + 1e-9
        best = cost
        for r in tops.collect():
            own = [v for q, v in rows if got[q] == r.cluster]
            assert r.top == [max(v[z] for v in own) for z in (0, 1)] and r.total == pytest.approx(sum(r.top))
    assert best < 0.1  # three groups apart
    for c, centre in where.items():  # centres are means
        own = [v for q, v in rows if got[q] == c]
        assert centre == pytest.approx([sum(v[z] for v in own) / len(own) for z in (0, 1)])
    assert topics.restarted_clusters(items.limit(0), 3)[0].count() == 0
    assert topics.restarted_clusters(items.limit(1), 3)[2].count() == 1
