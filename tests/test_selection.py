"""Topic selection, models of spread, files and PMIA against plain Python."""

import random

import pytest

from seedspread import sinks, sources
from seedspread.operators import paths, selection, spread, topics, trees


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, p double")


def random_graph(seed, n=9, m=20):
    rng = random.Random(seed)
    found = {tuple(rng.sample(range(n), 2)): round(rng.uniform(0.2, 0.9), 6) for _ in range(m)}
    return [(u, v, p) for (u, v), p in sorted(found.items())]


def tree_into(rows, root, theta, stop=(), barred=()):
    """Best paths into ``root``: vertex -> (p, next vertex, edge p); paths don't go on past ``stop`` and avoid ``barred``."""
    found, heap = {}, [(-1.0, root, None, 1.0)]
    while heap:
        heap.sort()
        p, v, after, q = heap.pop(0)
        if v in found:
            continue
        found[v] = -p, after, q
        if v in stop and v != root:
            continue
        heap += [(p * e, a, v, e) for a, b, e in rows if b == v and a not in found and a not in barred and -p * e > theta]
    return found


def activation(tree, x, seeds):
    if x in seeds:
        return 1.0
    rest = 1.0
    for y, (_, after, q) in tree.items():
        if after == x:
            rest *= 1 - activation(tree, y, seeds) * q
    return 1 - rest


def greedy(vertices, trees_of, k):
    """(seed, gain) by what a vertex adds to the roots' activation in trees that ``trees_of`` gives for the seeds so far."""
    chosen = []
    for _ in range(k):
        seeds = [v for v, _ in chosen]
        trees = {r: t for r, t in trees_of(seeds).items() if r not in seeds}
        gain = {u: sum(activation(t, r, {*seeds, u}) - activation(t, r, set(seeds)) for r, t in trees.items() if u in t) for u in vertices if u not in seeds}
        best = min(gain, key=lambda u: (-round(gain[u], 9), u))
        chosen.append((best, gain[best]))
    return chosen


@pytest.mark.parametrize("seed", [2, 5])
def test_mia_and_pmia_match_brute_force(spark, seed):
    rows, theta = random_graph(seed), 0.05
    vertices = sorted({v for a, b, _ in rows for v in (a, b)})
    frozen = {r: tree_into(rows, r, theta) for r in vertices}
    want = greedy(vertices, lambda _: frozen, 3)
    held = trees.seed_counts(paths.closure(paths.reverse(edges(spark, rows)), theta), [0, 1]).collect()
    assert {r.s: r.n for r in held} == {r: sum(v in t for v in (0, 1)) for r, t in frozen.items()}
    got = [(r.vid, r.gain) for r in selection.mia(edges(spark, rows), 3, theta).orderBy("rank").collect()]
    assert [v for v, _ in got] == [v for v, _ in want] and [g for _, g in got] == pytest.approx([g for _, g in want])

    valid = {r: set() for r in vertices}  # seeds that count in a root's tree
    state = {"seen": [], "trees": dict(frozen)}

    def blocked(seeds):
        for n, new in enumerate(seeds):
            if n < len(state["seen"]):
                continue
            earlier = seeds[:n]
            reach, queue = {new: 1.0}, [new]
            for u in queue:
                for a, b, p in rows:
                    if a == u and b not in earlier and reach[u] * p > max(theta, reach.get(b, 0)):
                        reach[b] = reach[u] * p
                        queue.append(b)
            for r in reach:
                for j in [j for j in valid[r] if j in state["trees"][r]]:
                    at = state["trees"][r][j][1]
                    while at is not None and at != r:
                        if at == new:
                            valid[r].discard(j)
                        at = state["trees"][r][at][1]
                valid[r].add(new)
                bars = {s for s in [*earlier, new] if s not in valid[r] and s != r}
                state["trees"][r] = tree_into(rows, r, theta, {*earlier, new}, bars)
            state["seen"].append(new)
        return state["trees"]

    want = greedy(vertices, blocked, 3)
    got = [(r.vid, r.gain) for r in selection.pmia(edges(spark, rows), 3, theta).orderBy("rank").collect()]
    assert [v for v, _ in got] == [v for v, _ in want] and [g for _, g in got] == pytest.approx([g for _, g in want])


@pytest.fixture(scope="module")
def topic_forest(spark):
    """Two levels of out-trees: no vertex has two in-edges, so sums of paths bound every gain."""
    rng, rows = random.Random(3), []
    for v in range(1, 16):
        rows.append((rng.randrange(max(1, v // 2)), v, [round(rng.uniform(0.1, 0.9), 3), round(rng.uniform(0.1, 0.9), 3)]))
    return spark.createDataFrame(rows, "src long, dst long, w array<double>")


def test_lazy_topic_selection_agrees_where_bounds_hold(spark, topic_forest):
    item, theta = [0.6, 0.4], 0.02
    bounds = selection.checkpointed(topics.vertex_bounds(topic_forest, theta, 0.2))
    want = [(r.vid, pytest.approx(r.gain)) for r in topics.topic_greedy(topic_forest, item, 2, theta).orderBy("rank").collect()]
    assert [(r.vid, r.gain) for r in topics.topic_best_first(topic_forest, item, 2, theta, bounds).orderBy("rank").collect()] == want
    found = topics.topic_best_first(topic_forest, item, 2, theta, bounds, coarse=theta / 0.2)
    assert [(r.vid, r.gain) for r in found.orderBy("rank").collect()] == want
    e, none = topics.for_item(topic_forest, item), spark.createDataFrame([], "v long, ap double")
    some = paths.vertices(e)
    exact = {r.vid: r.gain for r in topics.exact_gains(e, theta, none, some, []).collect()}
    upper = {r.vid: r.gain for r in topics.bounded_gains(e, theta / 0.2, none, some, [], bounds).collect()}
    assert exact.keys() == upper.keys() and all(upper[v] >= exact[v] - 1e-9 for v in exact)
    tree = paths.closure(e, theta)
    rows = tree.collect()
    ends = {(r.s, r.v) for r in rows} - {(r.s, r.parent) for r in rows if r.s != r.v}
    assert {(r.s, r.v) for r in topics.border(tree).collect()} == ends


def test_approximate_topic_selection(spark, topic_forest):
    item, theta = [0.6, 0.4], 0.02
    bounds = selection.checkpointed(topics.vertex_bounds(topic_forest, theta, 0.2))
    upper = topics.upper_samples(topic_forest, {1: [0.5, 0.5], 2: [0.9, 0.1]}, 2, theta)
    lower = topics.lower_samples(topic_forest, {1: [0.5, 0.5], 2: [0.9, 0.1]}, 2, theta)
    sample = lower.where("sid = 1").first().seeds
    assert upper.where("sid = 1").first().ub == pytest.approx(sum(r.gain for r in topics.topic_greedy(topic_forest, [0.5, 0.5], 2, theta).collect()))
    run = lambda epsilon: topics.topic_approximate(topic_forest, item, 2, theta, bounds, upper, lower, epsilon).orderBy("rank").collect()
    assert [(r.vid, r.gain) for r in run(0.0)] == [(v, None) for v in sample]
    assert [r.vid for r in run(1e9)] == [r.vid for r in topics.topic_best_first(topic_forest, item, 2, theta, bounds).orderBy("rank").collect()]


@pytest.mark.parametrize("taken", [[], [6]])
def test_gain_of_a_set(spark, taken):
    """Two sweeps in order of ids, down and up, one vertex after the other."""
    rows = random_graph(7)
    ap = {v: (0.3 if v % 2 else 0.0) for v in range(9)} | dict.fromkeys(taken, 1.0)
    active = {0, 4, *taken}
    now = {v: 1.0 if v in active else a for v, a in ap.items()}
    for order in (sorted(now, reverse=True), sorted(now)):
        for v in order:
            if v not in active:
                now[v] = 1 - _product(1 - p * now[a] for a, b, p in rows if b == v)
    known = spark.createDataFrame([(v, a) for v, a in ap.items() if a], "v long, ap double")
    assert topics.set_gain(edges(spark, rows), known, [0, 4], taken) == pytest.approx(sum(now[v] - ap[v] for v in now))


def _product(values):
    out = 1.0
    for v in values:
        out *= v
    return out


def test_shortest_path_models(spark):
    rows, seeds = random_graph(9), [0, 3]
    ring, p, late = dict.fromkeys(seeds, 0), dict.fromkeys(seeds, 1.0), dict.fromkeys(seeds, 0.0)
    depth = 0
    while any(r == depth for r in ring.values()):
        depth += 1
        fresh = {b for a, b, _ in rows if ring.get(a) == depth - 1} - ring.keys()
        for v in fresh:
            p[v] = 1 - _product(1 - q * p[a] for a, b, q in rows if b == v and ring.get(a) == depth - 1)
        ring |= dict.fromkeys(fresh, depth)
        for v in fresh:
            given = [q * p[a] for a, b, q in rows if b == v and a in fresh] + [q * late[a] for a, b, q in rows if b == v and ring.get(a) == depth - 1]
            late[v] = (1 - p[v]) * (1 - _product(1 - x for x in given))
    got = {r.vid: (r.ring, r.p, r.late) for r in spread.shortest_path_plus_one_model(edges(spark, rows), spark.createDataFrame([(s,) for s in seeds], "vid long")).collect()}
    assert got == {v: (ring[v], pytest.approx(p[v]), pytest.approx(late[v])) for v in ring}


def test_curve_is_one_monte_carlo(spark):
    e = edges(spark, random_graph(1))
    ranked = spark.createDataFrame([(1, 0), (2, 5), (3, 7)], "rank int, vid long")
    got = {r.rank: r.spread for r in spread.curve(e, ranked, 6).collect()}
    assert got == {n: pytest.approx(spread.monte_carlo(e, ranked.where(f"rank <= {n}"), 6).first().spread) for n in (1, 2, 3)}
    w = spark.createDataFrame([(1, 2, [1.0, 0.0]), (2, 3, [0.0, 1.0])], "src long, dst long, w array<double>")
    assert topics.topic_spread(w, [1.0, 0.0], spark.createDataFrame([(1,)], "vid long"), 3).first().spread == 2.0
    c = spark.createDataFrame([(1, 2, 3)], "src long, dst long, c long")
    assert spread.constant_ratio(c, 0.5).first().p == pytest.approx(1 - 0.5**3)


def test_drivers(spark):
    rows = [(1, 2, 1.0), (2, 3, 1.0), (4, 5, 1.0), (6, 5, 1.0)]
    e = edges(spark, rows)
    value = lambda s: spread.monte_carlo(e, s, 1).first().spread
    short = selection.top(selection.first_gains(paths.closure(e, 0.01)), 4, "gain")
    assert [r.vid for r in selection.reranked(short, 2, value).orderBy("rank").collect()] == [1, 4]
    with pytest.raises(ValueError):
        selection.celf(e, 1, value, short, most=2)
    swept = selection.theta_sweep(e, 1, (10, 40), lambda g, k, theta: selection.top(selection.first_gains(paths.closure(g, theta)), k, "gain")).orderBy("bound").collect()
    assert [(r.bound, r.rank, r.vid, r.gain, r.tree_size) for r in swept] == [(b, 1, 1, 3.0, pytest.approx((1 + 4 + 9 + 1 + 9 + 1) / 6)) for b in (10, 20)]
    row = sinks.measured(lambda: selection.by_degree(e, 2), value, 2, 5, selection.at_random(e, 6)).first()
    assert (row.k, row.natives, row.accuracy) == (2, 5, 1.0) and row.spread == 3.0 and row.seconds >= 0
    many = spark.createDataFrame([(1, 2, 5, 0.5), (1, 3, 1, 0.5), (2, 3, 1, 0.5), (4, 3, 1, 0.5)], "src long, dst long, c long, p double")
    got = {r.vid: r.gain for r in selection.degree_discount_seeds(many, 2, 0.01).collect()}
    assert got[1] == 2.0 and 2 not in got  # five parallel edges discount vertex 2 below vertex 4
    assert {r.raw_id: r.vid for r in sinks.vertex_ids(e).collect()} == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4, 6: 5}


def test_files_come_back(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    ranked = spark.createDataFrame([(2, 9, 1.5), (1, 4, 2.5)], "rank int, vid long, gain double")
    sinks.seeds(ranked, at("s"))
    assert [tuple(r) for r in sources.saved_seeds(spark, at("s")).orderBy("rank").collect()] == [(1, 4, 2.5), (2, 9, 1.5)]
    sinks.seeds(ranked, at("ids"), gains=False)
    assert [tuple(r) for r in sources.saved_seeds(spark, at("ids"), gains=False).orderBy("rank").collect()] == [(1, 4), (2, 9)]
    sinks.curve(spark.createDataFrame([(1, 2.0)], "rank int, spread double"), at("c"))
    assert [r.value for r in spark.read.text(at("c")).collect()] == ["1", "1\t2.0"]
    bounds = spark.createDataFrame([(1, 0.5, 0.1), (2, 3.0, 1.0)], "vid long, infl double, infl2 double")
    sinks.vertex_bounds(bounds, at("b"))
    assert [tuple(r) for r in sources.vertex_bound_list(spark, at("b")).collect()] == [(2, 3.0, 1.0), (1, 0.5, 0.1)]
    upper = spark.createDataFrame([(1, 7.5, [0.5, 0.5])], "sid long, ub double, item array<double>")
    sinks.upper_samples(upper, at("u"), 2, 3)
    assert [(r.ub, r.item) for r in sources.upper_bound_samples(spark, at("u"), 2).collect()] == [(7.5, [0.5, 0.5])]
    lower = spark.createDataFrame([(1, [0.5, 0.5], [4, 9])], "sid long, item array<double>, seeds array<long>")
    sinks.lower_samples(lower, at("l"), 2, 2)
    assert [(r.item, r.seeds) for r in sources.lower_bound_samples(spark, at("l"), 2, 2).collect()] == [([0.5, 0.5], [4, 9])]
    sinks.influence_graph(spark.createDataFrame([(1, 2, 0.5, 0.0)], "u long, v long, p double, p_back double"), at("g"))
    lines = {r.value for r in spark.read.text(at("g")).collect()}
    assert lines == {"2 1", "1 2 0.5 0.0", "2 1 0.0 0.5"}
    many = spark.createDataFrame([(i, i + 1, 0.25, 0.5 if i % 2 else 0.0) for i in range(40)], "u long, v long, p double, p_back double").repartition(3)
    sinks.influence_graph(many, at("many"))
    back = {(r.src, r.dst): r.p for r in sources.influence_graph(spark, at("many")).collect()}
    assert back == {(i, i + 1): 0.25 for i in range(40)} | {(i + 1, i): 0.5 for i in range(1, 40, 2)}


def test_loaders(spark, tmp_path):
    def file(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    assert {(r.u, r.v) for r in sources.unweighted_graph(spark, file("u", "3 2\n1 2\n\n2 3\n")).collect()} == {(1, 2), (2, 3)}
    assert [r.item for r in sources.topic_items(spark, file("i", "1 2\n0.25 0.75\n"), 2).collect()] == [[0.25, 0.75]]
    assert [(r.k, r.item) for r in sources.topic_items(spark, file("k", "1 2\n5 0.25 0.75\n"), 2, "k").collect()] == [(5, [0.25, 0.75])]
    assert [(r.qid, r.item) for r in sources.item_matrix(spark, file("m", "id\ta\tb\nx\t1\t0.5\n")).collect()] == [("x", [1.0, 0.5])]
    file("net.inf", "2 1\n0 1 0.5 0\n1 0 0 0.5\n")
    assert [tuple(r) for r in sources.dataset(spark, "net", str(tmp_path)).collect()] == [(0, 1, 0.5)]
    boxes = sources.rectangles(spark, file("q", "1\n1 2 3 4 5\n")).first()
    assert (boxes.cx, boxes.cy, boxes.hx, boxes.hy, boxes.k) == (2.0, 1.0, 4.0, 3.0, 5)
    with pytest.raises(Exception, match="not 2 fields"):
        sources.unweighted_graph(spark, file("bad", "3 2\n1 2\n2 3 4\n")).collect()
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cast"):
        sources.unweighted_graph(spark, file("bad2", "3 2\n1 x\n")).collect()


def test_derived_probabilities(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 2), (3, 2)], "u long, v long")
    assert {(r.src, r.dst): r.p for r in sources.directed_cascade(pairs).collect()} == {(1, 2): pytest.approx(1 / 3), (3, 2): pytest.approx(1 / 3)}
    got = {(r.src, r.dst): r.p for r in sources.random_orientation(pairs).collect()}
    assert sorted([got[1, 2], got[2, 1]]) == pytest.approx([1 - 0.99**2, 1 - 0.9**2]) and sorted([got[3, 2], got[2, 3]]) == pytest.approx([0.01, 0.1])
    both = {(r.src, r.dst): r.p for r in sources.undirected_trivalency(pairs).collect()}
    assert both.keys() == {(1, 2), (2, 1), (2, 3), (3, 2)} and both[1, 2] == both[2, 1] and set(both.values()) <= {0.2, 0.04, 0.008}
    assert {(r.src, r.dst) for r in sources.directed_trivalency(pairs).collect()} == {(1, 2), (3, 2)}
