"""What the number of jobs and what passes through the driver must not grow with."""

import pytest

from seedspread import queries
from seedspread.operators import batch, graph, paths, selection, spread, topics


@pytest.fixture
def plans(monkeypatch):
    """Final plans of all that an operator of the given module checkpoints."""

    def watch(module):
        seen, real = [], module.checkpointed

        def kept(df):
            out = real(df)
            seen.append(df._jdf.queryExecution().executedPlan().toString())
            return out

        monkeypatch.setattr(module, "checkpointed", kept)
        return seen

    return watch


def chain(spark, n, p=1.0):
    return spark.createDataFrame([(i, i + 1, p) for i in range(n)], "src long, dst long, p double")


def test_lazy_greedy_doubles_distances(spark, plans):
    """A chain of 40 edges took a step for each edge, and as many again for each batch of candidates."""
    seen = plans(spread)
    e = chain(spark, 40).unionByName(spark.createDataFrame([(100, 101, 1.0), (101, 100, 1.0), (101, 102, 1.0)], "src long, dst long, p double"))
    got = spread.lazy_greedy(e, 3, 2, paths.vertices(e), 10).orderBy("rank").collect()
    assert [(r.vid, r.gain) for r in got] == [(0, 41.0), (100, 3.0), (1, 0.0)]
    assert len(seen) < 20


def test_all_reached(spark):
    live = spark.createDataFrame([(0, i, i + 1) for i in range(11)] + [(0, 5, 2), (1, 3, 3), (1, 3, 4), (1, 4, 3)], "run long, vid long, dst long")
    got = {(r.run, r.s, r.vid): r.far for r in spread.all_reached(live).collect()}
    want = {(0, a, b): b - a for a in range(12) for b in range(a + 1, 12)} | {(0, a, b): 6 - a + b - 2 for a in range(3, 6) for b in range(2, a)} | {(1, 3, 4): 1, (1, 4, 3): 1}
    assert got == want


def test_pagerank_broadcasts_nothing(spark, plans):
    """Ranks of a small graph were broadcast, twice a round."""
    seen = plans(graph)
    ranks = {r.vid: r["rank"] for r in graph.pagerank(chain(spark, 3)).collect()}
    assert ranks == {v: pytest.approx(sum(0.15 * 0.85**i for i in range(4 - v))) for v in range(4)}
    assert len(seen) > 4 and not any("BroadcastExchange" in plan for plan in seen)


@pytest.mark.parametrize("name", ["spread_curve", "shortest_path_plus_one_spread"])
def test_events_are_read_once(spark, plans, name):
    """Each ring and each Monte Carlo derived the edges from all events again."""
    seen = plans(spread)
    queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert seen and not any("FileScan" in plan for plan in seen)


@pytest.mark.parametrize("lazy", [True, False])
def test_batches_of_a_lazy_round_grow(spark, monkeypatch, lazy):
    """Fifteen candidates that tie below loose bounds took fifteen batches a round."""
    calls, real = [], topics.exact_gains
    monkeypatch.setattr(topics, "exact_gains", lambda *a: calls.append(1) or real(*a))
    te = spark.createDataFrame([(2 * i, 2 * i + 1, [1.0, 0.0]) for i in range(15)], "src long, dst long, w array<double>").localCheckpoint()
    if lazy:
        got = topics.topic_lazy(te, [0.5, 0.5], 1, 0.1, topics.reach_bounds(te, 0.1), batch=1)
    else:
        got = list(topics.best_first(te, [0.5, 0.5], 1, 0.1, topics.vertex_bounds(te, 0.1, 0.5), batch=1))
        got = spark.createDataFrame([(i, v, g) for i, (v, g) in enumerate(got[-1][0], 1)], "rank int, vid long, gain double")
    assert [(r.vid, r.gain) for r in got.collect()] == [(0, 1.5)]
    assert len(calls) <= 3


@pytest.mark.parametrize("name", ["location_assembly_pair", "location_hint_by_bounds"])
def test_paths_are_searched_once(spark, monkeypatch, name):
    """Lists of regions, bounds and rounds each searched for all paths again."""
    whole, real = [], paths.closure
    for module in (batch, paths, selection):
        monkeypatch.setattr(module, "closure", lambda *a, **b: (b.get("barred") is None and whole.append(1)) or real(*a, **b))
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert len(whole) == 1


def test_samples_are_selected_for_once(spark, monkeypatch):
    """Upper and lower samples each selected seeds for the same items."""
    calls, real = [], topics.topic_greedies
    monkeypatch.setattr(topics, "topic_greedies", lambda *a: calls.append(1) or real(*a))
    assert queries.QUERIES["topic_approximate_seeds"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(calls) == 1
