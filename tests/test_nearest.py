import math
import random

import pytest
from pyspark.sql import functions as F

from seedspread.operators import topics

ITEMS, SAMPLES = "qid long, item array<double>", "sid long, item array<double>"


def kl(p, q):
    fill = [(a or 1e-7, b or 1e-7) for a, b in zip(p, q, strict=True)]
    return sum(a * math.log(a / b) for a, b in fill)


def usable(v):
    return bool(v) and all(x is not None and 0 <= x < math.inf for x in v)


def brute(items, samples, most):
    out = {}
    for qid, item in items:
        near = [(round(kl(item, s), 9), sid) for sid, s in samples if usable(item) and usable(s) and len(item) == len(s)]
        out[qid] = min((d for d in near if d[0] < most), default=(None, None))
    return out


def mixes(rng, n, z, around):
    """Peaked mixes around a few of them, some with zeros, not all of them sum up to 1."""
    out = []
    for _ in range(n):
        v = [max(0.0, c + rng.uniform(-0.04, 0.04)) for c in rng.choice(around)]
        total = sum(v) * rng.choice([1, 1, 0.8, 1.5])
        out.append([x / total for x in v])
    return out


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    around = [[rng.random() ** 3 for _ in range(5)] for _ in range(12)]
    items = list(enumerate(mixes(rng, 60, 5, around)))
    samples = list(enumerate(mixes(rng, 900, 5, around)))
    return items, samples


@pytest.mark.parametrize("most", [1.0, 0.01, math.inf])
def test_pivots_equal_brute_force(spark, data, most):
    items, samples = data
    want = brute(items, samples, most)
    found = topics.nearest_sample(spark.createDataFrame(items, ITEMS), spark.createDataFrame(samples, SAMPLES), most, few=0)
    got = {r.qid: (r.distance, r.sid) for r in found.collect()}
    assert {q: s for q, (_, s) in got.items()} == {q: s for q, (_, s) in want.items()}
    assert all(got[q][0] == pytest.approx(d, abs=1e-8) for q, (d, _) in want.items() if d is not None)


def test_few_pairs_are_compared(spark, data):
    items, samples = data
    pairs = topics.near_pairs(spark.createDataFrame(items, ITEMS), spark.createDataFrame(samples, SAMPLES), pivots=40).select("qid", "sid").collect()
    assert len(pairs) == len(set(pairs))
    assert len(pairs) < len(items) * len(samples) / 4


def test_parts_and_deals_lose_nothing(spark, data):
    """Rings of more than a few samples, asked for by more than a few items, are dealt into parts; every pair comes up once."""
    items, samples = data
    i, s = spark.createDataFrame(items, ITEMS), spark.createDataFrame(samples, SAMPLES)
    whole = sorted(map(tuple, topics.near_pairs(i, s, pivots=8).select("qid", "sid").collect()))
    assert sorted(map(tuple, topics.near_pairs(i, s, pivots=8, hot=3).select("qid", "sid").collect())) == whole
    placed, cells = topics.sample_cells(s, pivots=8, width=0.5, part=10)
    assert placed.count() == len(samples) and placed.agg(F.max("part")).first()[0] > 0
    parts = {(c.cell, r.ring): r.parts for row in cells.collect() for c in row.cells for r in c.rings}
    assert {(r.cell, r.ring, r.part) for r in placed.collect()} <= {(*k, p) for k, n in parts.items() for p in range(n)}


def test_odd_rows(spark):
    """Ties, copies, empty, null, negative and unbounded vectors, other lengths."""
    nan, inf = math.nan, math.inf
    items = [(1, [0.5, 0.5]), (2, None), (3, []), (4, [0.5, None]), (5, [nan, 1.0]), (6, [-0.5, 1.5]), (7, [0.2, 0.3, 0.5]), (8, [0.0, 0.0]), (9, [1.0]), (10, [inf, 0.0])]
    samples = [(30, [0.5, 0.5]), (20, [0.5, 0.5]), (21, None), (22, []), (23, [nan, 0.5]), (24, [0.5, None]), (25, [-0.5, 1.5]), (26, [0.2, 0.3, 0.5]), (27, [inf, inf])] + [(100 + i, [0.5, 0.5]) for i in range(50)]
    want = {1: 20, 7: 26, 8: 20}
    for few in (0, 1000):
        got = {r.qid: r.sid for r in topics.nearest_sample(spark.createDataFrame(items, ITEMS), spark.createDataFrame(samples, SAMPLES), few=few).collect()}
        assert len(got) == len(items) and {q: s for q, s in got.items() if s is not None} == want
        assert topics.nearest_sample(spark.createDataFrame(items, ITEMS), spark.createDataFrame([], SAMPLES), few=few).where("sid is not null").count() == 0
        assert topics.nearest_sample(spark.createDataFrame([], ITEMS), spark.createDataFrame(samples, SAMPLES), few=few).count() == 0
