"""The SQL of two seeds against the operators, on random graphs where the second seed's paths meet the first one's."""

import random

import duckdb
import pytest

from seedspread import queries as core
from seedspread.operators import paths, selection


def untied(seed, n=9, m=26):
    rng, found = random.Random(seed), {}
    while len(found) < m:
        u, v = rng.sample(range(n), 2)
        found[u, v] = round(rng.uniform(0.3, 0.95), 6)
    return [(u, v, p) for (u, v), p in sorted(found.items())]


def answered(rows, natives, body):
    con = duckdb.connect()
    con.execute("create table edge(src bigint, dst bigint, p double)")
    con.executemany("insert into edge values (?, ?, ?)", rows)
    con.execute("create table local_(vid bigint)")
    con.executemany("insert into local_ values (?)", [(v,) for v in natives])
    sql = f"with recursive e as (select * from edge), v as (select src as vid from e union select dst from e), native as (select vid from local_), {core._ALL_STARTS}, {body}"
    return [(v, pytest.approx(g, abs=2e-6)) for _, v, g in sorted(con.execute(sql).fetchall())]


@pytest.mark.parametrize("seed", [6])
def test_second_seeds(spark, seed):
    rows, natives = untied(seed), [0, 2, 3, 5, 8, 50]
    e = selection.checkpointed(spark.createDataFrame(rows, "src long, dst long, p double"))
    local = spark.createDataFrame([(v,) for v in natives], "vid long")
    ranked = lambda found: [(r.vid, r.gain) for r in found.orderBy("rank").collect()]
    theta = core.THETA
    assert ranked(selection.expansion(e, 2, theta, local)) == answered(rows, natives, core._EXPANSION_PAIR)
    assert ranked(selection.mia(e, 2, theta)) == answered(rows, natives, core._tree_pair_sql("v", False))
    assert ranked(selection.pmia(e, 2, theta)) == answered(rows, natives, core._tree_pair_sql("v", True))
    assert ranked(selection.pmia(e, 2, theta, local)) == answered(rows, natives, core._tree_pair_sql("native", True))
    alone = {r.vid: r.gain for r in selection.first_gains(paths.closure(e, theta)).collect()}
    second = ranked(selection.mia(e, 2, theta))[1]
    assert second[1] < alone[second[0]]  # the first seed takes a part
