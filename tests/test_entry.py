import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from seedspread import queries as core

SF = "/root/testdata/sf0.001"
SLOW = {"pmia_seeds", "mia_seeds", "location_pmia", "location_expansion", "topic_greedy_seeds", "item_clusters"}


def rows(frame):
    names = sorted(frame.columns)
    return sorted(map(str, ([round(x, 6) if isinstance(x, float) else x for x in r] for r in frame[names].itertuples(index=False, name=None))))


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_query_matches_oracle(spark, oracle, name):
    got = core.QUERIES[name](spark, SF).toPandas()
    want = oracle.execute(core.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
