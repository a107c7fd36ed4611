"""The kept index of regions: what it holds, and which files a query opens."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import expansion_by_hand, untied_graph

from seedspread.operators import paths, region_index, selection, spatial

THETA = 0.05


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng, rows = random.Random(3), untied_graph(4, n=12, m=30)
    edges = spark.createDataFrame(rows, "src long, dst long, p double")
    users = spark.createDataFrame([(i, rng.uniform(-1, 1), rng.uniform(-1, 1)) for i in range(12)], "user_id long, x double, y double")
    tree = selection.checkpointed(spatial.quadtree(users, capacity=2))
    path = str(tmp_path_factory.mktemp("index"))
    assert region_index.build(edges, tree, path, "g", THETA, 3) == 4
    return rows, edges, tree, path


def test_kept_lists_and_seeds(spark, index):
    rows, edges, tree, path = index
    where = {r.user_id: r.path for r in tree.collect()}
    regions = sorted({p[:i] for p in where.values() for i in range(0, len(p) + 1, 2)})
    mip = {(r.s, r.v): r.p for r in paths.closure(edges, THETA).collect()}
    lists = region_index.heads(spark, path, "g", THETA, 4, regions, -1).collect()
    kept = region_index.seeds(spark, path, "g", THETA, 4, regions, 2).collect()
    for rid in regions:
        own = {u for u, p in where.items() if p.startswith(rid)}
        dp = {}
        for (s, v), p in mip.items():
            if v in own:
                dp[s] = dp.get(s, 0) + p
        want = sorted(dp.items(), key=lambda e: (-e[1], e[0]))
        got = sorted((r["rank"], r.vid, r.dp) for r in lists if r.rid == rid)
        assert [(k, pytest.approx(p)) for k, (_, p) in enumerate(want, 1)] == [(k, p) for k, _, p in got] and {v for _, v, _ in got} == dp.keys()
        best = [(v, pytest.approx(g)) for v, g in expansion_by_hand(rows, min(2, len(own)), THETA, sorted(own)) if g > 1e-9]
        assert [(r.vid, r.gain) for r in sorted((r for r in kept if r.rid == rid), key=lambda r: r.pos)][: len(best)] == best


def test_heads_open_few_files(spark, index):
    _, _, _, path = index
    whole = spark.read.parquet(f"{path}/g-theta{THETA:g}-k4/lists")
    files = whole.select("_metadata.file_path").distinct().count()
    head = region_index.heads(spark, path, "g", THETA, 4, ["NE", ""], 3)
    rows = head.collect()
    assert {(r.rid, r["rank"]) for r in rows} == {(rid, i) for rid in ("NE", "") for i in (1, 2, 3)}
    scan = next(line for line in head._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in line)
    assert "bucket" in scan and "rid" in scan.split("PartitionFilters")[1]
    opened = head.withColumn("file", F.input_file_name()).select("file").distinct().count()
    assert opened == 4 < files  # two buckets of two regions


def test_larger_numbers_are_built_anew(spark, index):
    _, edges, tree, path = index
    assert region_index.kept_k(spark, path, "g", THETA, 2) == 4 and region_index.kept_k(spark, path, "g", THETA, 5) is None
    assert region_index.kept_k(spark, path, "g", 0.1, 2) is None and region_index.kept_k(spark, path, "h", THETA, 2) is None
    assert region_index.build(edges, tree, path, "g", THETA, 2) == 4
    assert region_index.build(edges, tree.where("path = ''"), path, "g", THETA, 5) == 8
    assert region_index.kept_k(spark, path, "g", THETA, 5) == 8


def test_ranks_of_regions_over_partitions(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 7)).alias("rid"), F.col("id").alias("vid"), ((F.col("id") * 37 % 101) / 10).alias("dp"))
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (r.rid, -r.dp, r.vid)):
        want.setdefault(r.rid, []).append(r.vid)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = region_index.ranked_lists(rows.repartition(9)).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.rid, r.vid): r["rank"] for r in got} == {(rid, v): k for rid, own in want.items() for k, v in enumerate(own, 1)}
