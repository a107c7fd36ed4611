"""A kept index of regions: for each region the vertices that reach its users, best first, in tables that a query reads heads of.

An index has a name, made of the graph, theta and the number of seeds per region that were asked for. Its lists are a Parquet
table partitioned by region and by bucket of rank (1, 2-3, 4-7, ...), so reading n ranks of some regions opens only their first
buckets' files. Seeds of regions are a second table. Both are written once, for all queries to come, under the name; an index that
holds at least as many seeds serves smaller numbers, and a larger one is built beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from seedspread.operators.batch import expansions
from seedspread.operators.paths import closure
from seedspread.session import checkpointed

LISTS = "rid string, vid long, dp double, rank int, bucket int"


def members(placed: DataFrame) -> DataFrame:
    """rid, vid: the users (user_id, path) of each node of a quadtree, its own and those of all nodes below."""
    ups = F.transform(F.sequence(F.lit(0), (F.length("path") / 2).cast("int")), lambda i: F.substr(F.col("path"), F.lit(1), 2 * i))
    return placed.select(F.explode(ups).alias("rid"), F.col("user_id").alias("vid"))


def ranked_lists(sums: DataFrame) -> DataFrame:
    """rid, vid, dp, rank of sums (rid, vid, dp): ranks from one range-partitioned sort, so that no region is sorted in one task."""
    order = ["rid", F.desc("dp"), "vid"]
    placed = checkpointed(sums.orderBy(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    # a row for each partition and region in it: where the region starts there, and how many of it are in earlier partitions
    spans = placed.groupBy(part.alias("part"), "rid").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    other = spans.select("rid", F.col("part").alias("earlier"), F.col("n").alias("more"))
    before = spans.join(other, "rid").where("earlier <= part").groupBy("rid", "part").agg(F.sum(F.when(F.col("earlier") < F.col("part"), F.col("more")).otherwise(0)).alias("before"), F.min("first").alias("first"))
    ranks = placed.withColumn("part", part).join(before, ["rid", "part"])
    return ranks.select("rid", "vid", "dp", (F.col("before") + F.col("at") - F.col("first") + 1).cast("int").alias("rank"))


def _folder(path: str, graph: str, theta: float, k: int, what: str) -> str:
    return f"{path.rstrip('/')}/{graph}-theta{theta:g}-k{k}/{what}"


def _there(spark: SparkSession, folder: str) -> bool:
    try:
        spark.read.parquet(folder)
    except AnalysisException:
        return False
    return True


def kept_k(spark: SparkSession, path: str, graph: str, theta: float, k: int, most: int = 1 << 20) -> int | None:
    """The least number of seeds, at least ``k``, for which an index of the name is there: ``k`` or a power of two."""
    sizes, size = [k], 1
    while size < most:
        sizes += [size] if size > k else []
        size *= 2
    return next((n for n in sizes if _there(spark, _folder(path, graph, theta, n, "seeds"))), None)


def build(edges: DataFrame, placed: DataFrame, path: str, graph: str, theta: float, k: int, mip: DataFrame | None = None) -> int:
    """Writes the index of all regions of a quadtree's users (user_id, path), unless one with at least ``k`` seeds is kept; its k (``k``, or
    the next power of two)."""
    spark = edges.sparkSession
    if (kept := kept_k(spark, path, graph, theta, k)) is not None:
        return kept
    k = 1 << max(0, k - 1).bit_length()
    own = checkpointed(members(placed))
    mip = closure(edges.select("src", "dst", "p"), theta) if mip is None else mip
    sums = mip.select("s", F.col("v").alias("vid"), "p").join(own, "vid").groupBy("rid", F.col("s").alias("vid")).agg(F.sum("p").alias("dp"))
    lists = ranked_lists(sums).withColumn("bucket", F.floor(F.log2("rank") + 1e-9).cast("int"))
    queries = own.groupBy(F.col("rid").alias("qid")).agg(F.least(F.lit(k), F.count(F.lit(1)).cast("int")).alias("k"))
    found = expansions(edges, queries, own.select(F.col("rid").alias("qid"), "vid"), theta)
    tagged = lists.withColumn("rid", F.concat(F.lit("r"), "rid"))  # the root's name is empty, which no folder can be
    tagged.repartition("rid", "bucket").write.partitionBy("rid", "bucket").parquet(_folder(path, graph, theta, k, "lists"))
    seeds = found.select(F.col("qid").alias("rid"), F.col("rank").alias("pos"), "vid", "gain")
    seeds.repartitionByRange("rid").sortWithinPartitions("rid", "pos").write.parquet(_folder(path, graph, theta, k, "seeds"))
    return k


def heads(spark: SparkSession, path: str, graph: str, theta: float, k: int, regions: list[str], ranks: int) -> DataFrame:
    """rid, vid, dp, rank: the first ``ranks`` of the lists of some regions (all if negative); other regions' and later buckets' files aren't opened.

    ``regions``: those that a rectangle covers, a list on the driver whose length grows with the tree's depth, not with users."""
    lists = spark.read.schema(LISTS).parquet(_folder(path, graph, theta, k, "lists")).where(F.col("rid").isin([f"r{r}" for r in regions]))
    if ranks >= 0:
        lists = lists.where((F.col("bucket") <= max(0, ranks.bit_length() - 1)) & (F.col("rank") <= ranks))
    return lists.withColumn("rid", F.substring("rid", 2, 1 << 30)).drop("bucket")


def seeds(spark: SparkSession, path: str, graph: str, theta: float, k: int, regions: list[str], most: int) -> DataFrame:
    """rid, pos, vid, gain: the first ``most`` kept seeds of some regions."""
    kept = spark.read.parquet(_folder(path, graph, theta, k, "seeds"))
    return kept.where(F.col("rid").isin(regions) & (F.col("pos") <= most))
