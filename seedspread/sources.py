"""Graphs, locations and queries: from text files, and derived from the event and embedding tables.

Ids stay as they are; probabilities are stored as such. Parallel edges keep their largest probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seedspread.operators.probability import hash_coin, trivalency, weighted_cascade
from seedspread.session import table

TOPICS = ("click", "error", "purchase", "signup", "view")


def rows(spark: SparkSession, path: str, columns: list[str], sep: str = " ", header: bool | int = True) -> DataFrame:
    """Rows of one text file, with a field for each of ``columns`` ("name type"). ``header``: its first line holds counts and is
    left out; a number says how many fields such a line has wherever it stands, as in a folder that was written in parts. Blank lines are left out; any other line with another number of fields, or one that is no such type, is an error."""
    split = F.split(F.trim("value"), r"\s+" if sep == " " else sep)
    names = [c.split() for c in columns]
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    lines = (lines.where("at > 0") if header is True else lines).where(F.trim("value") != "").select("value", split.alias("f"))
    lines = lines.where(F.size("f") != int(header)) if header and header is not True else lines
    wrong = F.raise_error(F.concat(F.lit(f"{path}: not {len(columns)} fields: "), "value"))
    fields = lines.select(F.when(F.size("f") == len(columns), F.col("f")).otherwise(wrong.cast("array<string>")).alias("f"))
    return fields.select(*[F.trim(F.col("f")[i]).cast(kind).alias(name) for i, (name, kind) in enumerate(names)])


def influence_graph(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, p from rows ``u v p_uv p_vu``: an edge for each direction with a positive probability."""
    both = rows(spark, path, ["u bigint", "v bigint", "p double", "back double"], header=2)
    ends = F.explode(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst"), F.col("p")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst"), F.col("back").alias("p"))))
    return strongest(both.select(ends.alias("e")).select("e.*"))


def dataset(spark: SparkSession, name: str, folder: str = "data") -> DataFrame:
    """The influence graph of a data set: ``folder``/``name``.inf."""
    return influence_graph(spark, f"{folder.rstrip('/')}/{name}.inf")


def unweighted_graph(spark: SparkSession, path: str) -> DataFrame:
    """u, v from rows ``u v``."""
    return rows(spark, path, ["u bigint", "v bigint"])


def _weights(topics: int) -> list[str]:
    return [f"w{i} double" for i in range(topics)]


def _item(topics: int) -> Column:
    return F.array(*[f"w{i}" for i in range(topics)])


def topic_graph(spark: SparkSession, path: str, topics: int) -> DataFrame:
    """src, dst, w from rows ``u v w1 ... wZ``."""
    return rows(spark, path, ["src bigint", "dst bigint", *_weights(topics)]).select("src", "dst", _item(topics).alias("w"))


def locations_file(spark: SparkSession, path: str, sep: str = " ", header: bool = True) -> DataFrame:
    """user_id, x, y from rows ``id y x``; ``spatial.within`` parts those outside the world."""
    return rows(spark, path, ["user_id bigint", "y double", "x double"], sep, header).select("user_id", "x", "y")


def rectangles(spark: SparkSession, path: str) -> DataFrame:
    """qid, cx, cy, hx, hy, k from rows ``y x ylim xlim k`` (half sizes); qid numbers equal rows alike."""
    read = rows(spark, path, ["cy double", "cx double", "hy double", "hx double", "k int"])
    return read.select(F.xxhash64(*read.columns).alias("qid"), "cx", "cy", "hx", "hy", "k")


def vertex_bound_list(spark: SparkSession, path: str) -> DataFrame:
    """vid, infl, infl2 from rows ``id infl infl2``."""
    return rows(spark, path, ["vid bigint", "infl double", "infl2 double"])


def topic_items(spark: SparkSession, path: str, topics: int, leading: str | None = None) -> DataFrame:
    """qid, item from rows of Z weights; with ``leading``, rows begin with an int of that name (k, say, or a placeholder)."""
    read = rows(spark, path, [*([f"{leading} int"] if leading else []), *_weights(topics)])
    return read.select(F.xxhash64(*read.columns).alias("qid"), *([leading] if leading else []), _item(topics).alias("item"))


def upper_bound_samples(spark: SparkSession, path: str, topics: int) -> DataFrame:
    """sid, ub, item from rows of a bound and Z weights."""
    read = rows(spark, path, ["ub double", *_weights(topics)])
    return read.select(F.xxhash64(*read.columns).alias("sid"), "ub", _item(topics).alias("item"))


def lower_bound_samples(spark: SparkSession, path: str, topics: int, k: int) -> DataFrame:
    """sid, item, seeds from rows of Z weights and k seeds in rank order."""
    read = rows(spark, path, [*_weights(topics), *[f"s{i} bigint" for i in range(k)]])
    return read.select(F.xxhash64(*read.columns).alias("sid"), _item(topics).alias("item"), F.array(*[f"s{i}" for i in range(k)]).alias("seeds"))


def item_matrix(spark: SparkSession, path: str) -> DataFrame:
    """qid, item from a tab-separated file with a line of names; the first column names the item."""
    read = spark.read.csv(path, sep="\t", header=True)
    return read.select(F.col(read.columns[0]).alias("qid"), F.array(*[F.col(f"`{c}`").cast("double") for c in read.columns[1:]]).alias("item"))


def saved_seeds(spark: SparkSession, path: str, gains: bool = True) -> DataFrame:
    """rank, vid, gain (or rank, vid) of a saved seed list: a count, then a row for each seed in rank order.

    Ranks are numbered in one task: seed lists are short."""
    read = rows(spark, path, ["vid bigint", "gain double"] if gains else ["vid bigint"], r"\t")
    return read.withColumn("at", F.monotonically_increasing_id()).select(F.row_number().over(Window.orderBy("at")).alias("rank"), *read.columns)


def directed_cascade(pairs: DataFrame) -> DataFrame:
    """src, dst, p from unweighted (u, v): 1 / degree of the target, forward only; a vertex's degree counts both directions' edges."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("dst")).groupBy("dst").agg(F.count(F.lit(1)).alias("degree"))
    once = pairs.select(F.col("u").alias("src"), F.col("v").alias("dst")).distinct()
    return once.join(ends, "dst").select("src", "dst", (1 / F.col("degree")).alias("p"))


def random_orientation(pairs: DataFrame, high: float = 0.1, low: float = 0.01) -> DataFrame:
    """src, dst, p from unweighted (u, v): a hash coin of each pair gives one direction ``high`` and the other ``low``; parallel
    edges add up as independent ones."""
    counted = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).groupBy("u", "v").agg(F.count(F.lit(1)).alias("c"))
    heads = hash_coin(F.col("u"), F.col("v")) < 0.5
    ways = [(F.col("u"), F.col("v"), heads), (F.col("v"), F.col("u"), ~heads)]
    edge = [F.struct(a.alias("src"), b.alias("dst"), (1 - F.pow(1 - F.when(up, F.lit(high)).otherwise(F.lit(low)), F.col("c"))).alias("p")) for a, b, up in ways]
    return counted.select(F.explode(F.array(*edge)).alias("e")).select("e.*")


def directed_trivalency(pairs: DataFrame) -> DataFrame:
    """src, dst, p from unweighted (u, v): one of three levels by the edge's coin, forward only."""
    return pairs.select(F.col("u").alias("src"), F.col("v").alias("dst")).distinct().withColumn("p", trivalency(F.col("src"), F.col("dst")))


def undirected_trivalency(pairs: DataFrame) -> DataFrame:
    """src, dst, p from unweighted (u, v): one of three levels by the pair's coin, the same in both directions."""
    once = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().withColumn("p", trivalency(F.col("u"), F.col("v")))
    return once.select(F.col("u").alias("src"), F.col("v").alias("dst"), "p").union(once.select("v", "u", "p"))


def undirected(pairs: DataFrame) -> DataFrame:
    """src, dst, c from unweighted (u, v): both directions, with multiplicity."""
    return pairs.select(F.col("u").alias("src"), F.col("v").alias("dst")).union(pairs.select("v", "u")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("c"))


def strongest(edges: DataFrame) -> DataFrame:
    """Without loops of probability 0 and parallel edges: the largest p of each (src, dst)."""
    return edges.where("p > 0").groupBy("src", "dst").agg(F.max("p").alias("p"))


def event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, src, dst: the users of each two events in a row, by time, where the second is a purchase."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", "user_id", "event_type")
    # one running order over all events: rows are ordered within hours, and the first event after an hour closes its last pair
    hour = F.date_trunc("hour", "ts")
    order = Window.partitionBy("hour").orderBy("ts", "event_id")
    hourly = events.withColumn("hour", hour)
    after = F.lead(F.struct("user_id", "event_type")).over(order)
    first = hourly.groupBy("hour").agg(F.min_by(F.struct("user_id", "event_type"), F.struct("ts", "event_id")).alias("opening"))
    opening = first.withColumn("before", F.lag("hour").over(Window.orderBy("hour"))).select(F.col("before").alias("hour"), "opening")  # a row an hour
    following = hourly.withColumn("after", after).join(F.broadcast(opening), "hour", "left").withColumn("after", F.coalesce("after", "opening"))
    found = following.where("after.event_type = 'purchase' and user_id <> after.user_id")
    return found.select(F.col("event_type").alias("kind"), F.col("user_id").alias("src"), F.col("after.user_id").alias("dst"))


def ic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, c, p: a click followed by another user's purchase, with weighted-cascade probabilities."""
    counted = event_pairs(spark, sf_dir).where("kind = 'click'").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("c"))
    into = counted.groupBy("dst").agg(F.sum("c").alias("deg"))
    return counted.join(into, "dst").select("src", "dst", "c", weighted_cascade(F.col("deg"), F.col("c")).alias("p"))


def topic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, w: weight of each of five topics, the first event's type; c / (all counts into dst)."""
    pairs = event_pairs(spark, sf_dir)
    counted = pairs.groupBy("src", "dst").agg(*[F.sum((F.col("kind") == t).cast("long")).alias(t) for t in TOPICS])
    into = pairs.groupBy("dst").agg(F.count(F.lit(1)).alias("deg"))
    return counted.join(into, "dst").select("src", "dst", F.array(*[F.col(t) / F.col("deg") for t in TOPICS]).alias("w"))


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, x, y from the first two components of embeddings; null where there is none, i.e. in no rectangle."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("user_id"), F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
