"""Results as text files in the formats that ``sources`` reads, and as tables.

Files of seeds, curves and bounds start with their count. ``written`` sorts by the given columns and writes one file: these
are short lists, or in the case of vertex bounds a list that is read in order. All else is a DataFrame to be written as such.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def written(rows: DataFrame, path: str, order: list[Column | str], fields: list[str], sep: str = "\t", header: str | None = None) -> None:
    """Writes ``fields`` of ``rows`` in order under ``header`` (their count, unless given) to a folder with one text file."""
    line = rows.select(F.lit(1).alias("part"), *order, F.concat_ws(sep, *[F.col(f).cast("string") for f in fields]).alias("value"))
    names = line.columns[1:-1]
    first = rows.agg(F.count(F.lit(1)).cast("string").alias("value")) if header is None else rows.sparkSession.range(1).select(F.lit(header).alias("value"))
    top = first.select(F.lit(0).alias("part"), *[F.lit(None).cast(line.schema[n].dataType).alias(n) for n in names], "value")
    top.union(line).coalesce(1).sortWithinPartitions("part", *names).select("value").write.text(path)


def seeds(ranked: DataFrame, path: str, gains: bool = True) -> None:
    """``id gain`` (or ``id``) of ranked seeds (rank, vid, gain)."""
    written(ranked, path, ["rank"], ["vid", "gain"] if gains else ["vid"])


def curve(found: DataFrame, path: str) -> None:
    """``rank spread`` of a spread curve."""
    written(found, path, ["rank"], ["rank", "spread"])


def vertex_bounds(bounds: DataFrame, path: str) -> None:
    """``id infl infl2``, the largest infl first."""
    written(bounds, path, [(-F.col("infl")).alias("by"), "vid"], ["vid", "infl", "infl2"], " ")


def upper_samples(samples: DataFrame, path: str, topics: int, k: int) -> None:
    """``ub w1 ... wZ`` of sid, ub, item."""
    flat = samples.select("sid", "ub", *[F.col("item")[i].alias(f"w{i}") for i in range(topics)])
    written(flat, path, ["sid"], ["ub", *[f"w{i}" for i in range(topics)]], " ", f"{samples.count()} {topics} {k}")


def lower_samples(samples: DataFrame, path: str, topics: int, k: int) -> None:
    """``w1 ... wZ s1 ... sk`` of sid, item, seeds."""
    fields = {f"w{i}": F.col("item")[i] for i in range(topics)} | {f"s{i}": F.get("seeds", F.lit(i)) for i in range(k)}
    flat = samples.select("sid", *[c.alias(n) for n, c in fields.items()])
    written(flat, path, ["sid"], list(fields), " ", f"{samples.count()} {topics} {k}")


def influence_graph(pairs: DataFrame, path: str) -> None:
    """``n m`` (vertices and pairs), then ``u v p_uv p_vu`` of u, v, p, p_back both ways round, as a folder of text files in any order."""
    pairs = pairs.select("u", "v", "p", "p_back")
    counts = pairs.select(F.explode(F.array("u", "v")).alias("vid")).agg(F.countDistinct("vid").alias("n")).join(pairs.agg(F.count(F.lit(1)).alias("m")))
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("p_back").alias("p"), F.col("p").alias("p_back")))
    lines = both.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("u", "v", "p", "p_back")]).alias("value"))
    counts.select(F.concat_ws(" ", "n", "m").alias("value")).union(lines).write.text(path)


def vertex_ids(edges: DataFrame) -> DataFrame:
    """raw_id, vid: the vertices of ``edges`` and their places in ascending order, counted over ranges, not in one task."""
    ids = edges.select(F.explode(F.array("src", "dst")).alias("raw_id")).distinct().repartitionByRange("raw_id").sortWithinPartitions("raw_id")
    schema = "raw_id long, vid long"
    return ids.rdd.map(lambda r: r[0]).zipWithIndex().toDF(schema)


def measured(run: Callable[[], DataFrame], spread: Callable[[DataFrame], float], k: int, natives: int | None = None, true: DataFrame | None = None) -> DataFrame:
    """One row: seconds, k, spread, natives, accuracy of a selection; accuracy is the share of its seeds that are in ``true``."""
    began = time.time()
    found = run().persist()
    n, seconds = found.count(), time.time() - began
    hit = found.join(true.select("vid"), "vid", "left_semi").count() / max(1, n) if true is not None else None
    row = [(seconds, k, float(spread(found.select("vid"))), natives, hit)]
    return found.sparkSession.createDataFrame(row, "seconds double, k int, spread double, natives long, accuracy double")
