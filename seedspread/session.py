"""Reading tables and cutting lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the folder that ``spark.checkpoint.dir`` names; a temporary one only in local mode."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        wanted = df.sparkSession.conf.get("spark.checkpoint.dir", "")
        if not wanted and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


#: Most rows of a few plain columns that may be broadcast (about 50 MB as hash relation).
BROADCAST_ROWS = 500_000


def small_side(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows (``rows``, or counted), else unchanged, for a shuffled join.

    ``df`` is checkpointed or cheap, and of a few plain columns."""
    rows = df.limit(most + 1).count() if rows is None else rows
    return F.broadcast(df) if rows <= most else df
