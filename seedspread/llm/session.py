"""What the operators share: reading tables, cutting lineage, checking a broadcast's size."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a few plain columns that may be broadcast (about 50 MB as hash relation).
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that all executors see; a temporary one only in local mode, where none is configured."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    wanted = spark.conf.get("spark.checkpoint.dir", "")
    if not wanted:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        wanted = tempfile.mkdtemp(prefix="checkpoint-")
    context.setCheckpointDir(wanted)
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and read from the shared folder from here on."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows (counted), else unchanged, for a shuffled join.

    The caller passes a checkpointed or otherwise cheap ``df`` of a few plain columns."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
