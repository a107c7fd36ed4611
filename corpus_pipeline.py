"""A corpus pipeline of operators: what is toxic or of no language goes, near duplicates leave one, sources are mixed, texts encoded.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir), where ``docs`` has the columns of
``documents``, and returns a DataFrame of all that it keeps. All but the last return the columns of ``docs``.

Rows: null and empty texts are not toxic but have no language, so the second stage drops them. Other cases are as each
operator says. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from seedspread.llm import bpe, jaccard_join, language_id, mixing, toxicity
from seedspread.llm.queries import BYTE_BPE, UNIGRAM_PIECES
from seedspread.llm.session import shared_dir, table


#: Rows of an Arrow batch: whole documents travel in them, and ten thousand take tens of MB on both sides of each task.
BATCH_ROWS = 1000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are predicted toxic."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return toxicity.decent(docs, table(spark, sf_dir, "labels"))


def drop_undetermined(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be determined."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return language_id.identified(docs, UNIGRAM_PIECES)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each class of near duplicates, one row of exact repeats."""
    return jaccard_join.one_of_each_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents, some of them twice, so that sources get their targets."""
    return mixing.resample(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document that was taken, once for each time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return bpe.round_trip_digests(docs, BYTE_BPE)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_undetermined),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("bpe_round_trip", encode_texts),
]

#: SQL can't express the trained stages; the tests hold each stage against its operator, and the operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
