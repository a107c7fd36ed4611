"""Registration, the SQL oracles, and the pipeline stage by stage."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from seedspread.llm import bpe, jaccard_join, language_id, queries, toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE_SQL[name])
    names = sorted(c[0] for c in want.description)
    assert sorted(got.columns) == names
    order = [[c[0] for c in want.description].index(n) for n in names]
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(tuple(r[i] for i in order) for r in want.fetchall())


def test_all_are_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names


def test_stages_keep_rows_and_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def ids(df):
        return Counter(r.doc_id for r in df.select("doc_id").collect())

    kept = stages["toxicity"](spark, docs, SF)
    assert kept.columns == docs.columns
    machine = toxicity.learn(docs, labels)
    bad = {r.doc_id for r in toxicity.score(docs, machine).where("score >= 0.3").collect()}
    assert ids(kept) == Counter({i: n for i, n in ids(docs).items() if i not in bad})

    spoken = stages["language_id"](spark, kept, SF)
    known = language_id.identify(kept, queries.UNIGRAM_PIECES).where("lang_pred <> 'und' and score >= 0.5")
    assert spoken.columns == docs.columns and ids(spoken) == ids(known)

    alone = stages["ngram_jaccard_join"](spark, spoken, SF)
    classes = {r.class_id for r in jaccard_join.jaccard_join(spoken).collect()}
    assert alone.columns == docs.columns and set(ids(alone)) == classes and max(ids(alone).values()) == 1

    mixed = stages["source_mix"](spark, alone, SF)
    assert mixed.columns == docs.columns and set(ids(mixed)) <= set(ids(alone)) and max(ids(mixed).values()) <= 2

    last = stages["bpe_round_trip"](spark, mixed, SF)
    assert ids(last) == ids(mixed)
    assert last.columns == bpe.round_trip_digests(mixed, queries.BYTE_BPE).columns


def test_pipeline_runs_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))


def test_stages_on_odd_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", None, None, 0), (3, "word " * 30_000, "en", "a", 1), (3, "word " * 30_000, "en", "a", 1)], schema)
    for frame in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SF)
            assert out.count() <= 2 * frame.count()
