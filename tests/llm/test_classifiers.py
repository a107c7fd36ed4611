"""Toxicity and language identification: held-out accuracy, brute force for their inner sums, and odd rows."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seedspread.llm import language_id, queries, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_toxicity_on_held_out_labels(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    scored = toxicity.scored(documents, labels)
    rows = scored.join(labels.select("doc_id", "toxic"), "doc_id").where("held_out and toxic is not null").collect()
    toxic = [r.score for r in rows if r.toxic == 1]
    clean = [r.score for r in rows if r.toxic == 0]
    above = np.subtract.outer(np.array(toxic), np.array(clean))
    auc = ((above > 0) + 0.5 * (above == 0)).mean()
    flagged = sum(r.predicted for r in rows)
    right = sum(r.predicted for r in rows if r.toxic == 1)
    print("toxicity:", len(toxic), "toxic", len(clean), "clean; AUC", auc, "precision", right / max(1, flagged), "recall", right / len(toxic))
    assert scored.count() == documents.count()
    assert auc > 0.85 and right / flagged > 0.85 and right / len(toxic) > 0.8
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_rising_curve():
    knots, p = toxicity.rising(np.array([0.0, 1, 2, 3, 3, 4]), np.array([0.0, 1, 0, 1, 1, 1]))
    assert (np.diff(knots) >= 0).all() and (np.diff(p) >= 0).all() and p[0] < 0.5 and p[-1] > 0.8
    assert len(toxicity.rising(np.array([1.0, 1.0]), np.array([0.0, 1.0]))[0]) == 2


def gapped(a: str, b: str) -> float:
    """The kernel by its definition: pairs of equal subsequences of three, weighted by their spans."""
    def all_triples(word):
        s = f"\0{word}\0"
        found = {}
        for i, j, k in itertools.combinations(range(len(s)), 3):
            if k - i < toxicity.SPAN:
                found[s[i], s[j], s[k]] = found.get((s[i], s[j], s[k]), 0) + toxicity.DECAY ** (k - i + 1)
        return found

    x, y = all_triples(a), all_triples(b)
    return sum(w * y.get(t, 0) for t, w in x.items()) / toxicity.scale(len(a)) / toxicity.scale(len(b))


def test_kernel_equals_its_definition():
    words = ["idiot", "idiiot", "i", "house", "mouse", "id"]
    x = toxicity.explicit(words)
    assert np.allclose(x @ x.T, [[gapped(a, b) for b in words] for a in words], atol=1e-5)
    assert np.allclose(toxicity.project(words, x.T.copy()), x @ x.T, atol=1e-5)
    assert gapped("idiot", "idxiot") > 3 * gapped("idiot", "house")


def test_inserted_and_swapped_characters(spark):
    rng = random.Random(0)
    plain = ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(3, 9))) for _ in range(400)]
    rows, marks = [], []
    for i in range(1200):
        words = rng.choices(plain, k=30)
        bad = i % 3 == 0
        if bad:
            words[rng.randrange(30)] = rng.choice(["zwarkon", "quixbozzle"])
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    machine = toxicity.learn(docs, labels)
    probe = ["zwarkon", "ZWARKON!", "zwaarkon", "zw-ark-on", "z w a r k o n", "zwark0n", "quixbozzle", None, "", " ".join(plain[:200])]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(probe)), "doc_id long, text string"), machine).collect()}
    assert all(got[i] >= 0.3 for i in range(7)), got
    assert all(got[i] < 0.3 for i in range(7, 10)), got


def test_toxicity_cases(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (2, "x" * 100_000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.scored(docs, none).collect()] == [0.0] * 4
    odd = spark.createDataFrame([(1, None), (None, 1), (4, 0), (5, 1)], "doc_id long, toxic int")
    assert toxicity.scored(docs, odd).count() == 4
    assert toxicity.scored(docs.limit(0), odd).count() == 0
    assert toxicity.decent(docs, odd).columns == docs.columns
    own = docs.withColumn("_toxicity", F.lit(-7)).withColumn("__TOXICITY", F.lit("mine"))
    assert {(r._toxicity, r["__TOXICITY"]) for r in toxicity.decent(own, odd).collect()} == {(-7, "mine")}


def test_language_on_held_out_rows(spark, documents):
    got = language_id.predicted(documents, queries.UNIGRAM_PIECES).join(documents.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == documents.count()
    known = [r for r in got if r.held_out and r.lang and r.lang_pred != "und"]
    accuracy = sum(r.lang == r.lang_pred for r in known) / len(known)
    print("language: held-out accuracy", accuracy, "of", len(known))
    assert accuracy > 0.9 and all(0 <= r.score <= 1 for r in got)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in got)


def test_forward_sums_all_segmentations():
    vocabulary = sorted(["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "bab"])
    rng = np.random.default_rng(1)
    table = np.append(rng.random((len(vocabulary), 3)), np.zeros((1, 3)), axis=0)
    of = {p: table[i] for i, p in enumerate(vocabulary)}

    def total(word):
        if not word:
            return np.ones(3)
        out = np.zeros(3)
        for k in range(1, len(word) + 1):
            p = of.get(word[:k], np.full(3, language_id.UNKNOWN) if k == 1 else None)
            if p is not None:
                out = out + p * total(word[k:])
        return out

    lattice = language_id.Lattice(vocabulary)
    for word in ("▁abab", "▁aba", "▁bbab", "▁abcab"):
        assert np.allclose(language_id.forward(lattice.spans([word]), len(word), table)[-1][0], total(word))


def test_language_cases(spark):
    texts = ["the cat sat on the mat", "der Hund und die Katze", None, "", "123 456 !?", "x" * 50_000, "the cat sat on the mat", "½ ²", "① Ⅷ"]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 == 0 else "de", "s") for i, t in enumerate(texts)] + [(None, "the", "en", "s")], "doc_id long, text string, lang string, lang_pred string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predicted(docs, queries.UNIGRAM_PIECES).collect()}
    assert len(got) == 10 and [got[i] for i in (2, 3, 4, 7, 8)] == [("und", 0.0)] * 5 and got[0] == got[6]
    own = docs.withColumn("_lang_pred", F.lit("mine")).withColumn("_lang_score", F.lit(-1))
    kept = language_id.identified(own, queries.UNIGRAM_PIECES)
    assert kept.columns == own.columns and {(r._lang_pred, r._lang_score) for r in kept.collect()} == {("mine", -1)}
    untaught = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.predicted(untaught, queries.UNIGRAM_PIECES).collect()} == {"und"}
    assert language_id.predicted(docs.limit(0), queries.UNIGRAM_PIECES).count() == 0


def test_language_learns_from_distinct_texts(spark, monkeypatch):
    """Copies neither hide a language's texts from the sample nor weigh more than one text."""
    english = [f"the cat sat on the mat and looked at the house number {w}" for w in ("one", "two", "three", "four", "five", "six", "seven", "eight")]
    german = [f"der Hund und die Katze gehen durch das Haus und sehen {w}" for w in ("eins", "zwei", "drei", "vier", "sieben", "acht", "neun", "zehn")]
    found = spark.createDataFrame([(t,) for t in german], "text string").select("text", (F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)).alias("draw")).collect()
    late = [r.text for r in found if r.draw > 0.25]
    assert late
    once = [(t, "en") for t in english] + [(t, "de") for t in late]
    # 3000 copies or more of each text: a share of the rows draws none of them
    copies = [(t, lang) for t, lang in once for _ in range(3000 if lang == "de" else 3)]
    learned = spark.range(99).withColumnRenamed("id", "doc_id").where(~language_id.held_out()).first().doc_id
    frame = lambda rows: spark.createDataFrame(rows, "text string, lang string").withColumn("doc_id", F.lit(learned))
    vocabulary = language_id.pieces(queries.UNIGRAM_PIECES)
    names, table = language_id.learn(frame(once), vocabulary)
    assert names == ["de", "en"]
    assert np.allclose(language_id.learn(frame(copies), vocabulary)[1], table)
    monkeypatch.setattr(language_id, "TRAIN_DOCS", 0)
    few = language_id.learn(frame(copies), vocabulary)[1]
    start = np.append(language_id.fit(language_id.Lattice(vocabulary), {"▁": 1.0})[:-1], 0.0)
    assert not any(np.allclose(few[:, i], start) for i in range(2))


def test_long_runs_are_summed_whole():
    vocabulary = language_id.pieces(queries.UNIGRAM_PIECES)
    assert max(map(len, vocabulary)) > 8
    lattice = language_id.Lattice(vocabulary)
    assert (lattice.find(np.array([lattice._hash(p) for p in vocabulary], np.uint64)) == np.arange(len(vocabulary))).all()
    table = np.append(np.random.default_rng(1).dirichlet(np.ones(len(vocabulary)), 3).T, np.zeros((1, 3)), axis=0)
    words = ["▁internationalization", "▁straßenbahnhaltestelle", "▁жжжñqx", "▁a"]
    for w in words:
        whole = np.log(language_id.forward(lattice.spans([w]), len(w), table)[-1][0])
        assert lattice.log_total(w, table) == pytest.approx(whole)
    long = language_id.log_probabilities(["ab" * 10_000, "ж" * 3000], lattice, table)
    assert np.isfinite(long).all() and (long[:, -1] == 1).all() and (long[1, :3] < -1000).all()
