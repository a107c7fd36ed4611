"""Quality rules, importance resampling and spelling variants against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seedspread.llm import importance, quality, shingles, variants

SF = "/root/testdata/sf0.001"
SPACE = r"[^\x20\x09-\x0D]+"
ODD = [None, "", " \n\t ", "a b c d e f g h i j", "x y z w v " * 3, "one\n\n two \none\none\r\n###", "é ü ñ " * 9, "\x00a b", "word " * 50_000, "w" * 70_000, "A B\nA B\nA  B", "1 2 3 4 5\n1 2 3 4 5"]


def base_counts(text):
    text = text or ""
    w = re.findall(SPACE, text)
    lines = [line for line in text.split("\n") if re.search(SPACE, line)]
    seen, dup = set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    again = {i + j for i, window in enumerate(windows) if often[window] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


def test_base_counts_equal_plain_python(spark):
    rng = random.Random(5)
    made = ["".join(rng.choices(["ab", "c", " ", "\n", "#", "é", "\t", "d e f g h "], k=rng.randint(0, 80))) for _ in range(300)]
    texts = ODD + made + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.score(docs, None).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = base_counts(t)
        assert tuple(got[i][c] for c in quality.COUNTS) == want, (i, t[:50] if t else t)
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert got[i].base_failed == failed and got[i].kept == (not failed)


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = {r.doc_id: r.quality for r in labels.collect()}
    found = [r for r in quality.judged(docs, labels).collect() if r.doc_id in known and zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and not r.base_failed]
    right = [r.kept == (known[r.doc_id] == 1) for r in found]
    assert len(right) > 50 and sum(right) >= 0.97 * len(right)
    assert all(r.kept for r in found if known[r.doc_id] == 1)


def test_trees_are_monotonic_and_scored_as_walked():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = (x[:, 0] + np.sin(3 * x[:, 1]) - x[:, 2] + rng.normal(size=3000) > 0).astype(float)
    forest = quality.grow(x, y, np.array([1, 0, -1, 0]))
    p = forest.probabilities(x)
    assert ((p > 0.5) == (y > 0)).mean() > 0.75
    for f, sign in ((0, 1), (2, -1)):
        for row in x[:40]:
            line = np.repeat(row[None], 200, axis=0)
            line[:, f] = np.linspace(-4, 4, 200)
            assert (sign * np.diff(forest.margins(line)) >= -1e-12).all()

    def walk(tree, row):
        at = 0
        while 2 * at + 2 < forest.feature.shape[1]:
            at = 2 * at + (2 if row[forest.feature[tree, at]] > forest.threshold[tree, at] else 1)
        return forest.value[tree, at]

    for row, m in zip(x[:50], forest.margins(x[:50]), strict=True):
        assert m == pytest.approx(forest.offset + sum(walk(t, row) for t in range(len(forest.feature))))
    loose = quality.grow(x, y, np.zeros(4))
    assert np.log(loose.probabilities(x)[y > 0]).mean() >= np.log(p[y > 0]).mean() - 0.05


def test_best_split_is_the_best_of_all():
    rng = np.random.default_rng(2)
    g, h, n = rng.normal(size=(3, 8)), rng.uniform(1, 2, (3, 8)), np.full((3, 8), 10.0)
    g -= (g.sum(axis=1, keepdims=True) - g[0].sum()) / 8
    h *= h[0].sum() / h.sum(axis=1, keepdims=True)
    gain, f, b, left, right = quality.best_split(g, h, n, np.zeros(3), -np.inf, np.inf)
    score = lambda g, h: g * g / (h + quality.SHRINK) / 2
    brute = {(i, j): score(g[i, : j + 1].sum(), h[i, : j + 1].sum()) + score(g[i, j + 1 :].sum(), h[i, j + 1 :].sum()) - score(g[i].sum(), h[i].sum()) for i in range(3) for j in range(7)}
    assert (f, b) == max(brute, key=brute.get) and gain == pytest.approx(brute[f, b])


def test_quality_cases(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g h i j", 1), (1, None, 2), (1, None, 2)], "doc_id long, text string, kept int")
    labels = spark.createDataFrame([(1, 1, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert sorted((r.doc_id or 0, r.kept, r.score) for r in quality.judged(docs, labels).collect()) == [(0, True, 1.0), (1, False, 1.0), (1, False, 1.0)]
    assert [tuple(r) for r in quality.good(docs, labels).collect()] == [(None, "a b c d e f g h i j", 1)]
    assert quality.judged(docs.limit(0), labels.limit(0)).count() == 0


def test_advanced_equals_crc():
    rng = random.Random(3)
    words = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 3, 8, 47, 48, 49, 500]))) for _ in range(400)]
    data = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.array(list(map(len, words)))
    state = importance.advanced(np.full(len(words), 0xFFFFFFFF, np.uint32), data, np.cumsum(lengths) - lengths, lengths)
    assert [int(~s) for s in state] == [zlib.crc32(w) for w in words]


def ngrams(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("n", [1, 3])
def test_chunks_give_the_features_of_whole_texts(spark, n):
    rng = random.Random(n)
    texts = ODD + [" ".join("".join(rng.choices("aBé-ß9", k=rng.randint(1, 30))) for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["same Text " * 40] * 2
    docs = spark.createDataFrame([(i // 2 * 2 if i > 71 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    found = importance.pieces(docs, n, chunk=100)
    gain = np.arange(50) - 20
    got = Counter(tuple(r) for r in importance.weights(found, gain, n).select("doc_id", "n_words", "n_features", "weight").collect())
    want = Counter()
    for r in docs.collect():
        words, grams = ngrams(r.text, n)
        want[r.doc_id, words, len(grams), sum(int(gain[zlib.crc32(g.encode()) % 50]) for g in grams)] += 1
    assert got == want
    assert found.where("owned >= 0").count() > 60


def test_resampling_equals_plain_python(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choices(["the", "Fox", "ünd", "x9", "law"], k=rng.randint(0, 40))) for _ in range(120)] + [None, "", "law " * 3]
    target = ["law fox"] * 5 + [None, "LAW"]
    rows = [*enumerate(texts), (7, texts[7])]
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, rank int, hash string")
    got = importance.resample(docs, spark.createDataFrame([(1, t) for t in target], "item_id long, text string"), n=2, buckets=500, percent=30)
    s, t = Counter(), Counter()
    for i, text in rows:
        s.update(zlib.crc32(g.encode()) % 500 for g in ngrams(text, 2)[1])
    for text in target:
        t.update(zlib.crc32(g.encode()) % 500 for g in ngrams(text, 2)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + 500) / ((s[b] + 1) * (sum(t.values()) + 500)))) for b in range(500)]
    want = []
    for i, text in rows:
        words, grams = ngrams(text, 2)
        weight = sum(gain[zlib.crc32(g.encode()) % 500] for g in grams)
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        want.append((i, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    enough = sorted((r for r in want if r[4] >= 20), key=lambda r: (-r[3], r[0]))
    drawn = enough[: len(enough) * 30 // 100]
    left = Counter(r[0] for r in drawn)
    assert Counter(tuple(r)[:4] for r in got.collect()) == Counter(r[:4] for r in want)
    assert [(r.rank, r.doc_id, r.score) for r in got.where("rank is not null").orderBy("rank").collect()] == [(k, r[0], r[3]) for k, r in enumerate(drawn, 1)]
    assert got.where("rank is null").count() == len(want) - sum(left.values())


def test_resampling_cases(spark):
    docs = spark.createDataFrame([(None, "a " * 30), (1, "b " * 30), (1, "b " * 30), (2, None)], "doc_id long, text string")
    empty = spark.createDataFrame([], "item_id long, text string")
    got = importance.resample(docs, empty, percent=100)
    assert sorted(r.rank for r in got.collect() if r.rank) == [1, 2, 3] and got.count() == 4
    assert importance.resample(docs.limit(0), empty).count() == 0


def test_ranks_over_many_partitions(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 100).alias("a"), "id").repartition(13)
    got = [(r.a, r.id, r["rank"]) for r in importance.ranked(rows, F.desc("a"), "id").collect()]
    want = sorted(((i * 7919 % 100, i) for i in range(5000)), key=lambda r: (-r[0], r[1]))
    assert sorted(got, key=lambda r: r[2]) == [(*r, k) for k, r in enumerate(want, 1)]


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_near_words_equal_brute_force(spark):
    rng = random.Random(4)
    words = {"".join(rng.choices("abé", k=rng.randint(1, 6))) for _ in range(300)} | {"silent", "listen", "tinsel", "silents", "sileñt", "ilent", "xsilent"}
    counts = {w: rng.randint(3, 40) for w in words}
    got = {r.word: r for r in variants.grouped(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    forms = {}
    for w in words:
        near = [o for o in words if one_apart(w, o)]
        best = min(near, key=lambda o: (-counts[o], o), default=None)
        forms[w] = best if best and counts[best] >= 2 * counts[w] else None
        assert (got[w].n, got[w].n_near, got[w].form, got[w].form_n) == (counts[w], len(near), forms[w], counts[best] if forms[w] else None)
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        assert got[w].root == root
    assert len(got) == len(words)


def test_long_chains_of_forms(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 40)]
    got = {r.word: r.root for r in variants.roots(spark.createDataFrame(rows, "word long, form long")).collect()}
    assert got == {**dict.fromkeys(range(40), 40), 100: 40}


def test_large_sets_of_anagrams_fall_apart(spark):
    rng = random.Random(6)
    words = list({"".join(rng.sample("abcdefghijkl", 12)) for _ in range(2000)})
    offered = variants.keys(spark.createDataFrame([(w, 3) for w in words], "word string, n long"))
    most = offered.groupBy("join").count().agg(F.max("count")).first()[0]
    assert most < 60
    assert variants.near_pairs(spark.createDataFrame([(w, 3) for w in words[:300]], "word string, n long")).count() == 0


def test_variant_words_equal_plain_python(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["Haus", "grüße", "GRÜSSE", "letters", "ab", "Ünder", "x1yzzzz"], k=30)) for _ in range(150)] + [None, "", "lettersletters" * 3000]
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, n string")
    counts = Counter()
    for i, t in enumerate(texts):
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    got = {r.word: r.n for r in variants.spelling_variants(docs).collect()}
    assert got == {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    assert variants.spelling_variants(docs.limit(0)).count() == 0
    assert variants.spelling_variants(spark.createDataFrame([(None, "abcde abcde abcde")] * 2, "doc_id long, text string")).collect()[0].n == 6


def test_texts_in_slices_of_columns():
    texts = pa.array(["skip me", "a b c d e f", None, "g\ng\ng"]).slice(1)
    (_, data, offsets), = shingles.chunks(texts)
    counts, _ = quality.measured(data, offsets)
    assert counts.tolist() == [list(base_counts(t)) for t in texts.to_pylist()]
