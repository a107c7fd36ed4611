"""Near-duplicate joins, licence scans and source mixing against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seedspread.llm import embedding_dedup, jaccard_join, license_scan, mixing


def reach(nodes, links):
    """node -> least node that links reach."""
    label = {n: n for n in nodes}
    while True:
        new = dict(label)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_links(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    return [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]


def near_copies(seed=3):
    rng, texts = random.Random(seed), {}
    words = [f"w{i}" for i in range(300)]
    for base in range(25):
        text = rng.choices(words, k=rng.randint(1, 150))
        for copy in range(rng.randint(1, 8)):
            own = list(text)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts[len(texts)] = " ".join(own)
    for text in (None, "", " \t\n ", "one", "one", "one two", "a b c d e", "a b c d e", " ", "w1 " * 30_000):
        texts[len(texts)] = text
    for _ in range(30):
        texts[len(texts)] = texts[0]
    return texts


def joined(spark, texts):
    docs = spark.createDataFrame([(i, t, i % 3, "x") for i, t in texts.items()], "doc_id long, text string, n_links int, class_id string")
    return {r.doc_id: r for r in jaccard_join.jaccard_join(docs.repartition(5)).collect()}


def test_jaccard_join_equals_brute_force(spark):
    texts = near_copies()
    links = brute_links(texts)
    classes = reach(texts, links)
    got = joined(spark, texts)
    assert got.keys() == texts.keys()
    for i in texts:
        partners = {b if a == i else a for a, b in links if i in (a, b)}
        assert got[i].n_links == len(partners)
        assert got[i].n_texts == len({texts[p] for p in partners} - {texts[i]})
        assert got[i].class_id == classes[i]


def test_jaccard_join_deals_large_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SIGNATURE_BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "TEXT_BLOCK", 4)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(60):
        own = list(base)
        own[rng.randrange(len(own))] = f"n{i}"
        texts[i] = " ".join(own)
    links = brute_links(texts)
    got = joined(spark, texts)
    assert {i: got[i].n_links for i in texts} == {i: sum(i in link for link in links) for i in texts}
    assert {r.class_id for r in got.values()} == {0}


def test_jaccard_join_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.jaccard_join(empty).count() == 0
    again = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_links, r.class_id) for r in jaccard_join.jaccard_join(again).collect()) == [(1, 1, 1), (2, 1, 1)]
    kept = jaccard_join.one_of_each_class(again)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1]
    other = again.unionByName(spark.createDataFrame([(2, "quite another text of seven words here"), (2, "quite another text of seven words here")], again.schema))
    kept = jaccard_join.one_of_each_class(other.withColumns({"_row": F.lit(1), "digest": F.lit("clash"), "repeats": F.lit(5)}))
    assert kept.columns == ["doc_id", "text", "_row", "digest", "repeats"]
    assert sorted((r.doc_id or 0, r.text[:1], r.digest) for r in kept.collect()) == [(0, "a", "clash"), (1, "a", "clash"), (2, "q", "clash")]
    with pytest.raises(ValueError):
        jaccard_join.jaccard_join(empty, threshold=0.5)


def test_bayesian_bounds_keep_true_pairs():
    least = jaccard_join.least_matches()
    rng = np.random.default_rng(0)
    matches = (rng.random((200_000, jaccard_join.SIGNATURE)) < 0.8).cumsum(axis=1)[:, jaccard_join.STEP - 1 :: jaccard_join.STEP]
    assert (matches >= np.array(least)).all(axis=1).mean() > 1 - 1e-4
    assert least == sorted(least)


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 24))
    rows = [c + rng.normal(size=24) * s for c in centres for s in rng.uniform(0, 0.6, 15)]
    return [np.float32(r).tolist() for r in rows]


@pytest.mark.parametrize(("block", "tile"), [(8192, 2048), (100, 32), (20, 8)])
def test_embedding_links_equal_brute_force(spark, monkeypatch, block, tile):
    monkeypatch.setattr(embedding_dedup, "block_size", lambda dim: block)
    for name, value in {"BLOCK": block, "BLOCK_VALUES": 24 * block, "TILE": tile, "PACK": 7, "STEP": 10, "LEAD": 21}.items():
        monkeypatch.setattr(embedding_dedup, name, value)
    rows = vectors()
    rows += [rows[0], rows[0], [0.0] * 24, None, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [], [1.0, 2.0], [2.0, 4.0]]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in enumerate(rows)], "vec_id long, embedding array<float>, label int, kept string")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame.repartition(4)).collect()}
    links = []
    good = {i: np.float64(v) for i, v in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    for a, b in itertools.combinations(good, 2):
        x, y = good[a], good[b]
        if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
            links.append((a, b))
    components = reach(range(len(rows)), links)
    assert got.keys() == set(range(len(rows)))
    for i in range(len(rows)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (sum(i in link for link in links), components[i], components[i] == i)


def test_embedding_cases(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [3.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r.vec_id or 0, *r[1:]) for r in embedding_dedup.near_duplicates(rows).collect()]
    assert sorted(got) == [(0, 3, 1, False), (1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False)]
    same_id = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (None, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embedding_dedup.near_duplicates(same_id).collect()]
    assert sorted(got) == [(0, 0, 0, True), (1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False)]


def test_embeddings_of_doubles_stay_doubles(spark):
    rows = [[1e300, 0.0], [1e300, 0.0], [2e300, 1e299], [1e-300, 0.0], [0.0, 1e-310], [1.0, 0.484322], [1.0, 0.4843221048378526]]
    frame = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(frame).collect()}
    unit = [np.array(r) / max(r) for r in rows]
    near = [[i for i, y in enumerate(unit) if i != k and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9] for k, x in enumerate(unit)]
    assert {k: n for k, (n, _) in got.items()} == {k: len(x) for k, x in enumerate(near)}


def test_suffix_norms_only_skip_work():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 64)) * np.linspace(3, 0.1, 64)
    x[75:] = x[:75] + rng.normal(size=(75, 64)) * 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = embedding_dedup.Side(x, np.linalg.eigh(x.T @ x)[1][:, ::-1])
    i, j = embedding_dedup.tile_links(side, side, slice(0, 150), slice(0, 150), 0.9)
    assert set(zip(i, j, strict=True)) == set(zip(*np.nonzero(x @ x.T >= 0.9), strict=True))


def test_far_cells_are_not_compared():
    rng = np.random.default_rng(8)
    x = np.concatenate([c + rng.normal(size=(500, 16)) * 0.02 for c in np.eye(16)[:6] * 3])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cells = embedding_dedup.Cells(x, len(x) * 100)
    place = cells.place(x)
    cell = cells.cell(place)
    cells.finish({c: ((cell == c).sum() * 100, place[cell == c].min(axis=0), place[cell == c].max(axis=0)) for c in np.unique(cell).tolist()}, 16, 0.2**0.5)
    assert len(cells.near) == 1 << cells.depth
    near = {(a, b) for a, some in enumerate(cells.near) for b in some.tolist()}
    assert len(near) < 0.6 * len(cells.near) ** 2 and all((b, a) in near for a, b in near)
    i, j = np.nonzero(x @ x.T >= 0.9)
    assert set(zip(cell[i].tolist(), cell[j].tolist(), strict=True)) <= near


def test_license_scan_finds_planted_notices(spark):
    rng = random.Random(9)
    filler = [f"v{i}" for i in range(500)]
    rows, want = [], set()
    for name, variants in license_scan.TEMPLATES.items():
        for notice in variants:
            for where in ("start", "middle", "end"):
                before = [] if where == "start" else rng.choices(filler, k=rng.randint(1, 400))
                after = [] if where == "end" else rng.choices(filler, k=rng.randint(1, 400))
                rows.append((len(rows), " ".join([*before, *notice.upper().split(), *after])))
                want.add((rows[-1][0], name))
    clean = range(len(rows), len(rows) + 50)
    rows += [(i, " ".join(rng.choices(filler, k=300))) for i in clean]
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "mit license")]
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert want <= {(r.doc_id, r.license) for r in found}
    assert not {r.doc_id for r in found} - {i for i, _ in want}
    assert len(found) == len({(r.doc_id, r.license) for r in found})


def test_license_scan_tolerates_edits_and_verifies(spark):
    notice = license_scan.TEMPLATES["MIT"][2].split()
    edited = list(notice)
    edited[20] = "zzz"
    half = notice[: len(notice) // 2]
    docs = spark.createDataFrame([(1, " ".join(edited)), (2, " ".join(half)), (3, "q " * 50_000 + " ".join(notice))], "doc_id long, text string")
    found = {(r.doc_id, r.license): r for r in license_scan.scan(docs).collect()}
    assert (1, "MIT") in found and 0.8 <= found[1, "MIT"].containment < 1 and (2, "MIT") not in found
    assert found[3, "MIT"].containment == 1 and found[3, "MIT"].last_word >= 50_000
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_quotas():
    assert mixing.quotas({"a": 100, "b": 100, "c": 100}, (3, 1, 2), 1.5, 2) == pytest.approx({"a": 200, "b": 250 / 3, "c": 500 / 3})
    assert sum(mixing.quotas({"a": 10, "b": 1000, None: 50}, (3, 1, 2), 1.5, 2).values()) == pytest.approx(1.5 * 1060)
    assert mixing.quotas({}, (3, 1, 2), 1.5, 2) == {}


def cheapest(supply, target, most):
    """Least cost of meeting the targets as far as they can be met, by trying all amounts."""
    patterns = list(supply)
    best = None
    for used in itertools.product(*[range(most * supply[p] + 1) for p in patterns]):
        splits = [[c for c in itertools.product(range(u + 1), repeat=len(p)) if sum(c) == u] for p, u in zip(patterns, used, strict=True)]
        for split in itertools.product(*splits):
            got = dict.fromkeys(target, 0)
            for p, c in zip(patterns, split, strict=True):
                for s, w in zip(p, c, strict=True):
                    got[s] += w
            if all(got[s] <= target[s] for s in target):
                cost = sum(max(0, u - supply[p]) for p, u in zip(patterns, used, strict=True))
                key = (-sum(got.values()), cost)
                best = key if best is None else min(best, key)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_flow_is_cheapest(seed):
    rng = random.Random(seed)
    supply = {("a",): rng.randint(0, 3), ("a", "b"): rng.randint(1, 3), ("b",): rng.randint(0, 3)}
    target = {"a": rng.randint(0, 6), "b": rng.randint(0, 6)}
    used = mixing.route(supply, target, 2)
    assert (-sum(used.values()), sum(max(0, used[p] - supply[p]) for p in supply)) == cheapest(supply, target, 2)


def test_mix_meets_targets(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choices(["web", "book", "Ünï", None], [6, 1, 2, 1])[0], 5) for i in range(3000)] + [(3000, None, "web", 1), (3001, "", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int").repartition(6)
    got = mixing.mix_words(docs).collect()
    again = {r.doc_id: r for r in mixing.mix_words(docs.repartition(2)).collect()}
    assert len(got) == len(rows) and all(r == again[r.doc_id] for r in got)
    source = {i: s for i, _, s, _ in rows}
    size = {i: len((t or "").split()) for i, t, _, _ in rows}
    for name in {"web", "book", "Ünï", None}:
        own = [r for r in got if source[r.doc_id] == name]
        assert {(r.source_size, r.target) for r in own} == {(sum(size[r.doc_id] for r in own), own[0].target)}
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
    assert all(r.size == size[r.doc_id] and 0 <= r.taken <= 2 * r.size for r in got)


def test_mix_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_words(empty).count() == 0 and mixing.resample(empty).count() == 0
    docs = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s"), (2, "d e f", None)], "doc_id long, text string, source string")
    assert mixing.mix_words(docs).count() == 4
    assert mixing.resample(docs).columns == docs.columns
    both = spark.createDataFrame([(i, "w w w w", ["a", "b"] if i % 2 else ["a"]) for i in range(40)], "doc_id long, text string, sources array<string>")
    mixed, sources = mixing.mix(both, both["sources"], mixing.word_count(both["text"]))
    assert sum(t for _, t in sources.values()) == pytest.approx(360)
    assert sum(r.taken for r in mixed.collect()) == 320  # 40 documents of 4 words, each at most twice


def test_resample_keeps_clashing_columns(spark):
    rows = [(i, "w " * (i + 1), "s", -7, f"t{i}", [i]) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, taken string, _row array<long>")
    got = mixing.resample(docs)
    assert got.columns == docs.columns
    assert {tuple(map(str, r)) for r in got.collect()} <= {tuple(map(str, r)) for r in docs.collect()}
    assert got.count() > len(rows)


def folded(text):
    return re.sub(r"[!-/:-@\[-`{-~]", " ", (text or "").translate({c: c + 32 for c in range(65, 91)})).split()


def shingle_rows(words):
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] if words else []


def brute_scan(texts):
    """(text, license) of all windows that hold 0.8 of a template, and the best share of each."""
    templates = [(name, set(shingle_rows(folded(t)))) for name, variants in license_scan.TEMPLATES.items() for t in variants]
    best = {}
    for i, text in texts.items():
        rows = shingle_rows(folded(text))
        for name, own in templates:
            n = len(own)
            step, length = (1, n) if n < 4 else ((1 << n.bit_length() - 1) // 4, 9 * ((1 << n.bit_length() - 1) // 4))
            for at in range(0, len(rows), step):
                share = len(own & set(rows[at : at + length])) / n
                if share >= 0.8 and share > best.get((i, name), 0):
                    best[i, name] = share
    return best


def test_license_scan_equals_brute_force(spark):
    """Windows begin with each text, alone or among others."""
    rng = random.Random(4)
    filler = [f"word{i}" for i in range(200)]
    notices = [t for variants in license_scan.TEMPLATES.values() for t in variants]
    texts = {}
    for i in range(40):
        words = rng.choices(filler, k=rng.randint(0, 60))
        for notice in rng.sample(notices, rng.randint(0, 2)):
            own = notice.split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                own[rng.randrange(len(own))] = "changed"
            words += own + rng.choices(filler, k=rng.randint(0, 60))
        texts[i] = " ".join(words)
    scanner = license_scan.Templates(license_scan.TEMPLATES)
    got = {}
    for i, text in texts.items():
        for _, data, offsets in license_scan.shingles.chunks(license_scan.pa.array([text])):
            got |= {(i, name): share for _, name, share, _, _ in scanner.matches(*license_scan.hashed(data, offsets))}
    assert got == pytest.approx(brute_scan(texts)) and len(got) > 20
    for _, data, offsets in license_scan.shingles.chunks(license_scan.pa.array(list(texts.values()))):
        assert {(i, name): share for i, name, share, _, _ in scanner.matches(*license_scan.hashed(data, offsets))} == got
    rows = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in texts.items()] * 2, "doc_id long, text string, license string, containment double")
    twice = [(r.doc_id, r.license) for r in license_scan.scan(rows.repartition(3)).collect()]
    assert sorted(set(twice)) == sorted(got) and all(twice.count(k) == 2 for k in got)


def test_place_of_a_license_does_not_depend_on_other_texts():
    rng = random.Random(2)
    filler = [f"word{i}" for i in range(200)]
    text = " ".join([*rng.choices(filler, k=70), *license_scan.TEMPLATES["Apache-2.0"][2].split(), *rng.choices(filler, k=50)])
    scanner, places = license_scan.Templates(license_scan.TEMPLATES), set()
    for n in range(30):
        before = [" ".join(rng.choices(filler, k=rng.randint(0, 90))) for _ in range(n)]
        for _, data, offsets in license_scan.shingles.chunks(license_scan.pa.array([*before, text, text])):
            found = scanner.matches(*license_scan.hashed(data, offsets))
            places |= {tuple(m[1:]) for m in found if m[0] >= n}
    assert len(places) == 1


def test_many_links_of_a_part_are_counted_tile_by_tile(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 64)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=16)
    rows = [(i, [float(x) for x in centre + rng.normal(size=16) * (0.01 if i < 500 else 9)]) for i in range(600)]
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= 0.9
    want = reach(range(600), [(a, b) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)])
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (int(near[i].sum()) - 1, want[i]) for i in range(600)}
