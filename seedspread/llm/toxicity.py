"""Toxicity by a subsequence string kernel and a support vector machine on Nyström landmarks.

Two strings are alike if they share subsequences of three characters; a subsequence that spans ``s`` characters weighs
``DECAY ** s``, and spans go up to ``SPAN``, so inserted or dropped characters cost similarity but do not hide a word. The
strings are the words of labelled sentences, in lower case, with marks at both ends; other than letters is left out of a
word, common digit-for-letter swaps are undone, and runs of single letters count as one word too, so that "i d-i 0 t"
reads like "idiot". A text scores as its worst word does.

Training sees labels of texts, not of words: words that are frequent in toxic and absent from clean texts start as
positive; then, in rounds, the machine is trained, each toxic text without a positive word offers its worst one, and clean
texts' words that score high weigh as negatives. Kernel values against the landmarks, whitened by their kernel
matrix, are the features of a squared-hinge SVM. A rising step curve (isotonic regression), with a little of a logistic one
so that no two values tie, turns a text's worst value into a probability.

The kernel is a dot product over triples of characters, so the trained machine is one weight a triple, and any word is
scored exactly without the landmarks.

Bounds of training, all parameters of this module: it takes at most about ``TRAIN_TOXIC`` and ``TRAIN_CLEAN`` labelled texts,
picked by a hash of doc_id, fewer where a class's labelled texts hold more than ``TRAIN_CHARS`` characters in proportion; their
distinct words reach the driver. In each round, all offered words are positives, and the negatives are ``RANDOM``
clean words, the ``HARD`` ones that score highest and the ``FREQUENT`` ones that occur most; ``LANDMARKS`` words, three quarters of
them positives, span the features. Everything else covers whole texts of all documents: a word of more than ``LONGEST``
letters is scored in stretches of that length, each overlapping the next by ``OVERLAP``, and counts as the worst of them.

Rows: null and empty texts score as texts without any word. If one of the classes has no training row, all score 0. Rows
without doc_id are scored and held out. Repeated rows score alike. Other columns stay or don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedspread.llm.language_id import by_length, held_out, unused
from seedspread.llm.wordcache import WordCache, live, releasing

TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS = 1000, 4000, 20_000_000
RANDOM, HARD, FREQUENT = 8000, 6000, 3000
LANDMARKS = 256
DECAY, SPAN = 0.5, 5
ROUNDS = 3
#: Of a violated margin against the norm of the weights, and how it grows with the number of texts that hold a toxic word.
COST, GROWTH = 100.0, 0.6
LONGEST, OVERLAP = 32, 16
THRESHOLD = 0.3

_SWAPS = str.maketrans("0134578@$!|", "oieastbasii")
_OTHER = re.compile(r"[\W\d_]+")
_SPELLED = re.compile(r"(?<![^\W_])(?:[^\W_][^\w\n]{1,3}){3,}[^\W_](?![^\W_])")
#: Symbols: 0 the mark, 1-26 a-z, then ten classes of other letters.
_SYMBOLS = 37


def plain(word: str) -> str:
    """A word's letters in lower case; swaps are undone where there are letters."""
    word = word.lower()
    if word.isalpha():
        return word
    bare = _OTHER.sub("", word)
    return _OTHER.sub("", word.translate(_SWAPS)) if bare else ""


def spelled_out(text: str) -> list[str]:
    """Runs of at least four single characters, each joined to a word."""
    return [_OTHER.sub("", m.lower().translate(_SWAPS)) for m in _SPELLED.findall(text)]


def symbols(words: list[str]) -> np.ndarray:
    """Words of one length as rows of symbols between two marks."""
    codes = np.array(words).view(np.uint32).reshape(len(words), -1).astype(np.int64)
    latin = (codes >= 97) & (codes <= 122)
    return np.pad(np.where(latin, codes - 96, 27 + codes % 10), ((0, 0), (1, 1)))


def triples(rows: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
    """(weight, codes) of the subsequences of three, for each pair of gaps."""
    for first in range(1, SPAN - 1):
        for both in range(first + 1, SPAN):
            n = rows.shape[1] - both
            if n > 0:
                codes = (rows[:, :n] * _SYMBOLS + rows[:, first : first + n]) * _SYMBOLS + rows[:, both:]
                yield DECAY ** (both + 1), codes


def scale(length: int) -> float:
    """Keeps values of words of all lengths alike: the norm of a word whose triples are all different."""
    total = sum(DECAY ** (2 * (both + 1)) * max(0, length + 2 - both) for first in range(1, SPAN - 1) for both in range(first + 1, SPAN))
    return float(np.sqrt(total)) or 1.0


def explicit(words: list[str]) -> np.ndarray:
    """Dense triple weights of a few words (landmarks)."""
    out = np.zeros((len(words), _SYMBOLS**3), np.float32)
    for places, group in by_length(words):
        for weight, codes in triples(symbols(group)):
            np.add.at(out, (places[:, None], codes), weight / scale(len(group[0])))
    return out


def project(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Sum of ``weights`` (triples x columns) over the triples of each word."""
    out = np.zeros((len(words), weights.shape[1]), np.float32)
    for places, group in by_length(words, 2000):
        total = np.zeros((len(group), weights.shape[1]), np.float32)
        for weight, codes in triples(symbols(group)):
            for c in codes.T:
                total += np.float32(weight) * weights[c]
        out[places] = total / scale(len(group[0]))
    return out


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Weights (the last is the offset) of a linear SVM with squared hinge loss, by Newton steps with halving."""
    x = np.append(x, np.ones((len(x), 1)), axis=1).astype(np.float64)
    ridge = np.append(np.ones(x.shape[1] - 1), 1e-6)
    loss = lambda w: float(ridge @ w**2 + cost @ np.maximum(0, 1 - y * (x @ w)) ** 2)
    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(rounds):
        inside = y * (x @ w) < 1
        part, c = x[inside], cost[inside]
        step = np.linalg.solve((part.T * c) @ part + np.diag(ridge), (part.T * c) @ y[inside]) - w
        while (new := loss(w + step)) > now and np.abs(step).max() > 1e-9:
            step /= 2
        w, gain, now = w + step, now - new, new
        if gain < 1e-6 * now:
            break
    return w


def logistic(value: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(1 | value), with smoothed targets."""
    a, b = 1.0, 0.0
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * value + b, -30, 30)))
        g = np.array([((p - target) * value).sum() + 1e-3 * a, (p - target).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * value**2).sum() + 1e-3, (v * value).sum()], [(v * value).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def rising(value: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function that is closest to P(1 | value), each step smoothed by one row of the mean."""
    at, where = np.unique(value, return_inverse=True)
    steps: list[list[float]] = []  # first value, last value, rows, ones
    for v, n, k in zip(at, np.bincount(where), np.bincount(where, y), strict=True):
        steps.append([v, v, n, k])
        while len(steps) > 1 and steps[-2][3] * steps[-1][2] >= steps[-1][3] * steps[-2][2]:
            _, last, n, k = steps.pop()
            steps[-1] = [steps[-1][0], last, steps[-1][2] + n, steps[-1][3] + k]
    first, last, n, k = np.array(steps).T
    p = np.maximum.accumulate((k + y.mean()) / (n + 1))
    return np.stack([first, last], axis=1).ravel(), np.repeat(p, 2)


class Machine:
    """A weight for each triple, an offset, and the curve from a text's worst value to a probability."""

    def __init__(self, weights: np.ndarray, offset: float, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.offset, self.slope, self.shift = weights.astype(np.float32), offset, slope, shift
        self.knots: tuple[np.ndarray, np.ndarray] = np.zeros(1), np.full(1, 0.5)
        self.none = -2.0  # the value of a text without words

    def values(self, words: list[str]) -> np.ndarray:
        """The value of each word; a long one counts as its worst stretch."""
        cut, owner = [], []
        for i, w in enumerate(words):
            for k in range(0, max(1, len(w) - OVERLAP), LONGEST - OVERLAP) if w else ():
                cut.append(w[k : k + LONGEST])
                owner.append(i)
        out = np.full(len(words), self.none, np.float32)
        for places, group in by_length(cut):
            total = np.zeros(len(group), np.float32)
            for weight, codes in triples(symbols(group)):
                total += np.float32(weight) * self.weights[codes].sum(axis=1)
            np.maximum.at(out, np.array(owner)[places], total / scale(len(group[0])) + self.offset)
        return out

    def probability(self, value: np.ndarray) -> np.ndarray:
        smooth = 1 / (1 + np.exp(-np.clip(self.slope * value + self.shift, -30, 30)))
        return 0.98 * np.interp(value, *self.knots) + 0.02 * smooth


def train(texts: Iterable[tuple[list[str], bool]], seed: int = 0) -> Machine | None:
    """A machine from the distinct words of each text and its label; None if a class has no text."""
    place: dict[str, int] = {}
    held, labels = [], []
    for words, y in texts:
        held.append(np.array([place.setdefault(w, len(place)) for w in words if len(w) > 1], np.int32))
        labels.append(y)
    toxic = np.array(labels, bool)
    if not toxic.any() or toxic.all() or not place:
        return None
    rng = np.random.default_rng(seed)
    vocabulary = list(place)
    del place
    bad, good = (np.bincount(np.concatenate([h for h, t in zip(held, toxic, strict=True) if t == y]), minlength=len(vocabulary)).astype(np.float64) for y in (True, False))
    n1, n0 = toxic.sum(), (~toxic).sum()
    share = (bad / n1 + 1e-12) / (bad / n1 + good / n0 + 1e-12)
    surprise = (bad / n1 - good / n0) / np.sqrt((bad / n1**2 + good / n0**2) + 1e-12)
    positive = (share > 0.97) & (bad >= 3) & (surprise > 3)
    if not positive.any():
        positive[np.argsort(-surprise, kind="stable")[:5]] = True
    clean = np.flatnonzero(good > 0)
    machine = None
    for _ in range(ROUNDS):
        offered = positive.copy()
        if machine is not None:
            value = machine.values(vocabulary)
            for rows, y in zip(held, toxic, strict=True):
                if y and len(rows) and not positive[rows].any():
                    worst = rows[np.argmax(value[rows])]
                    offered[worst] |= share[worst] > 0.97 and value[worst] > 0.2
            offered |= (value > 0.2) & (share > 0.97) & (bad >= 2)
            hard = clean[(value[clean] > -0.7) & (share[clean] < 0.9)]
            hard = hard[np.argsort(-value[hard], kind="stable")]
        else:
            hard = np.zeros(0, np.int64)
        yes = np.flatnonzero(offered)
        no = np.unique(np.concatenate([rng.choice(clean, min(RANDOM, len(clean)), replace=False), hard[:HARD], clean[np.argsort(-good[clean], kind="stable")[:FREQUENT]]]))
        no = no[~offered[no]]
        order = yes[np.argsort(-bad[yes], kind="stable")]
        chosen = np.concatenate([order[: LANDMARKS * 3 // 4], rng.choice(no, min(len(no), LANDMARKS // 4), replace=False)])
        landmarks = explicit([vocabulary[i] for i in chosen])
        kernel = np.float64(landmarks @ landmarks.T)
        level, axes = np.linalg.eigh(kernel)
        kept = level > 1e-6 * level.max()
        whiten = axes[:, kept] / np.sqrt(level[kept])
        basis = landmarks.T @ whiten.astype(np.float32)  # triples x features
        rows = np.concatenate([yes, no])
        x = project([vocabulary[i] for i in rows], basis)
        y = np.where(np.arange(len(rows)) < len(yes), 1.0, -1.0)
        cost = np.where(y > 0, COST * (1 + bad[rows]) ** GROWTH, COST * (1 + np.log1p(good[rows])))
        w = squared_hinge(x, y, cost)
        machine = Machine(basis @ w[:-1], float(w[-1]))
        del landmarks, basis, x
    value = machine.values(vocabulary)
    worst = np.array([value[rows].max() if len(rows) else machine.none for rows in held])
    machine.slope, machine.shift = logistic(worst, toxic.astype(np.float64))
    machine.knots = rising(worst, toxic.astype(np.float64))
    return machine


def words_of(text: str | None) -> list[str]:
    """The distinct plain words of a text."""
    text = text or ""
    return sorted({*map(plain, text.split()), *spelled_out(text)} - {""})


def learn(docs: DataFrame, labels: DataFrame, text: str = "text") -> Machine | None:
    """Trains on a bounded sample of the labelled texts that are not held out."""
    known = labels.where(~held_out() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    lengths = docs.select("doc_id", F.length(text).alias("chars")).join(known, "doc_id").groupBy("toxic").agg(F.countDistinct("doc_id").alias("n"), F.sum("chars").alias("chars"))
    share = {0: 1.0, 1: 1.0}
    for r in lengths.collect():
        share[r.toxic] = min(1.0, (TRAIN_TOXIC if r.toxic else TRAIN_CLEAN) / r.n, TRAIN_CHARS / max(1, r.chars or 0))
    draw = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col("toxic") == 1, F.lit(share[1])).otherwise(F.lit(share[0]))
    sample = F.broadcast(known.where(draw < share))  # about TRAIN_TOXIC + TRAIN_CLEAN rows
    picked = docs.select("doc_id", F.col(text).alias("text")).join(sample, "doc_id").orderBy("doc_id", "text")

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words_of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.string()))], names=["toxic", "words"])

    rows = picked.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(distinct_words, "toxic int, words array<string>").toLocalIterator()
    return train((r.words, r.toxic == 1) for r in rows)


def cached_words(number: int, machine: Machine) -> WordCache:
    """The worker's cache for one machine, by the number of its broadcast."""
    return live(("toxicity", number), lambda: WordCache(lambda words: machine.values([plain(w) for w in words])[:, None], 1))


def score(docs: DataFrame, machine: Machine | None, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability ``into`` that a text is toxic; replaces a column of that name."""
    kept = docs.drop(into)
    if machine is None:
        return kept.withColumn(into, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    number = shared._jbroadcast.id()
    schema = kept.withColumn(into, F.lit(None).cast("double")).schema

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        cache = cached_words(number, own)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                worst = np.array([rows.max(initial=own.none) for rows in cache.texts(texts)], np.float64)
                for i, t in enumerate(texts):
                    if t and (joined := spelled_out(t)):
                        worst[i] = max(worst[i], own.values(joined).max())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.probability(worst))], names=[*part.schema.names, into])

    return kept.mapInArrow(run, schema)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    found = score(docs.select("doc_id", "text"), learn(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def decent(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the texts that are predicted toxic; its columns stay."""
    into = unused("_toxicity", docs.columns)
    found = score(docs, learn(docs, labels), into=into)
    return found.where(F.col(into) < THRESHOLD).select(*docs.columns)
