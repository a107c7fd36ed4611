"""Quality rules: statistics of whole texts, and gradient-boosted trees over them.

Base statistics are exact counts (words are runs of other than ASCII white space): words, code points in words, symbols,
lines equal to an earlier line, words in five-word windows that occur twice or more. A text fails by them alone if it has fewer
than ``LEAST_WORDS`` words or if more than ``MOST_REPEATED`` percent of them are repeated.

The other texts are judged by trees, trained here on quality labels (1 good, 0 bad) with a logistic loss: ``FEATURES``
of the statistics, cut into ``BINS`` bins, trees of depth ``DEPTH``. Along a feature of sign -1 the score never rises, so more
symbols or more repetition can't make a text better; a split keeps the two sides in order, and all below them
on their side of the middle. Trees are complete and flattened into arrays of node features, thresholds and values, so a
batch of texts goes down all trees at once.

Bound of training, a parameter: about ``SAMPLE`` labelled rows, picked by a hash of doc_id, whose statistics (not texts) reach
the driver; rows of the held-out fold are not learned from. All else covers whole texts of all documents. Words and lines are compared by
64-bit hashes of their bytes.

Rows: null and empty texts have no words and fail. If labels are missing, or all alike, what passes the base rules is
kept, with score 1. Rows without doc_id are judged too. Repeated rows are judged alike. Of contradicting labels the lower
counts. Other columns don't matter, or stay (``good``); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedspread.llm import shingles
from seedspread.llm.language_id import held_out

LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, SHRINK, LEAST_ROWS = 80, 3, 64, 0.15, 1.0, 5
THRESHOLD = 0.5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What trees see, and in which direction the score may go along it (-1: never up; 0: any).
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "digits_per_char": 0,
    "marks_per_word": -1,
    "distinct_share": 0,
    "words_per_line": 0,
    "other_letters": 0,
}


def _flags(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


_SYMBOL = _flags("#*$%&|<>")
_UPPER, _LOWER, _DIGIT = (_flags("".join(map(chr, range(a, b + 1)))) for a, b in ((65, 90), (97, 122), (48, 57)))
_MARK = np.zeros(256, bool)
_MARK[33:127] = ~(_UPPER | _LOWER | _DIGIT | _SYMBOL)[33:127]
_ODD = np.random.default_rng(31).integers(0, 1 << 63, WINDOW + 1, np.uint64) << np.uint64(1) | np.uint64(1)
_LINE_BYTE = np.random.default_rng(32).integers(0, 1 << 63, 256, np.uint64) << np.uint64(1) | np.uint64(1)
_LINE_BYTE[10] = 0


def _in_text(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Keys that are equal only for equal hashes in the same text."""
    return shingles.mixed(hashes + text.astype(np.uint64) * _ODD[WINDOW])


def _distinct(keys: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(text[np.unique(keys, return_index=True)[1]], minlength=n)


def repeated_words(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text, its words in windows of ``WINDOW`` that it holds at least twice."""
    starts = np.cumsum(counts) - counts
    n = np.maximum(0, counts - WINDOW + 1)
    text = np.repeat(np.arange(len(counts)), n)
    first = starts[text] + np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    total = np.zeros(len(text), np.uint64)
    for i in range(WINDOW):
        total += hashes[first + i] * _ODD[i] if len(text) else 0
    _, place, often = np.unique(_in_text(shingles.mixed(total), text), return_inverse=True, return_counts=True)
    again = first[often[place] > 1]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return inside[starts + counts] - inside[starts]


def lines(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text, its lines that hold a word, and how many of them equal an earlier one."""
    n = len(offsets) - 1
    starts = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    starts = starts[starts < len(data)]
    if not len(starts):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    hashes = np.add.reduceat(_LINE_BYTE[data] * shingles._powers(int(lengths.max()))[place], starts)
    held = np.logical_or.reduceat(in_word, starts)
    text = (np.searchsorted(offsets, starts, "right") - 1)[held]
    full = np.bincount(text, minlength=n)
    return full, full - _distinct(_in_text(shingles.mixed(hashes[held]), text), text, n)


def measured(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, features) of texts: a row for each, columns as in ``COUNTS`` and ``FEATURES``."""

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    in_word = ~shingles._SPACE[data]
    hashes, words = shingles.words(data, offsets)
    text = np.repeat(np.arange(len(words)), words)
    chars = total(in_word & (data & 0xC0 != 0x80))
    symbols, upper, lower, digits, marks = (total(m[data]) for m in (_SYMBOL, _UPPER, _LOWER, _DIGIT, _MARK))
    full, dup = lines(data, offsets, in_word)
    repeat = repeated_words(hashes, words)
    n = np.maximum(1, words)
    features = (
        np.log1p(words), chars / n, symbols / n, dup / np.maximum(1, full), repeat / n, upper / np.maximum(1, upper + lower), digits / np.maximum(1, chars),
        marks / n, _distinct(_in_text(hashes, text), text, len(words)) / n, words / np.maximum(1, full), total(data >= 0xC0) / np.maximum(1, chars),
    )
    return np.stack([words, chars, symbols, dup, repeat], axis=1), np.stack(features, axis=1)


def failing(counts: np.ndarray) -> np.ndarray:
    """Whether a text fails by the base rules alone."""
    return (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])


@dataclass
class Forest:
    """Complete trees in arrays (trees x nodes); the children of node i are 2 i + 1 and 2 i + 2."""

    offset: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros((len(x), len(self.feature)), np.int64)
        tree, row = np.arange(len(self.feature)), np.arange(len(x))[:, None]
        while self.feature.size and at[0:1].size and 2 * at[0, 0] + 2 < self.feature.shape[1]:
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        return self.offset + self.value[tree, at].sum(axis=1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, signs: np.ndarray, low: float, high: float) -> tuple[float, int, int, float, float]:
    """(gain, feature, bin, left value, right value) from sums of a node's gradients, curvatures and rows by feature and bin."""
    weight = lambda g, h: np.clip(-g / (h + SHRINK), low, high)
    loss = lambda v, g, h: g * v + (h + SHRINK) * v * v / 2
    gl, hl, nl = (np.cumsum(a, axis=1) for a in (g, h, n))
    gr, hr, nr = gl[:, -1:] - gl, hl[:, -1:] - hl, nl[:, -1:] - nl
    left, right = weight(gl, hl), weight(gr, hr)
    whole = weight(gl[:, -1:], hl[:, -1:])
    gain = loss(whole, gl[:, -1:], hl[:, -1:]) - loss(left, gl, hl) - loss(right, gr, hr)
    gain[(nl < LEAST_ROWS) | (nr < LEAST_ROWS) | (signs[:, None] * (right - left) < 0)] = -np.inf
    f, b = np.unravel_index(np.argmax(gain), gain.shape)
    return float(gain[f, b]), int(f), int(b), float(left[f, b]), float(right[f, b])


def grow(x: np.ndarray, y: np.ndarray, signs: np.ndarray) -> Forest:
    """Boosted trees for P(y = 1 | x) with logistic loss; ``signs``: the direction of each feature."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(cut, c, "left") for cut, c in zip(cuts, x.T, strict=True)], axis=1)  # bin b: at most cuts[b]
    nodes, mean = 2 ** (DEPTH + 1) - 1, np.clip(y.mean(), 1e-6, 1 - 1e-6)
    forest = Forest(float(np.log(mean / (1 - mean))), np.zeros((TREES, nodes), np.int32), np.full((TREES, nodes), np.inf), np.zeros((TREES, nodes)))
    margin = np.full(len(y), forest.offset)
    slots = np.arange(x.shape[1]) * BINS
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        gradient, curvature = p - y, np.maximum(p * (1 - p), 1e-9)
        at, bounds = np.zeros(len(y), np.int64), {0: (-np.inf, np.inf)}
        value = np.zeros(nodes)
        value[0] = -gradient.sum() / (curvature.sum() + SHRINK)
        for node in range(2**DEPTH - 1):
            low, high = bounds[node]
            rows = np.flatnonzero(at == node)
            value[2 * node + 1 : 2 * node + 3] = value[node]
            bounds[2 * node + 1] = bounds[2 * node + 2] = low, high
            to_right = np.zeros(len(rows), bool)
            if len(rows) >= 2 * LEAST_ROWS:
                place = (binned[rows] + slots).ravel()
                sums = [np.bincount(place, np.repeat(a, x.shape[1]), x.shape[1] * BINS).reshape(-1, BINS) for a in (gradient[rows], curvature[rows], np.ones(len(rows)))]
                gain, f, b, left, right = best_split(*sums, signs, low, high)
                if gain > 1e-9 and b < len(cuts[f]):
                    forest.feature[t, node], forest.threshold[t, node] = f, cuts[f][b]
                    value[2 * node + 1 : 2 * node + 3] = left, right
                    middle = (left + right) / 2
                    if signs[f]:
                        below, above = (low, middle), (middle, high)
                        bounds[2 * node + 1], bounds[2 * node + 2] = (below, above) if signs[f] > 0 else (above, below)
                    to_right = binned[rows, f] > b
            at[rows] = 2 * node + 1 + to_right
        forest.value[t] = RATE * value
        margin += forest.value[t][at]
    return forest


_STATISTICS = ", ".join([*(f"{c} long" for c in COUNTS), *(f"{c} double" for c in FEATURES)])


def statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, then ``COUNTS`` and ``FEATURES`` of every text."""
    kept = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in shingles.chunks(batch.column("_text")):
                counts, features = measured(data, offsets)
                own = batch.slice(at, len(counts))
                yield pa.RecordBatch.from_arrays([*(own.column(k) for k in keep), *map(pa.array, counts.T.astype(np.int64)), *map(pa.array, features.T)], names=[*keep, *COUNTS, *FEATURES])

    types = ", ".join(f"`{c}` {t}" for c, t in kept.drop("_text").dtypes)
    return kept.mapInArrow(run, f"{types}, {_STATISTICS}")


def learn(docs: DataFrame, labels: DataFrame, text: str = "text") -> Forest | None:
    """Trees from a bounded sample of the labelled texts that are not held out; None if there are not both labels."""
    known = labels.where(~held_out() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    share = min(1.0, SAMPLE / max(1, known.count()))
    draw = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    picked = docs.select("doc_id", text).join(F.broadcast(known.where(draw < share)), "doc_id")  # about SAMPLE rows
    rows = statistics(picked, text, ("doc_id", "quality")).orderBy("doc_id", *COUNTS).toPandas()
    y = rows["quality"].to_numpy(np.float64)
    if not len(y) or y.min() == y.max():
        return None
    return grow(rows[list(FEATURES)].to_numpy(np.float64), y, np.array(list(FEATURES.values())))


def score(docs: DataFrame, forest: Forest | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``COUNTS``, base_failed, score (that the text is good), kept of every text."""
    kept = docs.select(*keep, F.col(text).alias("_text"))
    types = ", ".join(f"`{c}` {t}" for c, t in kept.drop("_text").dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in shingles.chunks(batch.column("_text")):
                counts, features = measured(data, offsets)
                p = forest.probabilities(features) if forest else np.ones(len(counts))
                failed = failing(counts)
                own = batch.slice(at, len(counts))
                found = [*map(pa.array, counts.T.astype(np.int64)), pa.array(failed), pa.array(p), pa.array(~failed & (p >= THRESHOLD))]
                yield pa.RecordBatch.from_arrays([*(own.column(k) for k in keep), *found], names=[*keep, *COUNTS, "base_failed", "score", "kept"])

    return kept.mapInArrow(run, f"{types}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, score double, kept boolean")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, score of every document."""
    found = score(docs, learn(docs, labels))
    return found.select("doc_id", *COUNTS, "base_failed", "kept", "score")


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` whose texts are kept, with their own columns."""
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text"))
    found = score(whole, learn(docs, labels), keep=("_row",))
    return found.where("kept").select("_row.*")
