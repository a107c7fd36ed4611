"""Language identification by unigrams of pieces, summed over all segmentations.

A language gives each piece of a fixed public vocabulary a probability. The probability of a word is the sum, over all ways to
cut it into pieces, of the product of their probabilities: a forward pass over the word. A text's log-probability is
the sum over its words; the language with the highest wins, and the score is its share among all languages (uniform prior).

The probabilities are fitted by expectation maximisation (the same pass, forward and backward) on a bounded sample: at most
about ``TRAIN_DOCS`` distinct texts of each language with letters, fewer where they hold more than ``TRAIN_CHARS`` characters, at
least one, picked by a hash of the text among the rows that may be learned from; copies count once, and runs of more than
``FIT_LETTERS`` letters are not fitted on. All else covers whole texts of all documents, all pieces of letters of the
vocabulary, and all segmentations. Words are scored in bulk, by length, and kept for a worker's next batches; runs of more
than ``FIT_LETTERS`` letters are scored one by one, with rescaled sums.

Words are runs of letters (numerals such as fractions or Roman ones are none), in lower case, after a mark for their start. A letter outside the vocabulary counts as a piece of
its own with a fixed small probability.

Rows: a null text, or one without letters, is `und` with score 0, as is every text if nothing can be learned from. Rows
without doc_id are held out. Repeated rows and ties (the first language by name) give the same result. Other columns don't
matter; empty tables give empty results.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedspread.llm.wordcache import WordCache, live, releasing

TRAIN_DOCS, TRAIN_CHARS = 400, 4_000_000
ROUNDS = 3
FIT_LETTERS = 40
UNKNOWN, FLOOR = 1e-7, 1e-7
UNDETERMINED = "und"

_LETTERS = regex.compile(r"\p{L}+")
_START = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def held_out(key: str = "doc_id") -> Column:
    """Rows that nothing is learned from: a fixed fold by the checksum of the key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(True))


def unused(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores before it as it takes to clash with none of ``columns``."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def parts(word: str) -> list[str]:
    """The runs of letters of a word, marked."""
    return [_START + run for run in _LETTERS.findall(word.lower())]


def pieces(model: str) -> list[str]:
    """Pieces of letters of a sentencepiece model."""
    processor = sentencepiece.SentencePieceProcessor(model_file=model)
    named = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    return sorted({p.lower() for p in named if regex.fullmatch(rf"{_START}?\p{{L}}+|{_START}", p)})


class Lattice:
    """Finds the pieces inside words, for many words of a length at once, in open hash tables: as many as all pieces need."""

    BITS = 18

    def __init__(self, vocabulary: list[str]):
        self.size = len(vocabulary)
        self.longest = max(map(len, vocabulary), default=1)
        keys = np.array([self._hash(p) for p in vocabulary], np.uint64)
        self.tables = []
        left, rng = np.arange(len(keys)), np.random.default_rng(7)
        while len(left):
            odd = rng.integers(0, 1 << 63, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
            key, found = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, self.size, np.int32)
            slot = (keys[left] * odd >> np.uint64(64 - self.BITS)).astype(np.int64)
            _, first = np.unique(slot, return_index=True)
            key[slot[first]], found[slot[first]] = keys[left[first]], left[first]
            self.tables.append((odd, key, found))
            left = np.delete(left, first)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c)) & 0xFFFFFFFFFFFFFFFF
        return h

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), self.size, np.int32)
        for odd, key, found in self.tables:
            slot = (keys * odd >> np.uint64(64 - self.BITS)).astype(np.int64)
            out = np.where(key[slot] == keys, found[slot], out)
        return out

    def spans(self, words: list[str]) -> dict[tuple[int, int], np.ndarray]:
        """For words of one length: (start, end) -> piece in each word, ``size`` where there is none."""
        codes = np.array(words).view(np.uint32).reshape(len(words), -1).astype(np.uint64)
        out = {}
        for start in range(codes.shape[1]):
            h = np.zeros(len(words), np.uint64)
            for end in range(start + 1, min(start + self.longest, codes.shape[1]) + 1):
                h = h * _BASE + codes[:, end - 1]
                out[start, end] = self.find(h)
        return out

    def log_total(self, word: str, table: np.ndarray) -> np.ndarray:
        """Log of the sum over all segmentations of one word of any length, in each language; sums are rescaled on the way."""
        codes = np.array([ord(c) for c in word], np.uint64)
        h, ids = np.zeros(len(codes), np.uint64), np.full((self.longest, len(codes)), self.size, np.int32)
        for k in range(min(self.longest, len(codes))):  # ids[k, end]: the piece of k + 1 letters that ends there
            h = h[: len(codes) - k] * _BASE + codes[k:]
            ids[k, k:] = self.find(h)
        window, log = np.ones((1, table.shape[1])), np.zeros(table.shape[1])  # sums of the last prefixes, the newest first
        for end in range(len(codes)):
            p = table[ids[: len(window), end]]
            p[0] = np.where(p[0] > 0, p[0], UNKNOWN)
            total = (window * p).sum(axis=0)
            window = np.concatenate([np.ones((1, table.shape[1])), window[: self.longest - 1] / total])
            log += np.log(total)
        return log


def by_length(words: list[str], most: int = 20_000) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(places, words) of words of equal length, ``most`` at once."""
    groups = defaultdict(list)
    for i, w in enumerate(words):
        groups[len(w)].append(i)
    for places in groups.values():
        for k in range(0, len(places), most):
            yield np.array(places[k : k + most]), [words[i] for i in places[k : k + most]]


def forward(spans: dict[tuple[int, int], np.ndarray], length: int, table: np.ndarray) -> list[np.ndarray]:
    """Sums over segmentations of each prefix: one array (words x languages) for each length. ``table``'s last row is 0."""
    n, longest = len(next(iter(spans.values()))), max(end - start for start, end in spans)
    alpha = [np.ones((n, table.shape[1]))]
    for end in range(1, length + 1):
        total = 0
        for start in range(max(0, end - longest), end):
            p = table[spans[start, end]]
            total = total + alpha[start] * (np.where(p > 0, p, UNKNOWN) if start == end - 1 else p)
        alpha.append(total)
    return alpha


def fit(lattice: Lattice, counts: dict[str, float]) -> np.ndarray:
    """Piece probabilities of one language, by expectation maximisation on its words."""
    words = [w for w in counts if len(w) <= FIT_LETTERS + 1]
    often = np.array([counts[w] for w in words])
    p = np.append(np.full(lattice.size, 1 / lattice.size), 0.0)
    for _ in range(ROUNDS):
        expected = np.zeros(lattice.size + 1)
        for places, group in by_length(words):
            length, spans = len(group[0]), lattice.spans(group)
            alpha = forward(spans, length, p[:, None])
            beta = [np.ones(len(group))] * (length + 1)
            for start in range(length - 1, -1, -1):
                total = 0
                for end in range(start + 1, min(start + lattice.longest, length) + 1):
                    q = p[spans[start, end]]
                    total = total + (np.where(q > 0, q, UNKNOWN) if end == start + 1 else q) * beta[end]
                beta[start] = total
            weight = often[places] / alpha[length][:, 0]
            for (start, end), ids in spans.items():
                expected += np.bincount(ids, alpha[start][:, 0] * p[ids] * beta[end] * weight, lattice.size + 1)
        p = expected[:-1] / max(expected[:-1].sum(), 1e-300) + FLOOR
        p = np.append(p / p.sum(), 0.0)
    return p


def learn(docs: DataFrame, vocabulary: list[str], text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their table of piece probabilities, from rows that are not held out and have a language."""
    known = docs.where(~held_out() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    known = known.withColumn("hash", F.xxhash64("text"))
    draw = F.pmod("hash", F.lit(1 << 20)) / float(1 << 20)
    texts = known.groupBy("lang", "hash").agg(F.max(F.length("text")).alias("chars"))
    found = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.min(draw).alias("least")).collect()
    languages = sorted(r.lang for r in found)
    if not languages:
        return [], np.zeros((len(vocabulary) + 1, 0))
    limit = [(r.lang, min(1.0, TRAIN_DOCS / r.n, TRAIN_CHARS / max(1, r.chars)), r.least) for r in found]
    limit = F.broadcast(docs.sparkSession.createDataFrame(limit, "_lang string, share double, least double"))  # a row for each language
    drawn = known.join(limit, F.col("lang") == F.col("_lang")).where((draw < F.col("share")) | (draw == F.col("least"))).select("lang", "text").distinct()
    sample = drawn.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))
    words: dict[str, dict[str, float]] = {name: defaultdict(float) for name in languages}
    for r in sample.where("word <> ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        for part in parts(r.word):
            words[r.lang][part] += r.n
    lattice = Lattice(vocabulary)
    return languages, np.stack([fit(lattice, words[name] or {_START: 1.0}) for name in languages], axis=1)


def cached_words(number: int, vocabulary: list[str], table: np.ndarray) -> WordCache:
    """The worker's cache for one fitted table, by the number of its broadcast."""

    def make() -> WordCache:
        lattice = Lattice(vocabulary)
        return WordCache(lambda words: log_probabilities(words, lattice, table), table.shape[1] + 1)

    return live(("language", number), make)


def identify(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its score; learns from ``docs`` itself."""
    vocabulary = pieces(model)
    languages, table = learn(docs, vocabulary, text)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, table))
    number = shared._jbroadcast.id()
    kept = docs.drop(*into)
    schema = kept.withColumn(into[0], F.lit(None).cast("string")).withColumn(into[1], F.lit(None).cast("double")).schema

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cached_words(number, *shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                names, scores = [], []
                for rows in cache.texts(part.column(part.schema.get_field_index(text)).to_pylist()):
                    total = rows.sum(axis=0, dtype=np.float64)
                    if not languages or not total[-1]:
                        names.append(UNDETERMINED)
                        scores.append(0.0)
                    else:
                        best = int(np.argmax(total[:-1]))
                        names.append(languages[best])
                        scores.append(float(1 / np.exp(np.minimum(0, total[:-1] - total[best])).sum()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, *into])

    return kept.mapInArrow(run, schema)


def log_probabilities(words: list[str], lattice: Lattice, table: np.ndarray) -> np.ndarray:
    """Rows: log-probability in each language, then the number of letter runs (0: no letters)."""
    out = np.zeros((len(words), table.shape[1] + 1), np.float32)
    cut, owner = [], []
    for i, word in enumerate(words):
        for part in parts(word):
            cut.append(part)
            owner.append(i)
    owner_of = np.array(owner, np.int64)
    for places, group in by_length(cut):
        if len(group[0]) <= FIT_LETTERS + 1:
            log = np.log(forward(lattice.spans(group), len(group[0]), table)[-1])
        else:
            log = np.stack([lattice.log_total(word, table) for word in group])
        np.add.at(out, (owner_of[places], slice(None)), np.append(log, np.ones((len(group), 1)), axis=1))
    return out


def predicted(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    found = identify(docs.select("doc_id", "text", "lang"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, model: str, least: float = 0.5) -> DataFrame:
    """``docs`` without texts whose language can't be determined with a score of ``least``; its columns stay."""
    into = unused("_lang_pred", docs.columns), unused("_lang_score", docs.columns)
    found = identify(docs, model, into=into)
    return found.where((F.col(into[0]) != UNDETERMINED) & (F.col(into[1]) >= least)).select(*docs.columns)
