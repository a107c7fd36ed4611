"""Importance resampling towards a target distribution of hashed n-grams.

Features of a text are its runs of 1 to n consecutive words; their buckets are checksums of their bytes. With the counts of
all documents and of all target texts, a bucket's gain is the log-ratio of its smoothed shares, and a text's weight the
sum over its features. Gumbel noise from a hash of doc_id turns the highest scores into a draw without replacement.

Long texts are skewed work: those above ``CHUNK`` bytes are cut at word boundaries into chunks, each of which owns the words that
start in its stretch of ``CHUNK`` bytes and carries the n - 1 words after them, so that every feature is counted once, where
it starts. Chunks are dealt over all tasks, and their counts and weights summed by document. Shorter texts stay where they were read.

Buckets (a parameter) are all that reaches the driver: their gains. Ranks come from one range-partitioned sort and the
sizes of its partitions.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became lower case, i.e. runs of ASCII letters, digits and all other characters.

Rows: null and empty texts have no features and weigh 0; they are scored, but are never drawn (fewer than ``least_words``). Rows
without doc_id count as having an empty one, and lose ties. Repeated rows all count, score alike, and take neighbouring ranks. Other columns
don't matter; an empty table gives an empty result, an empty target the gains of smoothing alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedspread.llm import shingles
from seedspread.llm.session import checkpointed

CHUNK = 1 << 18
#: Bytes of a word beyond which it is hashed by itself.
LONG_WORD = 48

_INSIDE = np.ones(256, bool)
_INSIDE[:0x30] = _INSIDE[0x3A:0x41] = _INSIDE[0x5B:0x61] = _INSIDE[0x7B:0x80] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> 1 ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def advanced(state: np.ndarray, data: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the bytes ``data[at : at + lengths]`` of each."""
    order = np.argsort(-lengths, kind="stable")
    s, at, left = state[order], at[order], lengths[order]
    shorter = len(left) - np.cumsum(np.bincount(np.minimum(left, LONG_WORD), minlength=LONG_WORD + 1))  # longer than i
    for i in range(min(LONG_WORD, int(left.max(initial=0)))):
        n = int(shorter[i])
        s[:n] = _CRC[(s[:n] ^ data[at[:n] + i]) & 255] ^ s[:n] >> 8
    for k in np.flatnonzero(left > LONG_WORD).tolist():
        s[k] = ~np.uint32(zlib.crc32(data[at[k] + LONG_WORD : at[k] + left[k]], int(~s[k])))
    out = np.empty_like(s)
    out[order] = s
    return out


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end, in one text's bytes."""
    inside = np.concatenate([[False], _INSIDE[data], [False]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    return change[::2], change[1::2]


def features(data: np.ndarray, offsets: np.ndarray, owned: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(checksum, text) of the features that start at the first ``owned`` words of each text (-1: all), and the texts' owned words."""
    data = _LOWER[data]
    inside = _INSIDE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    words = np.diff(np.searchsorted(starts, offsets))
    text = np.repeat(np.arange(len(words)), words)
    number = np.arange(len(starts)) - np.repeat(np.cumsum(words) - words, words)
    owned = np.where(owned < 0, words, owned)
    first = np.flatnonzero(number < owned[text])
    state = np.full(len(first), 0xFFFFFFFF, np.uint32)
    sums, texts = [], []
    for i in range(n):
        there = number[first] + i < words[text[first]]
        first, state = first[there], state[there]
        if i:
            state = _CRC[(state ^ 32) & 255] ^ state >> 8
        state = advanced(state, data, starts[first + i], ends[first + i] - starts[first + i])
        sums.append(~state)
        texts.append(text[first])
    return np.concatenate(sums), np.concatenate(texts), owned


def _keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def pieces(docs: DataFrame, n: int, text: str = "text", key: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """doc_id, hash, no, owned, text: whole texts (owned -1), and the chunks of long ones dealt over all tasks.

    ``hash``: of a long text, null for others; ``no``: the chunk's number in its text."""
    all_ = _keyed(docs, text, key)
    short = all_.where(F.octet_length("text") <= chunk).select("doc_id", F.lit(None).cast("long").alias("hash"), F.lit(0).cast("long").alias("no"), F.lit(-1).cast("long").alias("owned"), "text")
    long = all_.where(F.octet_length("text") > chunk).select("doc_id", F.xxhash64("text").alias("hash"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data = np.frombuffer(batch.column("text")[row].as_buffer(), np.uint8)
                starts, ends = word_places(data)
                stretch = starts // chunk
                firsts = np.searchsorted(stretch, np.unique(stretch))
                firsts = firsts if len(firsts) else np.zeros(1, np.int64)
                for no, (a, b) in enumerate(zip(firsts, np.append(firsts[1:], len(starts)), strict=True)):
                    last = min(b + n - 1, len(starts)) - 1
                    piece = data[starts[a] : ends[last]].tobytes().decode() if len(starts) else ""
                    own = [pa.array([no], pa.int64()), pa.array([int(b - a)], pa.int64()), pa.array([piece])]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, 1), batch.column("hash").slice(row, 1), *own], names=["doc_id", "hash", "no", "owned", "text"])

    types = f"doc_id {dict(all_.dtypes)['doc_id']}, hash long, no long, owned long, text string"
    dealt = long.mapInArrow(cut, types).repartition(F.xxhash64("doc_id", "hash", "no"))
    return short.unionByName(dealt)


def bucket_counts(found: DataFrame, n: int, buckets: int) -> DataFrame:
    """bucket, count of all features of ``pieces``; each task sums its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            own = batch.column("owned").to_numpy()
            for at, data, offsets in shingles.chunks(batch.column("text")):
                sums, _, _ = features(data, offsets, own[at : at + len(offsets) - 1], n)
                total += np.bincount(sums % buckets, minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": there.astype(np.int64), "count": total[there]})

    return found.select("owned", "text").mapInArrow(run, "bucket long, count long").groupBy("bucket").agg(F.sum("count").alias("count"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket, from ``bucket_counts`` of the two sides; ``buckets`` rows reach the driver."""
    both = source.select("bucket", F.col("count").alias("s"), F.lit(0).alias("t")).unionByName(target.select("bucket", F.lit(0).alias("s"), F.col("count").alias("t")))
    every = source.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).alias("s"), F.lit(0).alias("t"))
    counted = checkpointed(both.unionByName(every).groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t")))
    whole = counted.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    ratio = ((F.col("t") + 1) * (whole.s + buckets)) / ((F.col("s") + 1) * (whole.t + buckets))
    rows = counted.select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain")).collect()
    out = np.zeros(buckets, np.int64)
    out[[r.bucket for r in rows]] = [r.gain for r in rows]
    return out


def weights(found: DataFrame, gain: np.ndarray, n: int) -> DataFrame:
    """doc_id, n_words, n_features, weight of each document of ``pieces``; chunks are summed."""
    shared = found.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_gain = shared.value
        for batch in batches:
            own = batch.column("owned").to_numpy()
            for at, data, offsets in shingles.chunks(batch.column("text")):
                size = len(offsets) - 1
                sums, text, words = features(data, offsets, own[at : at + size], n)
                weight = np.bincount(text, own_gain[sums % len(own_gain)], size).astype(np.int64)  # exact below 2 ** 53
                part = batch.slice(at, size)
                columns = [*(part.column(c) for c in ("doc_id", "hash", "no")), pa.array(words.astype(np.int64)), pa.array(np.bincount(text, minlength=size)), pa.array(weight)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "hash", "no", "n_words", "n_features", "weight"])

    scored = found.mapInArrow(run, f"doc_id {dict(found.dtypes)['doc_id']}, hash long, no long, n_words long, n_features long, weight long")
    scored = checkpointed(scored)
    sums = ["n_words", "n_features", "weight"]
    copies = F.sum((F.col("no") == 0).cast("long")).alias("copies")
    long = scored.where("hash is not null").groupBy("doc_id", "hash").agg(copies, *[F.sum(c).alias(c) for c in sums])
    long = long.select("doc_id", *[(F.col(c) / F.col("copies")).cast("long").alias(c) for c in sums], F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
    return scored.where("hash is null").select("doc_id", *sums).unionByName(long.drop("_copy"))


def ranked(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with rank 1, 2, 3... in an order; no task sees more than its range of it."""
    placed = checkpointed(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    sizes = placed.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect()  # one for each partition
    before, offsets = 0, []
    for r in sorted(sizes, key=lambda r: r._part):
        offsets.append((r._part, before))
        before += r.n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(offsets, "_part long, _before long"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", F.shiftright("_at", 33)).join(offsets, "_part").withColumn("rank", F.col("_before") + inside + 1).drop("_at", "_part", "_before")


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, least_words: int = 20) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null for those that are not drawn."""
    found = pieces(docs, n)
    gain = gains(bucket_counts(found, n, buckets), bucket_counts(pieces(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), n), n, buckets), buckets)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substr(F.sha2(key, 256), F.lit(1), F.lit(8)), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = checkpointed(weights(found, gain, n).withColumn("score", F.col("weight") + noise))
    enough = scored.where(F.col("n_words") >= least_words)
    drawn = enough.count() * percent // 100
    placed = ranked(enough, F.desc("score"), F.asc_nulls_last("doc_id"))
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
