"""N-gram Jaccard self-join of documents, with Bayesian pruning of candidates.

1. Equal texts are one class (md5 of the text); their least doc_id stands for them, so copies are never compared.
2. MinHash signatures of the word shingles; pairs that agree on a band are candidates. With 32 bands of 4 values, a pair at
   the threshold of 0.8 has no common band with probability 5e-8.
3. Candidates' signatures are compared 16 values at a time. A pair is dropped as soon as the posterior probability that its
   Jaccard similarity reaches the threshold, given the matches so far and a uniform prior, is below 1e-7. The low 16 bits of
   each value travel: two that differ match with probability 2 ** -16, which can only keep a pair.
4. Surviving candidates are joined to clusters; within a cluster, every pair is verified on its exact shingle sets. That
   covers all surviving candidates. Each document's links and spanning links come from there.

Groups (bands or clusters) of any size are compared by blocks (see blocks.py): none is gathered in one task, capped or
expanded into rows of pairs.

Rows: null and empty texts, and texts without words, have no links and no copies. Texts of fewer than five words have one
shingle, of all their words. Rows that repeat (doc_id, text) are one document; rows without a doc_id are left out. Other
columns don't matter. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedspread.llm import blocks, shingles
from seedspread.llm.components import components
from seedspread.llm.session import checkpointed, small_side

WORDS = 5
THRESHOLD = 0.8
SIGNATURE, BAND = 128, 4
STEP, TOLERANCE = 16, 1e-7
#: Members of a part: of a band, where signatures are compared, and of a cluster, where texts are.
SIGNATURE_BLOCK, TEXT_BLOCK = 256, 128


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For 16, 32, ... compared values, the fewest matches at which a pair stays.

    With a uniform prior, P(similarity >= t | m of n match) = P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(STEP, SIGNATURE + 1, STEP):
        below = 0.0
        for m in range(n + 2):
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                out.append(m)
                break
    return out


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, digest of the text, signature and band keys; the last two are null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for at, data, offsets in shingles.chunks(texts):
                hashes, counts = shingles.shingles(data, offsets, words)
                full = np.flatnonzero(counts)
                raw: list[bytes | None] = [None] * len(counts)
                keys: list[np.ndarray | None] = [None] * len(counts)
                if len(full):
                    signed = shingles.minhash(hashes, counts[full], SIGNATURE)
                    for i, s, b in zip(full.tolist(), signed.astype("<u2"), shingles.bands(signed, BAND).view(np.int64), strict=True):
                        raw[i], keys[i] = s.tobytes(), b
                part = batch.slice(at, len(counts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), pa.array(raw, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "digest", "signature", "bands"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text", F.unhex(F.md5("text")).alias("digest"))
    return rows.mapInArrow(run, "doc_id long, digest binary, signature binary, bands array<long>")


def surviving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links (a, b) of the candidates that Bayesian pruning leaves, unit by unit."""
    least = least_matches()
    for table, starts in blocks.units(batches, "bucket", "low", "high"):
        signed = blocks.binary_matrix(table.column("signature"), np.dtype("<u2"), SIGNATURE)
        ids = table.column("rep").to_numpy()
        left, right = [], []
        for i, j in blocks.pairs(table, starts):
            matches = np.zeros(len(i), np.int16)
            for step, floor in enumerate(least):
                at = slice(step * STEP, (step + 1) * STEP)
                for c in range(at.start, at.stop):
                    matches += signed[i, c] == signed[j, c]
                stay = matches >= floor
                i, j, matches = i[stay], j[stay], matches[stay]
            left.append(i)
            right.append(j)
        if left:
            root = blocks.forest(len(ids), np.concatenate(left), np.concatenate(right))
            linked = np.flatnonzero(root != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[root[linked]])], names=["a", "b"])


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted sets, by a product of 0/1 matrices over the shared values."""
    values, codes, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = often[codes] > 1
    row, codes = row[shared], (np.cumsum(often > 1) - 1)[codes[shared]]
    order = np.argsort(codes, kind="stable")
    row, codes = row[order], codes[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = max(1, 8_000_000 // len(sets))
    for at in range(0, int((often > 1).sum()), width):
        lo, hi = np.searchsorted(codes, [at, at + width])
        block = np.zeros((len(sets), min(width, int(codes[hi - 1]) - at + 1)), np.float32)
        block[row[lo:hi], codes[lo:hi] - at] = 1
        out += block @ block.T
    return out


def verified(words: int, threshold: float):
    """Each member's exact links within a unit: rep, n_links (documents), n_texts, and a member it is linked with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in blocks.units(batches, "cluster", "low", "high"):
            ids, copies, part, low, high = (table.column(c).to_numpy() for c in ("rep", "copies", "part", "low", "high"))
            texts = blocks.strings(table, "text")
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                sets: list[np.ndarray] = []
                for _, data, offsets in shingles.chunks(texts.slice(a, b - a)):
                    sets += shingles.distinct(*shingles.shingles(data, offsets, words))
                size = np.array([len(s) for s in sets], np.float64)
                common = intersections(sets).astype(np.float64)
                union = size[:, None] + size[None, :] - common
                linked = common >= threshold * union - 1e-9
                np.fill_diagonal(linked, False)
                if low[a] != high[a]:
                    linked &= part[a:b, None] != part[None, a:b]
                own, once = ids[a:b], np.zeros(b - a, bool)
                once[np.unique(own, return_index=True)[1]] = True  # rows that repeat count once
                linked &= once[:, None] & once[None, :]
                root = blocks.forest(b - a, *np.nonzero(linked))
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array((linked * copies[None, a:b]).sum(axis=1).astype(np.int64)), pa.array(linked.sum(axis=1).astype(np.int64)), pa.array(own[root])], names=["rep", "n_links", "n_texts", "near"])

    return run


def jaccard_join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document (doc_id and text): doc_id, copy_of (least doc_id with the same text), n_links (other documents at or above
    ``threshold``, copies included), n_texts (other texts), class_id (least doc_id that links reach).

    ``threshold``: 0.8 or more, for which the bands are laid out."""
    return joined(docs, words, threshold).drop("digest", "repeats")


def joined(docs: DataFrame, words: int, threshold: float) -> DataFrame:
    """``jaccard_join`` with the digest (md5) of the text and the number of rows that repeat the document."""
    if threshold < THRESHOLD:
        raise ValueError("the bands are laid out for thresholds of 0.8 and more")
    signed = checkpointed(signatures(docs, words))
    rows = signed.groupBy("doc_id", "digest").agg(F.first(F.col("signature").isNotNull()).alias("full"), F.count(F.lit(1)).alias("repeats"))
    full = rows.where("full")
    reps = checkpointed(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    own = signed.where("signature is not null").withColumnRenamed("doc_id", "rep").join(reps, ["rep", "digest"]).dropDuplicates(["rep", "digest"])

    banded = own.select("rep", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("same"), F.min("rep").alias("least")).where("n > 1")
    shared = shared.groupBy("n", "same", "least").agg(F.min("bucket").alias("bucket"))  # bands with the same members count once
    shared = checkpointed(shared.select("bucket", "n"))
    members = checkpointed(banded.join(small_side(shared), "bucket"))
    dealt = blocks.deal(members.join(own.select("rep", "signature"), "rep"), "bucket", F.col("n"), "rep", SIGNATURE_BLOCK, ["rep", "signature"])
    links = checkpointed(blocks.gathered(dealt, "bucket", "rep", surviving, "a long, b long").distinct())

    clusters = components(links).withColumnRenamed("node", "rep").withColumnRenamed("component", "cluster")
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    placed = checkpointed(clusters.join(sizes, "cluster").join(reps.select("rep", "digest", "copies"), "rep"))
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text", F.unhex(F.md5("text")).alias("digest"))
    texts = texts.join(small_side(placed), ["rep", "digest"])
    dealt = blocks.deal(texts, "cluster", F.col("n"), "rep", TEXT_BLOCK, ["rep", "copies", "text"])
    found = checkpointed(blocks.gathered(dealt, "cluster", "rep", verified(words, threshold), "rep long, n_links long, n_texts long, near long"))
    classes = components(found.where("rep <> near").select(F.col("rep").alias("a"), F.col("near").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("n_links").alias("n_links"), F.sum("n_texts").alias("n_texts"))
    known = reps.join(counts, "rep", "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("digest", "rep", "copies", "n_links", "n_texts", "component")
    out = rows.join(known, "digest", "left")
    return out.select(
        "doc_id",
        "digest",
        "repeats",
        F.when(F.col("full"), F.col("rep")).otherwise(F.col("doc_id")).alias("copy_of"),
        F.when(F.col("full"), F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).otherwise(0).cast("long").alias("n_links"),
        F.when(F.col("full"), F.coalesce("n_texts", F.lit(0))).otherwise(0).cast("long").alias("n_texts"),
        F.when(F.col("full"), F.coalesce("component", "rep")).otherwise(F.col("doc_id")).alias("class_id"),
    )


def one_of_each_class(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each class of near duplicates: the one with the least doc_id, once. Its columns stay.

    Of rows that repeat doc_id and text, the one whose columns have the least hash stays. Other texts under the same doc_id are
    documents of their own. Rows without a doc_id are not compared and stay."""
    found = checkpointed(joined(docs, words, threshold).where("doc_id <> class_id or repeats > 1"))
    key, digest = F.col("doc_id").cast("long"), F.unhex(F.md5("text"))
    same = lambda other: (key == other["_id"]) & digest.eqNullSafe(other["_digest"])
    named = found.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), (F.col("doc_id") != F.col("class_id")).alias("_gone"))
    some = small_side(named)
    once = docs.join(some, same(some), "left_anti")
    again = small_side(named.where("not _gone"))
    rows = F.struct(*docs.columns)
    kept = docs.join(again, same(again), "left_semi").groupBy(key.alias("_id"), digest.alias("_digest")).agg(F.min_by(rows, F.xxhash64(*docs.columns)).alias("_row"))
    return once.unionByName(kept.select("_row.*"))
