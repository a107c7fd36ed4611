"""Word shingles and MinHash signatures of whole texts, computed on Arrow buffers with numpy.

Words are runs of other than ASCII white space. A text's shingles are its runs of ``k`` words; a text of fewer words has
one shingle of all of them, and one without words none. Shingles are 64-bit hashes of the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: UTF-8 bytes that are hashed at once, save for single longer texts.
CHUNK_BYTES = 2_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(11).integers(0, 1 << 63, 256, np.uint64) << np.uint64(1) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_ODD = np.random.default_rng(12).integers(0, 1 << 63, 64, np.uint64) << np.uint64(1) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, UTF-8 bytes, offsets) of stretches of a column of strings; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        to = min(to, len(texts))
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    first[cuts] |= inside[cuts]
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, offsets))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    kept = data[inside]
    at = np.flatnonzero(first[inside])
    lengths = np.diff(np.append(at, len(kept)))
    place = np.arange(len(kept)) - np.repeat(at, lengths)
    return mixed(np.add.reduceat(_BYTE[kept] * _powers(int(lengths.max()))[place], at) + lengths.astype(np.uint64)), counts


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles (repeats too), text after text, and their number in each text."""
    hashes, counts = words(data, offsets)
    starts = np.concatenate([[0], np.cumsum(counts)])
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), n)
    first = starts[text] + np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    total = np.zeros(len(text), np.uint64)
    for i in range(k):
        there = i < counts[text]
        total += np.where(there, hashes[np.minimum(first + i, max(0, len(hashes) - 1))] * _ODD[i], np.uint64(0)) if len(hashes) else 0
    return mixed(total + np.minimum(counts[text], k).astype(np.uint64)), n


def distinct(hashes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """The sorted set of shingles of each text."""
    return [np.unique(part) for part in np.split(hashes, np.cumsum(counts)[:-1])]


def minhash_values(hashes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The 32-bit values of all shingles under each of ``size`` hash functions."""
    for m in np.random.default_rng(13).integers(0, 1 << 63, size, np.uint64) << np.uint64(1) | np.uint64(1):
        yield ((hashes * m) >> np.uint64(32)).astype(np.uint32)


def minhash(hashes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Signatures (texts x size, 32-bit) of texts with at least one shingle each."""
    starts = np.cumsum(counts) - counts
    out = np.empty((len(counts), size), np.uint32)
    for i, values in enumerate(minhash_values(hashes, size)):
        out[:, i] = np.minimum.reduceat(values, starts)
    return out


def bands(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` values; keys of different bands differ."""
    n, size = signatures.shape
    grouped = signatures.reshape(n, size // rows, rows).astype(np.uint64)
    return mixed((grouped * _ODD[:rows]).sum(axis=2, dtype=np.uint64) + np.arange(size // rows, dtype=np.uint64) * np.uint64(_BASE))
