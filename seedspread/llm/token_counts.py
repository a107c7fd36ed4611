"""Token counts by a linear longest-match automaton.

Greedy word-piece tokenization takes, from the left, the longest vocabulary piece that fits. The automaton is the trie of the
vocabulary with failure links: where no child fits the next byte, the pieces that are sure by then are popped - only their
precomputed number is added - and matching goes on in the node for the rest, so a word takes time in proportion to its
length, and no piece is ever built. Pieces may stand anywhere in a word.

Words: a text in lower case is cut at white space, and there into runs of letters, of digits and of other characters.
They are matched as UTF-8 bytes; each byte is a piece of the vocabulary, so every word has a tokenization.

Rows: null, empty and blank texts have 0 tokens. Repeated rows and ties count alike; other columns stay. Empty tables give
empty results. Texts are counted whole, words of any length too.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedspread.llm.bpe import byte_symbols
from seedspread.llm.wordcache import WordCache, live

END = "</w>"
_RUNS = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+|.", re.S)


def vocabulary(path: str) -> set[bytes]:
    """Pieces, as bytes and without end marks, of a byte-level vocabulary file of the tokenizers library."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    symbols, special = byte_symbols(), {a["content"] for a in spec.get("added_tokens", [])}
    named = (t.removesuffix(END) for t in spec["model"]["vocab"] if t not in special)
    return {bytes(map(symbols.__getitem__, t)) for t in named if t and all(c in symbols for c in t)} | {bytes([b]) for b in range(256)}


class LongestMatch:
    """Counts the pieces of greedy longest matching."""

    def __init__(self, pieces: set[bytes]):
        self.child: dict[int, int] = {}  # node << 8 | byte -> node
        whole = [False]
        for piece in sorted(pieces):
            node = 0
            for byte in piece:
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = len(whole)
                    whole.append(False)
                node = self.child[key]
            whole[node] = True
        children: list[list[int]] = [[] for _ in whole]
        for key in self.child:
            children[key >> 8].append(key & 255)
        self.rest, self.popped = [-1] * len(whole), [0] * len(whole)  # failure link, and the number of pieces it pops
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for byte in children[node]:
                below = self.child[node << 8 | byte]
                queue.append(below)
                if whole[below]:
                    self.rest[below], self.popped[below] = 0, 1
                    continue
                at, popped = self.rest[node], self.popped[node]
                while at >= 0 and (at << 8 | byte) not in self.child:
                    at, popped = self.rest[at], popped + self.popped[at]
                if at >= 0:
                    self.rest[below], self.popped[below] = self.child[at << 8 | byte], popped

    def count(self, word: bytes) -> int:
        child, rest, popped = self.child.get, self.rest, self.popped
        node = total = 0
        for byte in word:
            while (to := child(node << 8 | byte)) is None:
                total += popped[node]
                node = rest[node]
            node = to
        while node:
            total += popped[node]
            node = rest[node]
        return total

    def counts(self, words: list[str]) -> np.ndarray:
        """Pieces of each white-space word, as a column."""
        return np.array([sum(self.count(run.encode()) for run in _RUNS.findall(w.lower())) for w in words], np.float32)[:, None]


def cached_words(path: str) -> WordCache:
    """One automaton, with its cache of words, per worker process."""
    return live(("counts", path), lambda: WordCache(LongestMatch(vocabulary(path)).counts, 1))


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of ``text``; replaces a column of that name."""
    kept = docs.drop(into)
    schema = kept.withColumn(into, F.lit(None).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cached_words(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [int(rows.sum(dtype=np.float64)) for rows in cache.texts(part.column(part.schema.get_field_index(text)).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.int64())], names=[*part.schema.names, into])

    return kept.mapInArrow(run, schema)
