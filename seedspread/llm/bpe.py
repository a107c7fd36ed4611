"""Byte-pair encoding by last-token states on a trie of words, and decoding.

The encoding of any prefix of a word is fixed by its *last* token: the encoding of ``w[:i]`` is the encoding of
``w[:i - len(t)]`` followed by ``t``, where ``t`` is the only vocabulary token that ends at ``i`` and that byte-pair
merging would leave beside the last token before it. So one state (the last token) per prefix is enough. The distinct
words of a batch are put in a trie - sorted, so that a stack of states is a depth-first walk - and the states of a
shared prefix are computed once. An automaton over the vocabulary (a trie with failure links) names the longest token that
ends at a position, and each token names the next shorter one that is its suffix, so only tokens that do end there are tried.

Rows: a null text counts as empty and has no tokens. Texts of any length are encoded whole, each row on its own, so
repeated rows, ties and extra columns do not matter. Special tokens' strings in a text become their ids, as in the
tokenizers library with its defaults.
"""

from __future__ import annotations

import gc
import hashlib
import json
from collections import defaultdict
from collections.abc import Collection, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedspread.llm.wordcache import live

#: Of the cache of a ``ChunkEncoder``.
CACHE_BYTES, ENTRY = 14_000_000, 200
#: Pairs of tokens, and automaton steps beside the vocabulary's own, that are remembered.
CACHE_PAIRS, CACHE_STEPS = 120_000, 100_000
#: Text that is encoded at once, in characters.
CHUNK_CHARS = 600_000

#: Fixed values of the byte-level scheme: the word pattern.
WHITE = r"\t-\r \x85\xa0  -     　"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"

#: Marks that end a word and are no part of a contraction.
STOPS = ".,;:!?"

_NEVER = 1 << 30


def byte_symbols() -> dict[str, int]:
    """Printable stand-in -> byte, as byte-level vocabularies spell them."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def _key(stretch: str) -> str:
    return stretch[1:] if stretch[0] == " " and len(stretch) > 1 and not stretch[1].isspace() else " " + stretch


def _stretch(key: str) -> str:
    return key[1:] if key[0] == " " else " " + key


class ChunkEncoder:
    """Cuts texts for a byte-level vocabulary and remembers the ids of stretches that come up again.

    Texts are cut before each single space that a word follows: always a border of words of the pattern, and far cheaper to
    find. A stretch's key is what follows its space; a stretch without one, as at the start of a text, has a space put before it.
    ``encode_fresh`` of a subclass encodes words; ``added``: special tokens' strings and ids; ``size``: of the vocabulary;
    ``most``: bytes of new stretches (``ENTRY`` more for each) after which those are forgotten that have not come up since the last time."""

    def __init__(self, added: dict[str, int], size: int, most: int = CACHE_BYTES):
        self.added, self.size, self.most = added, size, most
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.pattern = regex.compile(WORD)
        self.gap = regex.compile(rf" (?=[^{WHITE}])")
        self.odd_gap = regex.compile(rf" (?:[{WHITE}]|$)")
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None

    def encode_fresh(self, keys: set[str]) -> dict[str, bytes]:
        """Packed ids of words of the pattern, given by their keys."""
        raise NotImplementedError

    def learn(self, keys: set[str]) -> None:
        """Makes stretches known; one may hold several words of the pattern."""
        if self.held > self.most:
            self.words, self.older, self.held = {}, self.words, 0
        new = keys.difference(self.words)
        back = new & self.older.keys()
        self._keep(back, map(self.older.__getitem__, back))
        fresh, several = set(), {}
        for key in new - back:
            if key.isalpha() or key[0] == " " and key[1:].isalpha():
                fresh.add(key)
            elif (head := key.rstrip(STOPS)).isalpha():  # a word and its stops: two words of the pattern
                several[key] = head, " " + key[len(head) :]
            else:
                several[key] = list(map(_key, self.pattern.findall(_stretch(key))))
        fresh = fresh.union(*several.values()).difference(self.words).difference(self.older)
        found = self.encode_fresh(fresh)
        self._keep(found.keys(), found.values())
        known, older = self.words.get, self.older.get
        self._keep(several.keys(), [b"".join([known(k) or older(k) for k in ks]) for ks in several.values()])

    def _keep(self, keys: Collection[str], packed: Iterable[bytes]) -> None:
        found = dict(zip(keys, packed, strict=True))
        self.words.update(found)
        self.held += sum(map(len, found)) + sum(map(len, found.values())) + ENTRY * len(found)

    def keys(self, text: str) -> list[str]:
        """The keys of a text's stretches, in order."""
        first, *rest = self.gap.split(text) if self.odd_gap.search(text) else text.split(" ")
        return [" " + first, *rest] if first else rest

    def split(self, text: str) -> list[str | int]:
        """Ordinary stretches of text, and ids of special tokens."""
        if self.special is None or not any(s in text for s in self.added):
            return [text]
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [text[at : m.start()], self.added[m[0]]]
            at = m.end()
        return [*out, text[at:]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian token ids of each text."""
        out = []
        for _, few in groupby(_by_size(texts), key=lambda x: x[0]):
            rows = [[x if isinstance(x, int) else self.keys(x) for x in self.split(t)] for _, t in few]
            self.learn(set().union(*[x for row in rows for x in row if not isinstance(x, int)]))
            get = self.words.__getitem__
            out += [b"".join([x.to_bytes(self.dtype.itemsize, "little") if isinstance(x, int) else b"".join(map(get, x)) for x in row]) for row in rows]
        return out


class TrieEncoder(ChunkEncoder):
    """Encodes with a byte-level BPE file of the tokenizers library (``vocab``, ``merges``, ``added_tokens``)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, symbols = spec["model"], byte_symbols()
        plain = {text: bytes(map(symbols.__getitem__, text)) for text in model["vocab"] if all(c in symbols for c in text)}
        added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.pieces: dict[int, bytes] = {model["vocab"][text]: raw for text, raw in plain.items()}
        super().__init__(added, max([*self.pieces, *added.values()]) + 1)
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, int] = {}  # token -> rank of the merge that makes it; bytes are there from the start
        self.parts: dict[int, tuple[int, int]] = {}
        ids = model["vocab"]
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair, token = (ids[a], ids[b]), ids[a + b]
            self.rank.setdefault(pair, rank)
            if token not in self.made:
                self.made[token], self.parts[token] = rank, pair
        self._apart: dict[int, bool] = {}
        self.whole: set[int] = set()
        for token in sorted(self.pieces, key=lambda t: self.made.get(t, -1)):
            if token not in self.parts:
                if len(self.pieces[token]) == 1:
                    self.whole.add(token)
            elif self.whole.issuperset(self.parts[token]) and self._stay_apart(*self.parts[token], self.made[token]):
                self.whole.add(token)
        del spec, model, plain, ids
        self.automaton()
        self.packed = {t: np.array([t], self.dtype).tobytes() for t in range(self.size)}

    def _stay_apart(self, left: int, right: int, until: int = _NEVER) -> bool:
        """Whether merging, up to the merge of rank ``until``, never joins the last piece of ``left`` to the first of ``right``.

        Walks back in time: of the two pieces at the border, the one that was made last is taken apart. A border merge
        happens if its turn comes while both pieces are there; at equal rank the leftmost pair goes first."""
        left_end = right_end = until
        while True:
            rank = self.rank.get((left, right))
            if rank is not None and rank < left_end and rank <= right_end and rank < until:
                return False
            left_made, right_made = self.made.get(left, -1), self.made.get(right, -1)
            if left_made < 0 and right_made < 0:
                return True
            if left_made > right_made:
                left, left_end = self.parts[left][1], left_made
            else:
                right, right_end = self.parts[right][0], right_made

    def apart(self, left: int, right: int) -> bool:
        if len(self._apart) > CACHE_PAIRS:
            self._apart.clear()
        known = self._apart[left << 24 | right] = self._stay_apart(left, right)
        return known

    def automaton(self) -> None:
        """The trie of the vocabulary: steps (node, byte) -> node, failure links, and the longest token that ends at a node."""
        self.steps: dict[int, int] = {}
        ends, by_depth = {}, defaultdict(list)  # steps by the depth that they lead to
        for token in self.whole:
            node = 0
            for depth, byte in enumerate(self.pieces[token]):
                key = node << 8 | byte
                if key not in self.steps:
                    self.steps[key] = len(self.steps) + 1
                    by_depth[depth].append(key)
                node = self.steps[key]
            ends[node] = token
        self.fail, self.ends_with = [0] * (len(self.steps) + 1), [-1] * (len(self.steps) + 1)
        self.lengths, self.shorter = [0] * self.size, [-1] * self.size
        for depth in sorted(by_depth):
            for key in by_depth.pop(depth):
                node, child, at = key >> 8, self.steps[key], self.fail[key >> 8]
                if node:
                    while at and at << 8 | key & 255 not in self.steps:
                        at = self.fail[at]
                    self.fail[child] = self.steps.get(at << 8 | key & 255, 0)
                self.ends_with[child] = ends.get(child, self.ends_with[self.fail[child]])
        for node, token in ends.items():
            self.lengths[token], self.shorter[token] = len(self.pieces[token]), self.ends_with[self.fail[node]]
        self.learned: dict[int, int] = {}  # steps by way of failure links, remembered as they come up

    def follow(self, key: int) -> int:
        """The step ``key`` (node << 8 | byte), by way of failure links if the trie has none."""
        node, steps = key >> 8, self.steps
        while node and node << 8 | key & 255 not in steps:
            node = self.fail[node]
        if len(self.learned) > CACHE_STEPS:
            self.learned.clear()
        to = self.learned[key] = steps.get(node << 8 | key & 255, 0)
        return to

    def encode_words(self, words: list[bytes]) -> Iterator[list[int]]:
        """Token ids of sorted, distinct byte strings."""
        known, apart, step, learned, follow = self._apart.get, self.apart, self.steps.get, self.learned.get, self.follow
        ends_with, shorter, lengths = self.ends_with, self.shorter, self.lengths
        before, nodes, states = b"", [0], [-1]  # per depth of the trie: the automaton's node, and the last token of the prefix
        for word in words:
            depth, most = 0, min(len(before), len(word))
            while depth < most and before[depth] == word[depth]:
                depth += 1
            del nodes[depth + 1 :], states[depth + 1 :]
            node = nodes[depth]
            for end in range(depth + 1, len(word) + 1):
                key = node << 8 | word[end - 1]
                node = step(key) or learned(key) or follow(key)
                token = ends_with[node]
                start = end - lengths[token]
                while start:
                    fits = known(states[start] << 24 | token)
                    if fits or fits is None and apart(states[start], token):
                        break
                    token = shorter[token]
                    if token < 0:
                        raise ValueError(f"no token ends at {end} of {word!r}")
                    start = end - lengths[token]
                if token < 0:
                    raise ValueError(f"no token ends at {end} of {word!r}")
                nodes.append(node)
                states.append(token)
            before, ids, end = word, [], len(word)
            while end:
                token = states[end]
                ids.append(token)
                end -= lengths[token]
            ids.reverse()
            yield ids

    def encode_fresh(self, keys: set[str]) -> dict[str, bytes]:
        pairs, packed = sorted((_stretch(k).encode(), k) for k in keys), self.packed.__getitem__
        return {k: b"".join(map(packed, ids)) for (_, k), ids in zip(pairs, self.encode_words([w for w, _ in pairs]), strict=True)}

    def spellings(self) -> pa.Array:
        """The bytes of each id; none for an id that the vocabulary lacks."""
        if not hasattr(self, "_spelled"):
            spelled = [b""] * self.size
            for token, raw in self.pieces.items():
                spelled[token] = raw
            for text, token in self.added.items():
                spelled[token] = text.encode()
            self._spelled = pa.array(spelled, pa.large_binary())
        return self._spelled

    def decimals(self) -> pa.Array:
        """Each id in decimal digits, with a comma after it."""
        if not hasattr(self, "_decimals"):
            self._decimals = pa.array([b"%d," % i for i in range(self.size)], pa.large_binary())
        return self._decimals

    def decode(self, ids: np.ndarray) -> str:
        """Text of token ids; bytes that are no UTF-8 become replacement characters."""
        return bytes(joined(self.spellings(), ids, np.array([0, len(ids)]))[0]).decode("utf-8", "replace")


def joined(table: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> list[memoryview]:
    """The entries of ``table`` at ``ids``, strung together for each stretch between two of ``offsets``."""
    taken = table.take(pa.array(ids))
    ends = np.frombuffer(taken.buffers()[1], np.int64, len(ids) + 1)[offsets].tolist()
    data = memoryview(taken.buffers()[2] or b"")
    return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _by_size(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[tuple[int, str]]:
    total = 0
    for text in texts:
        yield total // most, text
        total += len(text)


def encoder(path: str) -> TrieEncoder:
    """One encoder, with its cache of words, per worker process."""

    def make() -> TrieEncoder:
        own = TrieEncoder(path)
        gc.freeze()  # the collector need not walk its tables again and again
        return own

    return live(("bpe", path), make)


def _flat(own: TrieEncoder, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts, one after the other, and where each begins (with the end)."""
    packed = own.encode([t or "" for t in texts])
    offsets = np.zeros(len(packed) + 1, np.int64)
    np.cumsum([len(p) // own.dtype.itemsize for p in packed], out=offsets[1:])
    return np.frombuffer(b"".join(packed), own.dtype), offsets


def _lists(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))


def _decoded(own: TrieEncoder, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    return [bytes(raw).decode("utf-8", "replace") for raw in joined(own.spellings(), ids, offsets)]


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode(docs: DataFrame, tokenizer: str, text: str = "text", into: str = "token_ids") -> DataFrame:
    """``docs`` with a column ``into`` (array<int>) of the token ids of ``text``; replaces a column of that name.

    No shuffle: each row is encoded where it is read."""
    kept = docs.drop(into)
    schema = kept.withColumn(into, F.lit(None).cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for part in _parts(batches):
            ids, offsets = _flat(own, part.column(part.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, _lists(ids, offsets)], names=[*part.schema.names, into])

    return kept.mapInArrow(run, schema)


def decode(docs: DataFrame, tokenizer: str, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """``docs`` with a column ``into`` of the text of the token ids in ``ids`` (null: empty)."""
    kept = docs.drop(into)
    schema = kept.withColumn(into, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for part in _parts(batches):
            lists = part.column(part.schema.get_field_index(ids))
            offsets = np.zeros(len(lists) + 1, np.int64)
            np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), out=offsets[1:])
            texts = _decoded(own, lists.flatten().to_numpy(zero_copy_only=False), offsets)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, into])

    return kept.mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str, text: str = "text", into: tuple[str, str] = ("token_ids", "decoded")) -> DataFrame:
    """``docs`` with the token ids of ``text`` and what they decode to: ``encode`` and ``decode`` in one worker."""
    kept = docs.drop(*into)
    schema = kept.withColumn(into[0], F.lit(None).cast("array<int>")).withColumn(into[1], F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for part in _parts(batches):
            ids, offsets = _flat(own, part.column(part.schema.get_field_index(text)).to_pylist())
            columns = [*part.columns, _lists(ids, offsets), pa.array(_decoded(own, ids, offsets), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *into])

    return kept.mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of the ids of each text and of what they decode to.

    As ``round_trip``, but ids and decoded texts are digested where they are made and stay in the worker."""
    kept = docs.select("doc_id", "text")
    schema = kept.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for part in _parts(batches):
            ids, offsets = _flat(own, part.column("text").to_pylist())
            listed = [hashlib.sha256(raw[:-1]).hexdigest() for raw in joined(own.decimals(), ids, offsets)]
            decoded = [hashlib.sha256(t.encode()).hexdigest() for t in _decoded(own, ids, offsets)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(listed), pa.array(decoded)], names=schema.names)

    return kept.mapInArrow(run, schema)
