"""Token ids as files for training: Arrow IPC files of fixed-size-list batches.

A shard holds the documents of a range of doc_ids, in ascending order, each followed by an end id. ``<shard>.arrow`` is an
Arrow stream with a footer: rows are ``sequence`` (fixed-size list of ``LENGTH`` ids, unsigned integers of the vocabulary's
width) and ``mask`` (as many bits: false where the last sequence of a shard is padded), so any sequence or token is found by
arithmetic and read without copying. ``<shard>.index.arrow`` has doc_id and n_tokens of the shard's documents in order.

Shards are written by tasks to the shared folder, each attempt under a name of its own; the names that count are those in the
rows that successful attempts return, so a task that is lost or runs twice does no harm, and nothing is renamed. One row
for each shard, not for each document, passes the driver.

Ids come from the tokenizers library. For byte-level vocabularies, texts are cut into words as the library cuts them, distinct
new words go once, many in a call, to the model that the library loaded from the file, and a worker keeps the ids of stretches
that come up again; tests hold the ids against the library's own of whole texts. Other vocabularies get whole texts.

Rows: null texts are empty and have the end id only. Rows that repeat are stored each time; rows with equal doc_id are
ordered by text. Null doc_ids come first. Texts are never cut; other columns don't matter. An empty table gives no shards.
"""

from __future__ import annotations

import gc
import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from seedspread.llm.bpe import ChunkEncoder, _by_size, _key, _stretch, byte_symbols, joined
from seedspread.llm.session import shared_dir
from seedspread.llm.wordcache import live

LENGTH = 2048
#: Sequences of a batch of a file.
BATCH = 256
#: Documents that are encoded at once, their characters, and new words that the library gets at once.
ROWS, GROUP_CHARS, WORDS = 2000, 1_500_000, 1000
#: Of a worker's cache of stretches.
CACHE_BYTES = 72_000_000


class LibraryEncoder(ChunkEncoder):
    """Encodes with a tokenizer file by the tokenizers library, without truncation, padding and special tokens of its own."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        size, before = self.library.get_vocab_size(with_added_tokens=True), spec.get("pre_tokenizer") or {}
        super().__init__({a["content"]: a["id"] for a in spec.get("added_tokens", [])}, size, CACHE_BYTES)
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
        #: Whether texts may be cut; else the library gets them whole.
        self.cuts = plain and not any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") or a.get("normalized") for a in spec.get("added_tokens", []))
        model = spec["model"]
        spelled = {byte: shown for shown, byte in byte_symbols().items()}
        # words are handed over in bulk, and parted again by the lengths of their tokens: each byte must be in one
        self.cuts &= model.get("type") == "BPE" and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and model["vocab"].keys() >= set(spelled.values())
        #: How the library spells bytes, by their Latin-1 characters; a byte that UTF-8 lacks parts words.
        self.spelling = spelled | {0xFF: " "}
        #: The library's model alone, for words that are spelled so.
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = CharDelimiterSplit(" ")
        self.lengths = np.zeros(size, np.int64)
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            self.lengths[i] = len(token)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian token ids of each text."""
        if not self.cuts:
            return [np.array(found.ids, self.dtype).tobytes() for found in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        out: list[bytes] = []
        for _, few in groupby(_by_size(texts, GROUP_CHARS), key=lambda x: x[0]):
            out += self.encode_group([t for _, t in few])
        return out

    def encode_group(self, texts: list[str]) -> list[bytes]:
        """Arrow cuts texts at their spaces and numbers the distinct stretches; only those are looked up one by one.

        Texts with special tokens, or with spaces that are no borders of stretches, are cut by ``keys``."""
        whole = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(whole, self.odd_gap.pattern)
        for special in self.added:
            odd = pc.or_(odd, pc.match_substring(whole, special))
        apart = iter(super().encode(whole.filter(odd).to_pylist()))
        cut = pc.split_pattern(whole.filter(pc.invert(odd)), " ")
        ends, numbered = cut.offsets.to_numpy(), cut.flatten().dictionary_encode()
        numbers, stretches = numbered.indices.to_numpy().copy(), numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        # no space is before the first stretch of a text; nothing but a first stretch is empty
        first, where = np.unique(numbers[ends[:-1]], return_inverse=True)
        numbers[ends[:-1]] = len(stretches) + where
        keys = [s or " " for s in stretches] + [" " + stretches[i] for i in first.tolist()]
        plain = map(bytes, joined(pa.array(self.look_up(keys), pa.large_binary()), numbers, ends))
        return [next(apart if o else plain) for o in odd.to_pylist()]

    def learn(self, keys: set[str]) -> None:
        self.look_up(list(keys))

    def look_up(self, keys: list[str]) -> list[bytes]:
        """Packed ids of distinct stretches."""
        if self.held > self.most:
            self.words, self.older, self.held = {}, self.words, 0
        found = list(map(self.words.get, keys))
        lacking = [i for i, raw in enumerate(found) if raw is None]
        new = [keys[i] for i in lacking]
        packed = list(map(self.older.get, new))
        self._fill(packed, new)
        self._keep(new, packed)
        for i, raw in zip(lacking, packed, strict=True):
            found[i] = raw
        return found

    def _fill(self, packed: list[bytes | None], keys: list[str]) -> None:
        """Puts ids in place of the Nones of ``packed``."""
        places, words, counts = [i for i, raw in enumerate(packed) if raw is None], [], []
        for key in map(keys.__getitem__, places):
            before = len(words)
            if key.isalpha():
                words.append(key)
            elif (head := key.rstrip(punctuation)).isalpha():  # a word and its marks: two words of the pattern
                words += head, " " + key[len(head) :]
            else:
                above, line, below = key.partition("\n")
                head, start = above.rstrip(punctuation), below.rstrip(punctuation)
                if line and head.isalpha() and start.isalpha():  # a line feed between such
                    words.append(head)
                    if len(head) < len(above):
                        words.append(" " + above[len(head) :])
                    words += " \n", " " + start
                    if len(start) < len(below):
                        words.append(" " + below[len(start) :])
                else:
                    words += map(_key, self.pattern.findall(_stretch(key)))
            counts.append(len(words) - before)
        known, older = self.words.get, self.older.get
        ids = {w: known(w) or older(w) for w in words}
        made = self.encode_fresh({w for w, raw in ids.items() if raw is None})
        ids |= made
        raws, at = list(map(ids.__getitem__, words)), 0
        for i, n in zip(places, counts, strict=True):
            packed[i] = raws[at] if n == 1 else b"".join(raws[at : at + n])
            at += n
        apart = made.keys() - keys
        self._keep(apart, map(made.__getitem__, apart))

    def encode_fresh(self, keys: set[str]) -> dict[str, bytes]:
        distinct, found = sorted(keys), {}
        for at in range(0, len(distinct), WORDS):
            few = distinct[at : at + WORDS]
            words = [_stretch(k).encode() for k in few]
            (got,) = self.model.encode_batch_fast([b"\xff".join(words).decode("latin-1").translate(self.spelling)], add_special_tokens=False)
            ids = np.array(got.ids, self.dtype)
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(list(map(len, words)))) + 1
            raw, cuts = ids.tobytes(), (ends * ids.itemsize).tolist()
            found.update(zip(few, [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)], strict=True))
        return found


def encoder(path: str) -> LibraryEncoder:
    """One encoder, with its cache of stretches, per worker process."""

    def make() -> LibraryEncoder:
        own = LibraryEncoder(path)
        gc.freeze()
        return own

    return live(("library", path), make)


class ShardWriter:
    """Writes one shard; memory is bounded by a batch and the largest document."""

    def __init__(self, fs: pafs.FileSystem, path: str, dtype: np.dtype, length: int = LENGTH):
        self.length, self.dtype = length, dtype
        self.fs = fs
        self.names = {end: path + end for end in (".arrow", ".index.arrow")}
        self.schema = pa.schema([("sequence", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = {end: fs.open_output_stream(name) for end, name in self.names.items()}
        self.tokens = pa.ipc.new_file(self.sinks[".arrow"], self.schema)
        self.index = pa.ipc.new_file(self.sinks[".index.arrow"], self.index_schema)
        self.held: list[np.ndarray] = []
        self.waiting = self.total = self.docs = 0

    def add(self, doc_ids: list[int | None], ids: list[np.ndarray]) -> None:
        self.index.write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array([len(i) for i in ids], pa.int64())], schema=self.index_schema))
        self.held += ids
        self.docs += len(ids)
        self.waiting += sum(map(len, ids))
        full = self.waiting // (BATCH * self.length) * BATCH * self.length
        if full:  # all batches but the last have BATCH sequences
            self._flush(full)

    def _flush(self, n: int) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        ready, rest = flat[:n], flat[n:]
        self.held, self.waiting, self.total = [rest], len(rest), self.total + len(ready)
        pad = -len(ready) % self.length
        mask = np.arange(len(ready) + pad) < len(ready)
        ready = np.concatenate([ready, np.zeros(pad, self.dtype)])
        for at in range(0, len(ready), BATCH * self.length):
            part = slice(at, at + BATCH * self.length)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ready[part], mask[part])]
            self.tokens.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> tuple[int, int]:
        """Documents and tokens."""
        if self.waiting:
            self._flush(self.waiting)
        self.tokens.close()
        self.index.close()
        for sink in self.sinks.values():
            sink.close()
        return self.docs, self.total


class ShardReader:
    """Random access to a shard's token stream."""

    def __init__(self, uri: str, shard: str):
        self.fs, base = pafs.FileSystem.from_uri(uri)
        name = f"{base}/{shard}.arrow"
        self.source = pa.memory_map(name) if isinstance(self.fs, pafs.LocalFileSystem) else self.fs.open_input_file(name)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("sequence").type.list_size
        self.index_path = f"{base}/{shard}.index.arrow"
        self._batch: tuple[int, np.ndarray] | None = None

    def index(self) -> Iterator[pa.RecordBatch]:
        with self.fs.open_input_file(self.index_path) as source:
            file = pa.ipc.open_file(source)
            yield from map(file.get_batch, range(file.num_record_batches))

    def tokens(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from position ``start`` of the shard; a view of the file where they lie in one batch."""
        parts, per = [], BATCH * self.length
        while n > 0:
            batch, at = divmod(start, per)
            if self._batch is None or self._batch[0] != batch:
                self._batch = batch, self.file.get_batch(batch).column("sequence").flatten().to_numpy()
            parts.append(self._batch[1][at : at + n])
            start, n = start + len(parts[-1]), n - len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def mask(self, sequence: int) -> np.ndarray:
        batch, at = divmod(sequence, BATCH)
        return self.file.get_batch(batch).column("mask")[at].values.to_numpy(zero_copy_only=False)

    def sequence(self, sequence: int) -> np.ndarray:
        batch, at = divmod(sequence, BATCH)
        return self.file.get_batch(batch).column("sequence")[at].values.to_numpy()


def write(docs: DataFrame, uri: str, tokenizer: str, end_id: int = 0) -> list[tuple[str, int, int]]:
    """Encodes ``docs`` (doc_id, text) and writes shards under ``uri``; (name, documents, tokens) of each in order.

    ``tokenizer``: a file of the tokenizers library.
    ``uri``: a folder that all executors see, of any scheme that Arrow opens (file, hdfs, s3, gs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, name, writer = encoder(tokenizer), f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}", None
        end = np.array([end_id], own.dtype).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                if writer is None:
                    fs, base = pafs.FileSystem.from_uri(uri)
                    fs.create_dir(base, recursive=True)
                    writer = ShardWriter(fs, f"{base}/{name}", own.dtype)
                packed = own.encode([t or "" for t in part.column("text").to_pylist()])
                writer.add(part.column("doc_id").to_pylist(), [np.frombuffer(p + end, own.dtype) for p in packed])
        if writer is not None:
            n_docs, n_tokens = writer.close()
            yield pa.record_batch([pa.array([name]), pa.array([n_docs]), pa.array([n_tokens])], names=["shard", "n_docs", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    # the beginning of the text parts rows of one repeated doc_id, and agrees with the order by text
    ordered = rows.repartitionByRange("doc_id", F.substring("text", 1, 16)).sortWithinPartitions("doc_id", "text")
    done = ordered.mapInArrow(run, "shard string, n_docs long, n_tokens long").collect()
    return sorted((r.shard, r.n_docs, r.n_tokens) for r in done)


def read_back(spark: SparkSession, uri: str, shards: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each stored document, read from the files."""
    ahead, rows = 0, []
    for name, _, n_tokens in shards:
        rows.append((name, ahead))
        ahead += n_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start in zip(batch.column("shard").to_pylist(), batch.column("ahead").to_pylist(), strict=True):
                reader, at = ShardReader(uri, shard), 0
                for docs in reader.index():
                    n = docs.column("n_tokens").to_numpy()
                    begin = at + np.cumsum(n) - n
                    crc = [zlib.crc32(reader.tokens(b, k).astype("<u4").tobytes()) for b, k in zip(begin.tolist(), n.tolist(), strict=True)]
                    yield pa.record_batch([docs.column("doc_id"), pa.array(start + begin), docs.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    at += int(n.sum())

    listed = spark.createDataFrame(rows, "shard string, ahead long").repartition(max(1, len(rows)), "shard")
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_and_read(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes all documents to a new folder under the shared one and returns what ``read_back`` finds there."""
    spark = docs.sparkSession
    uri = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    uri = uri if "://" in uri else "file://" + uri.removeprefix("file:")
    return read_back(spark, uri, write(docs, uri, tokenizer, end_id))
