"""BPE, token files, token counts and media columns against the public libraries and plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seedspread.llm import bpe, media, queries, token_counts, token_store

TEXTS = [
    None,
    "",
    " ",
    "   two  spaces   \n\n\tand tabs ",
    "It's I'll WE'RE can't 's",
    "naïve façade – über 東京 привет мир 🙂🙂 ​  x\x85y",
    "a\x00b\x1c \x1d᠎ z",
    "<|endoftext|> in the middle <|endoftext|><|endoftext|>",
    "12345 678,90 a1b2 ___ --- !!??",
    "x" * 20_000,
    "ab " * 5_000,
    "It's I'll WE'RE can't 's",
]


def frame(spark, texts=TEXTS):
    rows = [(i, t, "en", "a", 7, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int, token_ids string").repartition(3)


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(queries.BYTE_BPE)
    own.no_padding()
    own.no_truncation()
    return own


def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_bpe_equals_the_library(spark, library):
    for docs in (frame(spark), documents(spark)):
        texts = {r.doc_id: r.text for r in docs.collect()}
        got = {r.doc_id: r for r in bpe.round_trip_digests(docs, queries.BYTE_BPE).collect()}
        assert got.keys() == texts.keys()
        for doc_id, text in texts.items():
            ids = library.encode(text or "", add_special_tokens=False).ids
            decoded = library.decode(ids, skip_special_tokens=False)
            assert got[doc_id].n_tokens == len(ids), repr(text)[:80]
            assert got[doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert got[doc_id].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_bpe_random_strings(library):
    rng, own = random.Random(5), bpe.TrieEncoder(queries.BYTE_BPE)
    letters = "aeinrst' \n\t.,!0123ÀéßЖ東🙂́ 　ſK"
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(4000)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for text, raw, ids in zip(texts, own.encode(texts), want, strict=True):
        assert np.frombuffer(raw, own.dtype).tolist() == ids, repr(text)


def test_bpe_keeps_columns_and_shares_prefixes(spark):
    out = bpe.encode(frame(spark), queries.BYTE_BPE)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_tokens", "token_ids"]
    assert bpe.round_trip_digests(frame(spark).limit(0), queries.BYTE_BPE).count() == 0
    apart = bpe.decode(out, queries.BYTE_BPE).select("doc_id", "token_ids", "decoded")
    assert sorted(apart.collect()) == sorted(bpe.round_trip(frame(spark), queries.BYTE_BPE).select("doc_id", "token_ids", "decoded").collect())
    own = bpe.TrieEncoder(queries.BYTE_BPE)
    words = sorted({b"token", b"tokens", b"tokenize", b"to", b"tokenized"})
    alone = [next(own.encode_words([w])) for w in words]
    assert list(own.encode_words(words)) == alone


def stored(spark, docs):
    return token_store.store_and_read(docs, queries.BYTE_BPE)


def test_cut_texts_equal_whole_texts_in_the_library(library):
    rng, own = random.Random(6), token_store.LibraryEncoder(queries.BYTE_BPE)
    letters = "aeinrst  \n\t.,!0123ÀéßЖ東🙂́ \u3000\u2028ſK"
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(4000)]
    texts += [t + "<|endoftext|>" + u for t, u in zip(texts[:500], texts[500:1000], strict=True)] + [t or "" for t in TEXTS]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for text, raw, ids in zip(texts, own.encode(texts), want, strict=True):
        assert np.frombuffer(raw, own.dtype).tolist() == ids, repr(text)


def test_new_words_go_to_the_library_in_bulk(library):
    class Counted:
        def __init__(self, model):
            self.model, self.calls = model, 0

        def __getattr__(self, name):
            def call(*args, **kwargs):
                self.calls += 1
                return getattr(self.model, name)(*args, **kwargs)

            return call

    rng, own = random.Random(7), token_store.LibraryEncoder(queries.BYTE_BPE)
    words = ["".join(rng.choices("abdeinrstçÖЖ東", k=9)) for _ in range(6000)]
    texts = [" ".join(words[:3000]), "".join(w + rng.choice([" ", ", ", ".\n", "\n", "&&& ", "'s ", "\n\n", "  ", " 7\n", "' "]) for w in words)]
    own.model = Counted(own.model)
    got = [np.frombuffer(raw, own.dtype).tolist() for raw in own.encode([*texts, "", words[0]])]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in (*texts, "", words[0])]
    assert own.model.calls <= 20  # one for each new word before


def test_token_files_of_another_tokenizer(spark):
    own = Tokenizer.from_file(queries.WORD_PIECES)
    own.no_truncation()
    own.no_padding()
    docs = frame(spark, ["Two Words", "", None])
    got = [r.n_tokens for r in token_store.store_and_read(docs, queries.WORD_PIECES).orderBy("doc_id").collect()]
    assert got == [len(own.encode(t, add_special_tokens=False).ids) + 1 for t in ("Two Words", "", "")]


def test_token_files_equal_the_library(spark, library):
    for docs in (frame(spark), documents(spark)):
        rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect())
        got = {r.doc_id: r for r in stored(spark, docs).collect()}
        start = 0
        for doc_id, text in rows:
            ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
            assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)
        assert len(got) == len(rows)


def test_token_files_random_access(spark, library, tmp_path):
    uri = f"file://{tmp_path}/tokens"
    shards = token_store.write(documents(spark), uri, queries.BYTE_BPE)
    name, docs, total = shards[0]
    reader = token_store.ShardReader(uri, name)
    flat = np.concatenate([reader.sequence(i)[reader.mask(i)] for i in range(-(-total // token_store.LENGTH))])
    assert len(flat) == total and (flat == 0).sum() >= docs
    assert (reader.tokens(1000, 3000) == flat[1000:4000]).all() and (reader.tokens(total - 1, 1) == flat[-1:]).all()
    assert sum(b.num_rows for b in reader.index()) == docs


def test_token_files_cases(spark):
    assert stored(spark, frame(spark).limit(0)).count() == 0
    twice = spark.createDataFrame([(None, "b"), (1, "a"), (1, "a"), (1, None)], "doc_id long, text string")
    got = sorted(stored(spark, twice).select("start", "n_tokens").collect())
    assert [tuple(r) for r in got] == [(0, 2), (2, 1), (3, 2), (5, 2)]


def longest_match(word: bytes, pieces: set[bytes], longest: int) -> int:
    n = 0
    while word:
        k = next(k for k in range(min(longest, len(word)), 0, -1) if word[:k] in pieces)
        word, n = word[k:], n + 1
    return n


def test_token_counts_equal_greedy_matching(spark):
    pieces = token_counts.vocabulary(queries.WORD_PIECES)
    longest = max(map(len, pieces))
    for docs in (frame(spark), documents(spark)):
        for r in token_counts.count_tokens(docs, queries.WORD_PIECES).collect():
            runs = [x for w in (r.text or "").split() for x in token_counts._RUNS.findall(w.lower())]
            assert r.n_tokens == sum(longest_match(x.encode(), pieces, longest) for x in runs)
    assert token_counts.count_tokens(frame(spark).limit(0), queries.WORD_PIECES).count() == 0


def test_longest_match_random():
    rng = random.Random(2)
    for _ in range(300):
        pieces = {bytes(rng.choices(b"abc", k=rng.randint(2, 5))) for _ in range(6)} | {b"a", b"b", b"c"}
        own, word = token_counts.LongestMatch(pieces), bytes(rng.choices(b"abc", k=30))
        assert own.count(word) == longest_match(word, pieces, 5)


def test_media_round_trip(spark):
    for docs in (frame(spark), documents(spark)):
        texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
        got = {r.doc_id: r for r in media.text_media(docs).collect()}
        assert got.keys() == texts.keys()
        for doc_id, raw in texts.items():
            payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
            r = got[doc_id]
            assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
            assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
            assert r.media_bytes > r.payload_bytes and r.feature
        same = {}
        for doc_id, raw in texts.items():
            assert same.setdefault(raw, got[doc_id][1:8]) == got[doc_id][1:8]
    assert media.text_media(frame(spark).limit(0)).count() == 0


def test_interleaved_order_and_captions():
    page = '<p>one <b>two</b></p><script>no()</script><figure><img src="sha256:ab" alt="x"><figcaption>the &amp; caption</figcaption></figure>three<img src="http://x/y.png" alt="far"><video src="sha256:cd"></video>'
    found = [(e["position"], e["kind"], e["text"], e["digest"], e["caption"]) for e in media.interleaved(page)]
    assert found == [(0, "text", "one two", None, None), (1, "image", None, "ab", "the & caption"), (2, "text", "three", None, None), (3, "image", None, None, "far"), (4, "video", None, "cd", None)]
    assert media.interleaved(None) == [] and media.interleaved("<p><figcaption>open") != []


def test_references_resolve_by_digest(spark):
    made = spark.createDataFrame([(bytearray(b"one"),), (bytearray(b"two"),)], "raw binary").select(media.image_of(F.col("raw")).alias("media")).withColumn("digest", F.sha2("media", 256))
    known = media.described(spark.read.parquet(media.store(made.union(made))))
    assert known.count() == 2
    digest = made.first().digest
    pages = spark.createDataFrame([(1, f'a<img src="sha256:{digest}" alt="c">b<img src="sha256:00">'), (2, None)], "page_id long, html string")
    got = sorted((r.page_id, r.position, r.caption, r.n_bytes) for r in media.resolved(media.sequences(pages), known, "page_id").collect())
    assert got == [(1, 1, "c", 3), (1, 3, None, None)]


def test_hot_digests_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(media, "HOT", 3)
    texts = ["same"] * 9 + ["other", None, "", "same"]
    rows = [(i if i < 11 else None, t, "clash", 5) for i, t in enumerate(texts)] + [(0, "same", "clash", 5), (0, "another", "clash", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, position int")
    got = media.text_media(docs.repartition(3)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes) for r in got) == sorted((d if d is not None else -1, len(t or "")) for d, t, _, _ in rows)
    for text in set(texts):
        raw = (text or "").encode()
        own = {tuple(r[1:8]) for r in got if r.n_bytes == len(raw) and r.payload_sha256 == hashlib.sha256(raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))).hexdigest()}
        assert len(own) == 1
