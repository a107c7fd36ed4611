"""Media columns: documents as interleaved sequences of text and media references, with payloads by digest.

HTML is parsed into an ordered list of structs, each a text or a media reference with its position and caption. Media
lie in a store, a table (digest, media) written once to the shared folder, under the SHA-256 of the stored form; a join on
the digest resolves references, so a payload that many documents share is stored and decoded once, and positions and
captions stay with the reference. What crosses the join are features of the payload, not its bytes.

Any bytes can be stored as an 8-bit image: a binary PGM, 64 samples wide, of the bytes padded with zeros to a positive
multiple of 64, and a comment with the unpadded length. Reading it back gives the same bytes.

Rows: a null text is empty and its payload 64 zeros; a null page has an empty sequence. References without a digest, or whose
digest the store lacks, keep their place with null features. Repeated rows and ties each keep their own row. Other columns
stay (``sequences``) or don't matter. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedspread.llm.session import checkpointed, shared_dir, small_side

WIDTH = 64
#: References to one digest beyond which it is joined apart.
HOT = 200
#: How a reference names its digest.
SCHEME = "sha256:"
ELEMENT = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
FEATURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

_MEDIA = {"img": "image", "audio": "audio", "video": "video", "source": "media"}
_BREAKS = {"p", "div", "br", "li", "ul", "ol", "tr", "td", "th", "table", "section", "article", "figure", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6"}
_HIDDEN = {"script", "style", "template", "title"}


class Interleaver(HTMLParser):
    """Collects (kind, text, digest, caption) in the order of the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements: list[list] = []
        self.text: list[str] = []
        self.hidden = 0
        self.figure: list[list] | None = None
        self.caption: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag in _MEDIA:
            self.close_text()
            given = dict(attrs)
            source = given.get("src") or ""
            element = [_MEDIA[tag], None, source.removeprefix(SCHEME) if source.startswith(SCHEME) else None, given.get("alt")]
            self.elements.append(element)
            if self.figure is not None:
                self.figure.append(element)
        elif tag == "figcaption":
            self.close_text()
            self.caption = []
        elif tag in _BREAKS:
            self.close_text()
            if tag == "figure":
                self.figure = []

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            said, self.caption = " ".join("".join(self.caption).split()), None
            for element in self.figure or []:
                element[3] = said
            if not self.figure and said:
                self.elements.append(["text", said, None, None])
        elif tag in _BREAKS:
            self.close_text()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data):
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)

    def close_text(self):
        said, self.text = " ".join("".join(self.text).split()), []
        if said:
            self.elements.append(["text", said, None, None])


def interleaved(html: str | None) -> list[dict]:
    parser = Interleaver()
    parser.feed(html or "")
    parser.close()
    parser.handle_endtag("figcaption")
    parser.close_text()
    return [{"position": i, "kind": k, "text": t, "digest": d, "caption": c} for i, (k, t, d, c) in enumerate(parser.elements)]


def sequences(pages: DataFrame, html: str = "html", into: str = "sequence") -> DataFrame:
    """``pages`` with a column ``into`` of the ordered elements of ``html``; replaces a column of that name."""
    kept = pages.drop(into)
    schema = kept.withColumn(into, F.lit(None).cast(ELEMENT)).schema
    kind = pa.list_(pa.struct([("position", pa.int32()), *((n, pa.string()) for n in ("kind", "text", "digest", "caption"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = pa.array([interleaved(h) for h in part.column(part.schema.get_field_index(html)).to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, into])

    return kept.mapInArrow(run, schema)


def image_of(payload: Column) -> Column:
    """The stored form of any bytes (null: none): a binary PGM."""
    raw = F.coalesce(payload, F.lit(b""))
    rows = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / WIDTH)).cast("int")
    header = F.encode(F.concat(F.lit("P5\n# "), F.octet_length(raw).cast("string"), F.lit(f"\n{WIDTH} "), rows.cast("string"), F.lit("\n255\n")), "UTF-8")
    return F.concat(header, F.rpad(raw, rows * WIDTH, F.lit(b"\0")))


def samples(media: bytes) -> tuple[int, bytes]:
    """Unpadded length and the padded bytes of a stored image."""
    kind, note, shape, deepest, payload = media.split(b"\n", 4)
    width, rows = map(int, shape.split())
    if kind != b"P5" or deepest != b"255" or len(payload) != width * rows:
        raise ValueError("not an image of this store")
    return int(note.removeprefix(b"# ")), payload


def feature(payload: bytes) -> str:
    """Difference hash of an 8 x 9 grid of mean levels, with mean, deviation and entropy of the levels."""
    levels = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    counts = np.bincount(levels.ravel(), minlength=256) / levels.size
    mean = float(counts @ np.arange(256))
    deviation = float(np.sqrt(counts @ (np.arange(256) - mean) ** 2))
    entropy = float(-(counts[counts > 0] @ np.log2(counts[counts > 0])))
    columns = np.linspace(0, WIDTH, 10).astype(int)[:-1]
    lines = np.add.reduceat(levels, columns, axis=1, dtype=np.int64) * 1.0 / np.diff(np.append(columns, WIDTH))
    at = np.arange(8) * len(lines) // 8
    grid = np.array([lines[a : max(a + 1, b)].mean(axis=0) for a, b in zip(at, np.append(at[1:], len(lines)), strict=True)])
    bits = (grid[:, 1:] > grid[:, :-1]).ravel()
    return f"d{int(''.join('01'[int(b)] for b in bits), 2):016x} m{mean:.3f} s{deviation:.3f} e{entropy:.3f}"


def store(media: DataFrame) -> str:
    """Writes (digest, media) to a new folder under the shared one; a task writes a digest once. Returns the folder."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            new = []
            for digest in batch.column("digest").to_pylist():
                new.append(digest not in seen)
                seen.add(digest)
            yield batch.filter(pa.array(new, pa.bool_()))

    path = f"{shared_dir(media.sparkSession)}/media-{uuid.uuid4().hex}"
    media.select("digest", "media").mapInArrow(once, "digest string, media binary").write.option("compression", "zstd").parquet(path)
    return path


def described(stored: DataFrame) -> DataFrame:
    """Features of each stored digest, computed from the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FEATURES.split(", ")]
        types = [pa.string() if f.endswith("string") else pa.int64() for f in FEATURES.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part, rows = batch.slice(at, 1000), []
                for digest, media in zip(part.column("digest").to_pylist(), part.column("media").to_pylist(), strict=True):
                    n, payload = samples(media)
                    rows.append((digest, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return stored.mapInArrow(run, FEATURES).dropDuplicates(["digest"])


def resolved(interleaved_docs: DataFrame, features: DataFrame, key: str, sequence: str = "sequence") -> DataFrame:
    """A row for each media reference: key, position, kind, caption and the features of its payload.

    Digests with more than ``HOT`` references are joined apart, their features broadcast if they are few enough, so that a payload
    that a third of all documents share is no single task's."""
    refs = interleaved_docs.select(key, F.explode(F.filter(sequence, lambda e: e["kind"] != "text")).alias("e"))
    refs = checkpointed(refs.select(key, "e.position", "e.kind", "e.caption", "e.digest"))
    features = checkpointed(features)
    hot = checkpointed(refs.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > HOT) & F.col("digest").isNotNull()).select("digest"))
    often = small_side(features.join(small_side(hot), "digest", "left_semi"))
    common = refs.join(small_side(hot), "digest", "left_semi").join(often, "digest", "left")
    rest = refs.where("digest is not null").join(small_side(hot), "digest", "left_anti").join(features.join(small_side(hot), "digest", "left_anti"), "digest", "left")
    return common.unionByName(rest).unionByName(refs.where("digest is null"), allowMissingColumns=True)


def text_media(docs: DataFrame) -> DataFrame:
    """Each document's text as a stored image that its page refers to: sizes, digests and features after reading back."""
    media = image_of(F.encode(F.col("text"), "UTF-8"))
    made = docs.select("doc_id", media.alias("media")).withColumn("digest", F.sha2("media", 256))
    folder = store(made)
    html = F.format_string(f'<article><figure><img src="{SCHEME}%s" alt="text"><figcaption>the text of a document</figcaption></figure></article>', "digest")
    pages = sequences(made.select("doc_id", html.alias("html")))
    found = resolved(pages, described(docs.sparkSession.read.parquet(folder)), "doc_id")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
