"""The queries of these operators, with production parameters over whole tables, and their oracle SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seedspread.llm import bpe, embedding_dedup, importance, jaccard_join, language_id, license_scan, media, mixing, quality, token_counts, token_store, toxicity, variants
from seedspread.llm.session import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_PIECES = public_tokenizers.path("word_bpe_49k.json")
UNIGRAM_PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the BPE token ids of every document and of the text they decode to."""
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), BYTE_BPE)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and class of every document at a Jaccard similarity of 0.8 of five-word shingles."""
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses that every document holds a notice of, with the place of the best match."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding at a cosine of 0.9."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, and the target of its source."""
    return mixing.mix_words(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids in the token files, read back from them."""
    return token_store.store_and_read(table(spark, sf_dir, "documents"), BYTE_BPE)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of greedy longest-match tokens of every document's text."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), WORD_PIECES).select("doc_id", "n_tokens")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a stored image, read back through its page's reference."""
    return media.text_media(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document's text, learned from labels outside the held-out fold."""
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document's text, learned outside the held-out fold."""
    return language_id.predicted(table(spark, sf_dir, "documents"), UNIGRAM_PIECES)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, and whether base rules and trained trees keep it."""
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document in a draw towards the benchmark's distribution of words."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of the documents with its most frequent variant and the root of its variants."""
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe_round_trip,
        op2_ngram_jaccard_join,
        op3_license_scan,
        op4_embedding_near_dedup,
        op5_source_mix,
        op6_token_files,
        op7_token_counts,
        op8_media_columns,
        op9_toxicity,
        op10_language_id,
        op11_quality_rules,
        op12_importance_resampling,
        op13_spelling_variants,
    )
}

#: Links by a self-join on shingles; classes by the least doc_id that links reach.
_OP2_SQL = r"""
with recursive
words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: list_slice(w, i, i + 4)) when len(w) > 0 then [w] else [] end) as s
  from words),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from sets a join sets b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 5 * c >= 4 * (x.n + y.n - c)),
reach as (select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join links l on l.a = r.b),
classes as (select a as doc_id, min(b) as class_id from reach group by a),
texts as (select d.doc_id, case when s.n is null then d.doc_id else min(d.doc_id) over (partition by d.text) end as copy_of, d.text from documents d left join sizes s using (doc_id)),
counts as (select l.a as doc_id, count(*) as n_links, count(distinct case when x.text <> y.text then y.text end) as n_texts
  from links l join documents x on x.doc_id = l.a join documents y on y.doc_id = l.b group by l.a)
select t.doc_id, copy_of, coalesce(n_links, 0)::bigint as n_links, coalesce(n_texts, 0)::bigint as n_texts, class_id
from texts t join classes using (doc_id) left join counts using (doc_id)
"""

_OP4_SQL = """
with recursive
unit as (select vec_id, embedding::double[] as v from embeddings),
links as (select a.vec_id as a, b.vec_id as b from unit a join unit b on a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.9),
reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join links l on l.a = r.b),
counts as (select a, count(*) as n_links from links group by a)
select r.a as vec_id, coalesce(any_value(n_links), 0)::bigint as n_links, min(r.b) as component_id, r.a = min(r.b) as kept
from reach r left join counts c on c.a = r.a group by r.a
"""

#: CRC-32 of the strings of a table ``hashed`` (s): its table, then a fold over the bytes.
_CRC_SQL = """
tab as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as t),
bytes as (select s, hex(encode(s)) as x from hashed),
crc as (select s, xor(list_reduce(list_transform(range(0, length(x), 2), lambda i: concat('0x', substr(x, i + 1, 2))::bigint), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::bigint), 4294967295) as crc from bytes, tab)"""

_ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP12_SQL = rf"""
with
dw as (select doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
df as (select doc_id, unnest(w) as s from dw),
bf as (select unnest(regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as s from benchmark),
hashed as (select s from df union select s from bf), {_CRC_SQL},
buckets as (select s, crc % 10000 as b from crc),
sn as (select b, count(*)::double as n from df join buckets using (s) group by 1),
tn as (select b, count(*)::double as n from bf join buckets using (s) group by 1),
gains as (select b, floor(1000 * ln(((coalesce(tn.n, 0) + 1) * ((select coalesce(sum(n), 0) from sn) + 10000)) / ((coalesce(sn.n, 0) + 1) * ((select coalesce(sum(n), 0) from tn) + 10000))))::bigint as gain
  from (select distinct b from buckets) left join sn using (b) left join tn using (b)),
weights as (select doc_id, sum(gain)::bigint as weight from df join buckets using (s) join gains using (b) group by 1),
scored as (select doc_id, len(w)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
  coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((concat('0x', substr(sha256(concat('2024:', doc_id)), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score from dw left join weights using (doc_id)),
placed as (select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () * 10 // 100 as drawn from scored where n_features >= 20)
select doc_id, n_features, weight, score, case when place <= drawn then place end::bigint as rank from scored left join placed using (doc_id)
"""

_OP13_SQL = rf"""
with recursive
found as (select doc_id, unnest(regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) as run from documents),
often as (select concat(doc_id, ':', run) as s, run, count(*) as n from found group by 1, 2),
hashed as (select s from often), {_CRC_SQL},
spelled as (select case when crc % 97 = 0 then concat(substr(run, 1, crc % length(run)), substr(run, crc % length(run) + 2)) else run end as word, n from often join crc using (s)),
words as (select word, sum(n)::bigint as n from spelled where length(word) >= 5 group by 1 having sum(n) >= 3),
less as (select word, n, unnest(list_distinct(list_transform(range(1, length(word) + 1), lambda i: concat(substr(word, 1, i - 1), substr(word, i + 1))))) as part from words),
met as (select a.word as a, b.word as b, b.n as n from less a join less b on a.part = b.part and a.word <> b.word
  union select a.word, b.word, b.n from less a join words b on a.part = b.word union select b.word, a.word, a.n from less a join words b on a.part = b.word),
near as (select a as word, b as other, n from met where length(a) <> length(b) or len(list_filter(range(1, length(a) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))) = 1),
best as (select word, count(*)::bigint as n_near, arg_min(struct_pack(other := other, n := n), (-n, other)) as f from near group by 1),
forms as (select word, words.n, n_near, case when f.n >= 2 * words.n then f.other end as form, case when f.n >= 2 * words.n then f.n end as form_n from words join best using (word)),
led as (select word, form as root from forms where form is not null union select led.word, f.form from led join forms f on f.word = led.root where f.form is not null),
last as (select word, root from led where root not in (select word from forms where form is not null))
select word, form, coalesce(root, word) as root, words.n as n, coalesce(n_near, 0)::bigint as n_near, form_n::bigint as form_n from words left join (select word, n_near, form, form_n from forms) using (word) left join last using (word)
"""

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": _OP2_SQL,
    "op4_embedding_near_dedup": _OP4_SQL,
    "op12_importance_resampling": _OP12_SQL,
    "op13_spelling_variants": _OP13_SQL,
}
