"""Spelling variants: words that differ by one letter, grouped under their most frequent form.

A word's key is the sum of a power of each of its letters, so anagrams share it and it changes by one letter's value where a letter is
added or removed, by two where one is exchanged. A word offers its own key and, for each different letter, the key without
it: a word without a letter has the own key of one that lacks it, and words that exchange one share the key without it. So words are joined
on keys that differ by any one-letter addition, removal or exchange, and the order of letters is verified.

An edit leaves the first or the second half of a word as it is, so keys are joined together with either half:
large sets of anagrams fall apart, and no group of a key is compared pair by pair. Join keys are 64-bit hashes of those, which
only adds candidates; what is verified is the words.

Words come from whole texts by built-in functions; counts are summed before they are shuffled; forms are followed by pointer doubling over
the words that have one, in rounds that grow with the logarithm of the longest chain (a form is at least twice as frequent).

Rows: null texts have no words, and rows without doc_id count as having an empty one. Repeated rows count as often as they stand. Ties of forms go to
the smallest word. Other columns don't matter; an empty table gives an empty result. Very long words cost a row with the word for each of
their different letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedspread.llm.session import checkpointed, small_side

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
POWER, MODULUS = 5, (1 << 61) - 1


def runs(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, run: every run of letters in every text, A-Z in lower case."""
    plain = F.translate(F.col(text), _UPPER, _LOWER)
    return docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.explode(F.regexp_extract_all(plain, F.lit(RUN), F.lit(0))).alias("run"))


def misspelled(found: DataFrame, every: int) -> Column:
    """The run, without one letter where its checksum with the document's is divisible by ``every``."""
    h, size = F.crc32(F.concat("key", F.lit(":"), "run")), F.length("run")
    at = (h % size).cast("int")
    return F.when(h % every == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))


def letter_value(letter: Column) -> Column:
    """The power of a letter's code point, below ``MODULUS``."""
    code = F.ascii(letter).cast("long")
    return F.pmod(code * code * code * code * code, F.lit(MODULUS))


def keys(words: DataFrame) -> DataFrame:
    """word, n, join, own: the join keys of each word: its own (``own``), and without each of its letters, with either half."""
    letters = F.split(F.col("word"), "")
    total = F.aggregate(F.transform(letters, letter_value), F.lit(0).cast("long"), lambda a, b: F.pmod(a + b, F.lit(MODULUS)))
    base = words.select("word", "n", F.length("word").alias("size"), total.alias("total"), F.array_distinct(letters).alias("letters"))
    less = F.transform("letters", lambda c: F.struct((F.col("size") - 1).alias("size"), F.pmod(F.col("total") - letter_value(c), F.lit(MODULUS)).alias("key"), F.lit(False).alias("own")))
    own = F.array(F.struct("size", F.col("total").alias("key"), F.lit(True).alias("own")))
    offered = base.select("word", "n", F.explode(F.concat(less, own)).alias("k"))
    longer = F.col("k.size") + 1
    half = F.floor(longer / 2).cast("int")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.substr("word", F.lit(1), half).alias("part")), F.struct(F.lit(1).alias("side"), F.right(F.col("word"), longer - half).alias("part")))
    spread = offered.select("word", "n", "k", F.explode(sides).alias("h"))
    return spread.select("word", "n", "k.own", F.xxhash64("k.size", "k.key", "h.side", "h.part").alias("join"))


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: both directions of all pairs of ``words`` (word, n) one letter apart."""
    offered = keys(words)
    left, right = offered.where("not own").select("join", "word", "n"), offered.select("join", F.col("word").alias("other"), F.col("n").alias("other_n"), "own")
    met = left.join(right, "join").where((F.col("own") | (F.col("word") < F.col("other"))) & (F.levenshtein("word", "other", 1) == 1))
    names = ("word", "n", "other", "other_n")
    one, two = (F.struct(*[F.col(c).alias(name) for c, name in zip(way, names, strict=True)]) for way in (names, ("other", "other_n", "word", "n")))
    return met.select(F.explode(F.array(one, two)).alias("w")).select("w.*").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word that forms (word, form) lead to; ``forms`` has no circles."""
    at = checkpointed(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")))
    while not at.where("open").isEmpty():
        next_ = small_side(at.select(F.col("word").alias("root"), F.col("root").alias("beyond")))
        moved = at.join(next_, "root", "left")
        at = checkpointed(moved.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("open")))
    return at.select("word", "root")


def grouped(words: DataFrame, ratio: int = 2) -> DataFrame:
    """word, n, form, root, n_near, form_n of ``words`` (word, n): the form is the most frequent near word, if ``ratio`` times as frequent."""
    words = checkpointed(words)
    best = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"), F.first("n").alias("own_n"))
    taken = -F.col("best.minus") >= F.lit(ratio) * F.col("own_n")
    found = checkpointed(best.select("word", "n_near", F.when(taken, F.col("best.other")).alias("form"), F.when(taken, -F.col("best.minus")).alias("form_n")))
    led = roots(found.where("form is not null").select("word", "form"))
    out = words.join(found, "word", "left").join(led, "word", "left")
    return out.select("word", "n", "form", F.coalesce("root", "word").alias("root"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n"))


def spelling_variants(docs: DataFrame, every: int = 97, letters: int = 5, least: int = 3) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of at least ``letters`` letters that occur ``least`` times in all texts."""
    found = runs(docs)
    counted = found.select(misspelled(found, every).alias("word")).where(F.length("word") >= letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return grouped(counted.where(F.col("n") >= least)).select("word", "form", "root", "n", "n_near", "form_n")
