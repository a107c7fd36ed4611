"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to), so the flow network has one node a
pattern and one a source, whatever the number of documents. A pattern of ``w`` words can send ``w`` words at no cost (each
document once) and each further ``w`` words at a cost that rises with every repetition; each source takes its quota. The
cheapest flow therefore repeats as little as it can. Documents are then picked in a seeded random order until the flow of
their pattern is used up; the last one counts with the rest of the flow only, so sums meet the flow exactly.

Only aggregated rows reach the driver: at most ``MAX_PATTERNS`` patterns, else an error. The running total over the
documents of a pattern is taken over buckets of the seeded order, then over the buckets inside the one where the flow ends,
and document by document only inside the one of those (a millionth of the pattern) where it ends, so a pattern that
holds a third of all documents is never sorted in one task.

Rows: a null text has size 0; a null source is a source of its own, ordered last; documents without words take
nothing. Rows with the same key share one place in the order and take alike. Other columns are kept. Empty tables give
empty results.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedspread.llm.session import checkpointed, small_side

MAX_PATTERNS = 20_000
BUCKETS = 1024

Source = str | None


def word_count(text: Column) -> Column:
    """Runs of other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def by_code_point(sources) -> list[Source]:
    return sorted(sources, key=lambda s: (s is None, s or ""))


def quotas(sizes: dict[Source, int], weights: tuple[float, ...], share: float, most: float) -> dict[Source, float]:
    """Targets: ``share`` of all words by weight, none above ``most`` times its source's, the excess dealt again by weight.

    Weights repeat over the sources by code point, null last. What is left when all are at their limit is lost."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(by_code_point(sizes))}
    target: dict[Source, float] = {}
    free, left = set(sizes), share * sum(sizes.values())
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in by_code_point(free) if weight[s] * unit > most * sizes[s]]
        if not over:
            return target | {s: weight[s] * unit for s in free}
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
            free.remove(s)
    return target


def route(supply: dict[tuple[Source, ...], int], target: dict[Source, float], most: int) -> dict[tuple[Source, ...], int]:
    """Words that each pattern sends in the cheapest flow that meets the targets, as far as they can be met.

    Successive cheapest paths: words reach a source from a pattern of its own or by way of another source that gives up
    some of a shared pattern and is served elsewhere. Moving is free and the n-th repetition of a pattern costs n - 1 a word,
    so the cheapest path ends at the pattern within reach that has been repeated least."""
    used = dict.fromkeys(supply, 0)
    sent: dict[tuple, dict[Source, int]] = {p: defaultdict(int) for p in supply}
    serving: dict[Source, list[tuple]] = defaultdict(list)
    for p in supply:
        for s in p:
            serving[s].append(p)
    for source in by_code_point(target):
        need = round(target[source])
        while need > 0:
            came: dict[tuple, tuple] = {}  # pattern -> (source it would serve, pattern that this source would give up)
            seen, queue = {source}, deque([(source, None)])
            while queue:
                at, given = queue.popleft()
                for p in serving[at]:
                    if p not in came:
                        came[p] = (at, given)
                        for other in by_code_point(t for t, w in sent[p].items() if w > 0 and t not in seen):
                            seen.add(other)
                            queue.append((other, p))
            free = [p for p in came if supply[p] and used[p] < most * supply[p]]
            if not free:
                break
            end = min(free, key=lambda p: used[p] // supply[p])
            amount, p = min(need, supply[end] - used[end] % supply[end]), end
            while (given := came[p][1]) is not None:
                amount, p = min(amount, sent[given][came[p][0]]), given
            p = end
            while p is not None:
                at, given = came[p]
                sent[p][at] += amount
                if given is not None:
                    sent[given][at] -= amount
                p = given
            used[end] += amount
            need -= amount
    return used


def mix(
    docs: DataFrame, members: Column, size: Column, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 0, key: str = "doc_id"
) -> tuple[DataFrame, dict[Source, tuple[int, float]]]:
    """``docs`` with ``size`` and ``taken`` (words that the mix takes, repeats counted); and (size, target) of each source.

    ``members``: array of the sources of a document; it counts to the size of each of them."""
    spark = docs.sparkSession
    order = F.xxhash64(F.lit(seed), F.col(key))
    bucket = {name: F.pmod(F.shiftrightunsigned(order, bits), F.lit(BUCKETS)) for name, bits in (("_bucket", 32), ("_inner", 8))}
    placed = docs.withColumn("size", size).withColumns({"_pattern": F.array_sort(F.array_distinct(members)), "_order": order, **bucket})
    inner = checkpointed(placed.groupBy("_pattern", "_bucket", "_inner").agg(F.sum("size").alias("_words")))
    sums = inner.groupBy("_pattern", "_bucket").agg(F.sum("_words").alias("_words"))
    found = sums.groupBy("_pattern").agg(F.sum("_words").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns of sources; join rare sources first")
    supply = {tuple(r._pattern): r.words for r in found}
    sizes: dict[Source, int] = defaultdict(int)
    for pattern, words in supply.items():
        for s in pattern:
            sizes[s] += words
    target = quotas(sizes, weights, share, most)
    sends = route(supply, target, most)
    plan = spark.createDataFrame([(list(p), w // max(1, supply[p]), w % max(1, supply[p])) for p, w in sends.items()], "_sender array<string>, _rounds long, _rest long")
    plan = F.broadcast(plan)  # a row for each pattern
    own = sums.join(plan, F.expr("_pattern <=> _sender"))
    before = F.sum("_words").over(Window.partitionBy("_pattern").orderBy("_bucket")) - F.col("_words")
    holds = "_before <= _rest and _rest < _before + _words"
    ends = own.withColumn("_before", before).where(holds).select("_sender", "_rounds", "_rest", F.col("_bucket").alias("_end"), F.col("_before").alias("_outer"))
    within = inner.join(F.broadcast(ends), F.expr("_pattern <=> _sender and _bucket = _end"))
    before = F.col("_outer") + F.sum("_words").over(Window.partitionBy("_pattern").orderBy("_inner")) - F.col("_words")
    ends = within.withColumn("_before", before).where(holds).select("_sender", "_rounds", "_rest", "_end", F.col("_inner").alias("_inner_end"), "_before")
    ends = F.broadcast(checkpointed(ends))  # a row for each pattern
    dealt = placed.join(ends, F.expr("_pattern <=> _sender"), "left")
    last = dealt.where("_bucket = _end and _inner = _inner_end").groupBy("_pattern", "_order", key).agg(F.first("_rest").alias("_rest"), F.first("_before").alias("_before"), F.sum("size").alias("_words"))
    ahead = F.col("_before") + F.sum("_words").over(Window.partitionBy("_pattern").orderBy("_order", key)) - F.col("_words")
    last = last.select(F.col(key).alias("_key"), F.col("_pattern").alias("_of"), F.greatest(F.lit(0), F.col("_rest") - ahead).alias("_room"))
    last = small_side(checkpointed(last))  # a bucket in a bucket of each pattern; else documents would be shuffled with their texts
    at_end = F.expr("_bucket = _end and _inner = _inner_end")
    dealt = dealt.join(last, F.expr(f"_pattern <=> _of and `{key}` <=> _key and _bucket = _end and _inner = _inner_end"), "left")
    part = F.when(F.expr("_bucket < _end or _bucket = _end and _inner < _inner_end"), F.col("size")).when(at_end, F.least("size", "_room")).otherwise(0)
    taken = F.coalesce(F.col("_rounds") * F.col("size") + part, F.lit(0)).cast("long")
    return dealt.select(*docs.drop("size", "taken").columns, "size", taken.alias("taken")), {s: (sizes[s], target[s]) for s in target}


def mix_words(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: the mix of all documents at 150 % of their words, sources weighing 3, 1, 2."""
    spark = docs.sparkSession
    slim = checkpointed(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    mixed, sources = mix(slim, F.array("source"), F.col("size"))
    of = F.broadcast(spark.createDataFrame([(s, n, float(t)) for s, (n, t) in sources.items()], "_source string, source_size long, target double"))
    return mixed.join(of, F.expr("source <=> _source"), "left").select("doc_id", "size", "source_size", "target", "taken")


def resample(docs: DataFrame) -> DataFrame:
    """``docs`` with each document as often as the mix takes it, to the nearest whole copy; the columns of ``docs``.

    Columns of any name stay as they are, ``size`` and ``taken`` too."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "source", word_count(F.col("text")).alias("_n"))
    mixed, _ = mix(rows, F.array("source"), F.col("_n"))
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return mixed.where(copies > 0).select("_row", F.explode(F.array_repeat(F.lit(1), copies))).select("_row.*")
