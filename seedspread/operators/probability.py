"""Edge probabilities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def weighted_cascade(degree: Column, count: Column) -> Column:
    """1 - (1 - 1/degree)^count."""
    return 1 - F.pow(1 - 1 / degree, count)


def uniform(count: Column, p: float = 0.01) -> Column:
    """Noisy-or of ``count`` parallel edges of probability ``p``."""
    return 1 - F.pow(F.lit(1 - p), count)


def hash_coin(*parts: Column) -> Column:
    """A reproducible number in [0, 1) for a key: the first 8 hex digits of its md5."""
    key = F.concat_ws("-", *[x.cast("string") for x in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def trivalency(*parts: Column, levels: tuple[float, ...] = (0.2, 0.04, 0.008)) -> Column:
    """One of ``levels`` by the key's coin."""
    return F.element_at(F.array(*map(F.lit, levels)), (F.floor(hash_coin(*parts) * len(levels)) + 1).cast("int"))


def two_level(forward: Column, backward: Column, high: float = 0.1, low: float = 0.01) -> Column:
    """``high`` in the direction of the larger probability, else ``low``."""
    return F.when(forward > backward, F.lit(high)).otherwise(F.lit(low))


def topic(weights: Column, item: Column) -> Column:
    """Dot product of an edge's topic weights and an item, at most 1."""
    total = F.aggregate(F.zip_with(weights, item, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.least(F.lit(1.0), total)


def strongest_topic(weights: Column) -> Column:
    return F.array_max(weights)


def divergence(p: Column, q: Column, floor: float = 1e-7) -> Column:
    """Kullback-Leibler divergence of two arrays; zeros count as ``floor``."""
    fill = lambda x: F.when(x == 0, F.lit(floor)).otherwise(x)
    return F.aggregate(F.zip_with(p, q, lambda a, b: fill(a) * F.ln(fill(a) / fill(b))), F.lit(0.0), lambda s, x: s + x)


def degree_discount(degree: Column, chosen: Column, p: float = 0.01) -> Column:
    """d - 2t - p t (d - t) for a vertex of degree d with t chosen neighbours."""
    return degree - 2 * chosen - p * chosen * (degree - chosen)
