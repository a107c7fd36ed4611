"""Comparing the members of groups of any size block by block.

A group of ``n`` members is dealt by hash into ``ceil(n / block)`` parts, and each pair of parts is a unit that is compared in
one task; so no group is ever gathered whole, and two members meet in exactly one unit of their group. Units arrive at a
task sorted, and are taken from the Arrow batches one after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs that are held as index arrays at once.
PAIRS = 400_000


def deal(members: DataFrame, group: str, size: Column, member: str, block: int, also: list[str]) -> DataFrame:
    """A row for each unit that a member takes part in: group, low, high (the unit's parts), part (the member's), ``also``.

    ``size``: the number of members of the group, a column of ``members``."""
    parts = F.greatest(F.lit(1), F.ceil(size / F.lit(block))).cast("int")
    own = F.pmod(F.xxhash64(F.lit(7), F.col(member)), parts).cast("int")
    dealt = members.withColumn("_parts", parts).withColumn("part", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return dealt.select(group, F.least("part", "_other").alias("low"), F.greatest("part", "_other").alias("high"), "part", *also)


def gathered(dealt: DataFrame, group: str, member: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``run`` over the rows of ``dealt``, where the rows of a unit follow each other, its least ``member`` first.

    So the least row that links reach is the least member, and units that overlap name the same one."""
    return dealt.repartition(group, "low", "high").sortWithinPartitions(group, "low", "high", member).mapInArrow(run, schema)


def units(batches: Iterator[pa.RecordBatch], *key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole units (rows of equal ``key`` columns), and the row at which each unit starts (with the end)."""
    tail: pa.Table | None = None

    def cut(table: pa.Table) -> np.ndarray:
        keys = [table.column(c).to_numpy() for c in key]
        new = np.zeros(max(0, table.num_rows - 1), bool)
        for k in keys:
            new |= k[1:] != k[:-1]
        return np.concatenate([[0], np.flatnonzero(new) + 1, [table.num_rows]])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([tail, table]) if tail is not None else table
        starts = cut(table)
        if len(starts) > 2:
            yield table.slice(0, starts[-2]).combine_chunks(), starts[:-1]
        tail = table.slice(starts[-2])
    if tail is not None and tail.num_rows:
        yield tail.combine_chunks(), cut(tail)


def pairs(table: pa.Table, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index arrays of the row pairs to compare: all of a unit of one part, else those across its two parts."""
    part, low, high = (table.column(c).to_numpy() for c in ("part", "low", "high"))
    left, right, held = [], [], 0
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if low[a] == high[a]:
            i, j = np.triu_indices(b - a, 1)
            i, j = i + a, j + a
        else:
            one, two = a + np.flatnonzero(part[a:b] == low[a]), a + np.flatnonzero(part[a:b] == high[a])
            i, j = np.repeat(one, len(two)), np.tile(two, len(one))
        left.append(i)
        right.append(j)
        held += len(i)
        if held > PAIRS:
            yield np.concatenate(left), np.concatenate(right)
            left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows the least row that the links (left, right) reach."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (root == before).all():
            return root


def binary_matrix(column: pa.ChunkedArray | pa.Array, dtype: np.dtype, width: int) -> np.ndarray:
    """A column of equally long binaries as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset :]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[len(column)]]
    return data.view(dtype).reshape(len(column), width)


def strings(table: pa.Table, name: str) -> pa.Array:
    return pc.cast(table.column(name), pa.large_string()).combine_chunks()
