"""Near duplicates among embeddings: exact cosine join by PCA-ordered tiles.

For each length of vectors, principal axes are fitted on a bounded sample. Vectors are dealt into cells by their leading
components: a tree halves the sample along the widest of them until cells hold about ``BLOCK`` vectors. Two vectors with
cosine >= t are no further apart than sqrt(2 - 2 t), and neither are their leading components: cells whose boxes (of all
vectors, not of the sample) are further apart are never compared. A cell with more vectors than a block is dealt by hash into
several parts. Each part is packed into a few rows, which go to the pairs of parts that it takes part in; so rows of vectors
are shuffled once, and one task holds two parts at most.

Within a pair of parts, tiles are compared: the product over the leading components comes first, and what the remaining ones
can add is bounded by the product of the suffix norms. Where few pairs are left, they go on, more components at a time,
until their cosine cannot reach the threshold any more; the rest gets its full cosine in double precision. Nothing is
approximate: axes, tree and sample only decide how much is skipped. On data without structure all cells meet, and the
work grows with the square of the number of distinct vectors, as any exact join's does.

Rows: each row is a vector, whether or not it repeats a vec_id or lacks one; a null vec_id is no component's least, and a
component without any vec_id has a null one, whose rows are all kept. Vectors that are null, empty, zero, or hold a null, NaN
or infinite component link with nothing, and vectors of different lengths don't link. Equal vectors are compared once and
their links counted. Labels and other columns don't matter. The input is read twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedspread.llm import blocks
from seedspread.llm.components import components
from seedspread.llm.session import checkpointed

THRESHOLD = 0.9
#: Vectors of a part (fewer of long ones: ``BLOCK_VALUES`` components at most), of a tile, and of a packed row.
BLOCK, BLOCK_VALUES, TILE, PACK = 8192, 1 << 20, 2048, 1024
#: Leading components: that are added between two bounds, that are rotated at all, and that cells are made of.
STEP, LEAD, CELL = 24, 96, 8
#: Vectors of each length that axes and cells are fitted on, at most, and their components; cells of a length.
SAMPLE, SAMPLE_VALUES, CELLS = 16_384, 1 << 22, 1024
#: Slack of bounds against rounding, in single precision.
SLACK = 1e-5


def block_size(dim: int) -> int:
    return max(64, min(BLOCK, BLOCK_VALUES // max(1, dim)))


def matrix(column: pa.Array | np.ndarray, rows: int) -> np.ndarray:
    """Vectors of one length as unit rows in double precision; scaled first, so that no square overflows or vanishes."""
    values = np.asarray(column.flatten() if isinstance(column, pa.Array) else column).astype(np.float64).reshape(rows, -1)
    values /= np.abs(values).max(axis=1, keepdims=True)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


class Cells:
    """Principal axes of one length, and a tree that deals vectors by their leading components."""

    def __init__(self, sample: np.ndarray, n: int):
        dim = sample.shape[1]
        self.axes = np.linalg.eigh(sample.T @ sample)[1][:, ::-1][:, : min(dim, LEAD)].copy()
        self.depth = max(0, int(np.ceil(np.log2(min(CELLS, n / block_size(dim), max(1, len(sample) // 8))))))
        self.along, self.cut = np.zeros((1 << self.depth) - 1, np.int64), np.zeros((1 << self.depth) - 1)
        place = (sample @ self.axes)[:, :CELL]
        members = {0: np.arange(len(sample))}
        for node in range(len(self.cut)):
            rows = members.pop(node)
            if len(rows):
                self.along[node] = np.argmax(np.ptp(place[rows], axis=0))
                self.cut[node] = np.median(place[rows, self.along[node]])
            high = place[rows, self.along[node]] > self.cut[node]
            members[2 * node + 1], members[2 * node + 2] = rows[~high], rows[high]
        #: Of each cell: its parts, and after ``finish`` the number of the first, and the cells within reach, itself included.
        self.parts = np.ones(1 << self.depth, np.int64)

    def cell(self, place: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(place), np.int64), np.arange(len(place))
        for _ in range(self.depth):
            node = 2 * node + 1 + (place[rows, self.along[node]] > self.cut[node])
        return node - len(self.cut)

    def place(self, x: np.ndarray) -> np.ndarray:
        return x @ self.axes[:, :CELL]

    def finish(self, boxes: dict[int, tuple[int, np.ndarray, np.ndarray]], dim: int, width: float) -> None:
        """``boxes``: number of vectors, least and largest leading components of the cells that have any."""
        n = 1 << self.depth
        low, high = np.full((n, CELL), -np.inf), np.full((n, CELL), np.inf)  # a cell without a box is near all: rounding may put a vector there
        for c, (count, least, most) in boxes.items():
            low[c], high[c], self.parts[c] = least, most, -(-count // block_size(dim))
        self.first = np.cumsum(self.parts) - self.parts
        self.near = []
        for c in range(n):
            gap = np.maximum(0, np.maximum(low - high[c], low[c] - high))
            self.near.append(np.flatnonzero((gap**2).sum(axis=1) <= width**2 + SLACK))

    def part(self, cell: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return self.first[cell] + salt % self.parts[cell]

    def partners(self, part: int) -> np.ndarray:
        """The parts, in any order, that ``part`` is compared with, itself included."""
        cell = int(np.searchsorted(self.first + self.parts, part, "right"))
        return np.concatenate([np.arange(self.first[c], self.first[c] + self.parts[c]) for c in self.near[cell]])


def boxes(vectors: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """dim, cell, n, and the least and largest of each leading component, over all vectors of the lengths in ``cells``."""
    ends = [f"{end}{k}" for end in ("low", "high") for k in range(CELL)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                place = cells[d].place(matrix(part.column("v"), part.num_rows))
                cell = cells[d].cell(place)
                order = np.argsort(cell, kind="stable")
                found, starts, n = np.unique(cell[order], return_index=True, return_counts=True)
                place = np.pad(place, ((0, 0), (0, CELL - place.shape[1])))[order]
                sides = np.concatenate([np.minimum.reduceat(place, starts), np.maximum.reduceat(place, starts)], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), d)), pa.array(found), pa.array(n), *map(pa.array, sides.T.copy())], names=["dim", "cell", "n", *ends])

    found = vectors.where(F.col("dim").isin(list(cells))).select("dim", "v").mapInArrow(run, "dim long, cell long, n long, " + ", ".join(f"{e} double" for e in ends))
    return found.groupBy("dim", "cell").agg(F.sum("n").alias("n"), *[(F.min if e.startswith("low") else F.max)(e).alias(e) for e in ends])


def plan(vectors: DataFrame, width: float) -> dict[int, Cells]:
    """Cells of each length with more vectors than a block. Rows that reach the driver: those lengths, their samples, their cells."""
    dim = F.col("dim")
    size = F.greatest(F.lit(64), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_VALUES) / dim)))
    large = {r.dim: r.n for r in vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size).collect()}
    cells: dict[int, Cells] = {}
    for d, n in large.items():
        share = min(1.0, min(SAMPLE, max(64, SAMPLE_VALUES // d)) / n)
        drawn = vectors.where((dim == d) & (F.pmod(F.xxhash64(F.lit(5), "node"), F.lit(1 << 30)) < int(share * (1 << 30)))).select("v")
        table = drawn.toArrow()
        sample = matrix(table.column("v").combine_chunks(), table.num_rows) if table.num_rows else np.eye(d)
        cells[d] = Cells(sample, n)
    if cells:
        found: dict[int, dict] = {d: {} for d in cells}
        for r in boxes(vectors, cells).collect():
            found[r.dim][r.cell] = (r.n, np.array([r[f"low{k}"] for k in range(CELL)]), np.array([r[f"high{k}"] for k in range(CELL)]))
        for d, c in cells.items():
            c.finish(found[d], d, width)
    return cells


def dealt(vectors: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """dim, part, node, copies, v of each distinct vector; lengths without cells are one part."""
    kind = vectors.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, nodes = batch.column("dim").to_numpy(), batch.column("node").to_numpy()
            part = np.zeros(len(dims), np.int64)
            for d in set(np.unique(dims).tolist()) & cells.keys():
                rows = np.flatnonzero(dims == d)
                x = matrix(batch.column("v").take(pa.array(rows)), len(rows))
                salt = (nodes[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                part[rows] = cells[d].part(cells[d].cell(cells[d].place(x)), salt)
            yield pa.RecordBatch.from_arrays([batch.column("dim"), pa.array(part), batch.column("node"), batch.column("copies"), batch.column("v")], names=["dim", "part", "node", "copies", "v"])

    return vectors.select("dim", "node", "copies", "v").mapInArrow(run, f"dim long, part long, node long, copies long, v {kind}")


def packed(members: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """dim, low, high (the parts of a pair), part, n, nodes, copies, vectors (packed): each part for each pair that it is in."""
    schema = "dim long, low long, high long, part long, n long, nodes binary, copies binary, vectors binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in blocks.units(batches, "dim", "part"):
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                d, p = table.column("dim")[a].as_py(), table.column("part")[a].as_py()
                others = cells[d].partners(p) if d in cells else np.zeros(1, np.int64)
                for at in range(a, b, PACK):
                    few = table.slice(at, min(PACK, b - at)).combine_chunks()
                    raw = [np.asarray(few.column(c).to_numpy()).tobytes() for c in ("node", "copies")] + [np.asarray(few.column("v").combine_chunks().flatten()).tobytes()]
                    for some in np.array_split(others, -(-len(others) // 16)):
                        n = len(some)
                        keys = [np.full(n, d), np.minimum(some, p), np.maximum(some, p), np.full(n, p), np.full(n, few.num_rows)]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, keys), *(pa.array([r] * n, pa.binary()) for r in raw)], names=["dim", "low", "high", "part", "n", "nodes", "copies", "vectors"])

    return members.repartition("dim", "part").sortWithinPartitions("dim", "part").mapInArrow(run, schema)


class Side:
    """Vectors of a part, ready to be compared."""

    def __init__(self, unit: np.ndarray, axes: np.ndarray):
        self.unit, self.lead = unit, (unit @ axes).astype(np.float32)
        self.steps = [*range(STEP, self.lead.shape[1], STEP), self.lead.shape[1]]
        sums = np.cumsum(np.square(self.lead, dtype=np.float64), axis=1)[:, np.array(self.steps) - 1]
        self.rest = np.sqrt(np.maximum(0, 1 - sums)).astype(np.float32)
        #: The first leading components with the suffix norm as one more: their products are the first bounds.
        self.first = np.append(self.lead[:, : self.steps[0]], self.rest[:, :1], axis=1)


def tile_links(one: Side, two: Side, a: slice, b: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j), counted from the slices' starts, with a cosine of at least ``threshold``."""
    alive = one.first[a] @ two.first[b].T >= np.float32(threshold - SLACK)
    left = int(np.count_nonzero(alive))
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if left * 64 > alive.size:  # many are alike: all in one product
        return np.nonzero(one.unit[a] @ two.unit[b].T >= threshold)
    i, j = np.nonzero(alive)
    keep = []
    for k in range(0, len(i), 100_000):
        p, q = i[k : k + 100_000], j[k : k + 100_000]
        total = np.zeros(len(p), np.float32)
        for s, (begin, end) in enumerate(zip([0, *one.steps], one.steps, strict=False)):
            total += np.einsum("ij,ij->i", one.lead[a][p, begin:end], two.lead[b][q, begin:end])
            stay = total + one.rest[a][p, s] * two.rest[b][q, s] >= threshold - SLACK
            p, q, total = p[stay], q[stay], total[stay]
        stay = np.einsum("ij,ij->i", one.unit[a][p], two.unit[b][q]) >= threshold
        keep.append((p[stay], q[stay]))
    return tuple(map(np.concatenate, zip(*keep, strict=True)))


def linked(cells: dict[int, Cells], threshold: float, element: str):
    """Each vector's links within a pair of parts: node, n_links, near (the least node that it is linked with there)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in blocks.units(batches, "dim", "low", "high"):
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                d, parts = table.column("dim")[a].as_py(), table.column("part").to_numpy()[a:b]
                if table.column("low")[a].as_py() != table.column("high")[a].as_py() and (parts == parts[0]).all():
                    continue  # the other part is empty
                axes = cells[d].axes if d in cells else np.eye(d)[:, :LEAD]
                ids, copies, raw, n = (table.column(c).slice(a, b - a).to_pylist() for c in ("nodes", "copies", "vectors", "n"))
                sides, ends = [], [0]
                for p in np.unique(parts).tolist():
                    of = np.flatnonzero(parts == p).tolist()
                    ends.append(ends[-1] + sum(n[k] for k in of))
                    sides.append(Side(matrix(np.frombuffer(b"".join(raw[k] for k in of), element), ends[-1] - ends[-2]), axes))
                order = np.argsort(parts, kind="stable").tolist()
                ids, copies = (np.frombuffer(b"".join(x[k] for k in order), np.int64) for x in (ids, copies))
                one, two, shift = sides[0], sides[-1], ends[-2]
                count, root = np.zeros(len(ids)), np.arange(len(ids))
                for s in range(0, len(one.unit), TILE):
                    for u in range(s if one is two else 0, len(two.unit), TILE):
                        i, j = tile_links(one, two, slice(s, s + TILE), slice(u, u + TILE), threshold)
                        if one is two and s == u:
                            upper = i < j
                            i, j = i[upper], j[upper]
                        i, j = i + s, j + u + shift
                        count += np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
                        i, j = root[i], root[j]
                        apart = i != j
                        root = blocks.forest(len(ids), i[apart], j[apart])[root]  # no link is kept beyond its tile
                least = np.full(len(ids), np.iinfo(np.int64).max)
                np.minimum.at(least, root, ids)
                some = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(count[some].astype(np.int64)), pa.array(least[root[some]])], names=["node", "n_links", "near"])

    return run


def usable(v: Column) -> Column:
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(good, F.lit(False))


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each vector: vec_id, n_links, component_id (least vec_id that links reach), kept (it is that least)."""
    kind = embeddings.schema[vector].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = embeddings.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v"))
    rows = rows.withColumn("fine", usable(F.col("v")))
    reps = rows.where("fine").groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    reps = checkpointed(reps.select(F.monotonically_increasing_id().alias("node"), "least", "copies", "v", F.size("v").cast("long").alias("dim")))
    cells = plan(reps, float(np.sqrt(max(0.0, 2 - 2 * threshold))))
    pairs = packed(dealt(reps, cells), cells)
    found = pairs.repartition("dim", "low", "high").sortWithinPartitions("dim", "low", "high")
    found = checkpointed(found.mapInArrow(linked(cells, threshold, "<f4" if single else "<f8"), "node long, n_links long, near long"))
    joined = components(found.select(F.col("node").alias("a"), F.col("near").alias("b")))
    least = joined.join(reps.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("component_id"))
    named = joined.join(least, "component").select("node", "component_id")
    counts = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    linked_nodes = counts.join(named, "node", "full")
    known = reps.join(linked_nodes, "node", "left").select(F.col("v").alias("of"), "least", "copies", "n_links", "component_id", F.lit(True).alias("known"))
    out = rows.join(known, (F.col("v") == F.col("of")) & F.col("fine"), "left")
    out = out.select(
        "vec_id",
        F.when(F.col("fine"), F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).otherwise(0).cast("long").alias("n_links"),
        F.when(F.col("fine"), F.coalesce("component_id", "least")).otherwise(F.col("vec_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
