"""Exact join of vectors by angle.

Equal vectors are one class, of which the first page stands for the others. The angle between
vectors is a metric: vectors go to the cell of their nearest pivot, large cells are cut into rings
by the angle to it, large rings into parts, and two blocks meet only if the triangle inequality
lets a vector of one come within the threshold's angle of one of the other. What meets is
compared by products of blocks, which tasks read from the kept files: each row is shuffled and
written a fixed number of times, however many blocks meet. Neighbouring blocks are read together, as a pack. Where the data
have no clusters every block meets every other, as they must; in clustered data a block is compared with its neighbours only,
whatever the number of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import values as V
from quillon.lineage import kept

#: Doubles of a block (8 MB) and of all pivots, which go to every task.
BLOCK = PIVOTS = 1 << 20
#: Most pivots, rings of a cell and salts of a class.
CELLS, RINGS, SALTS = 1024, 64, 16
#: Angles round; blocks this much farther apart still meet.
SLACK = 1e-6
#: Doubles of a pack (16 MB), packs that a large table has at least, cosines that stay in a core's cache, and what one in single precision may be off.
PACK, PACKS, TILE, SINGLE = 1 << 21, 16, 1 << 18, 1e-4


def classes(pages: DataFrame, ord_: str = "ord", vector: str = "vector") -> tuple[DataFrame, DataFrame]:
    """(representatives (o, v, l), copies (page, first)) of pages with a vector of some length: of
    equal vectors the first page stands for the others. Rows of a class are joined in parts."""
    rows = pages.where(F.size(vector) > 0).select(F.col(ord_).alias("o"), F.col(vector).cast("array<double>").alias("v"))
    firsts = kept(rows.groupBy("v").agg(F.min("o").alias("first"), F.count("*").alias("n")))
    length = F.coalesce(F.sqrt(V.dot(F.col("v"), F.col("v"))), F.lit(0.0))
    reps = firsts.select(F.col("first").alias("o"), "v", length.alias("l")).where("l > 0")
    # two hashes tell a vector, so vectors are neither sent for each salt nor sorted
    told = [F.xxhash64(F.lit(i), "v").alias(f"h{i}") for i in range(2)]
    many = firsts.where((F.col("n") > 1) & (length > 0)).select(*told, "first").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.select(F.col("o").alias("page"), *told, F.pmod(F.xxhash64("o"), F.lit(SALTS)).cast("int").alias("salt"))
    copies = salted.join(many, ["h0", "h1", "salt"]).where("page <> first").select("page", "first").distinct()
    return reps, copies


def matrix(vectors: pa.Array, rows: int) -> np.ndarray:
    """Vectors of one width as the rows of a matrix of doubles."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


@dataclass
class Cells:
    """Blocks of vectors: their width, pivot (-1: none), nearest and farthest angle to it, rows and parts."""

    pivots: np.ndarray
    width: np.ndarray
    pivot: np.ndarray
    near: np.ndarray
    far: np.ndarray
    rows: np.ndarray
    part: np.ndarray

    def apart(self, i: int, some: np.ndarray) -> np.ndarray:
        """Least angle between a vector of block ``i`` and one of each of the blocks ``some``."""
        p, q = self.pivot[i], self.pivot[some]
        known = (p >= 0) & (q >= 0)
        between = np.zeros(len(some))
        if p >= 0 and len(self.pivots):
            between = np.arccos(np.clip(self.pivots[q] @ self.pivots[p], -1, 1))
        rings = np.where(p == q, np.maximum(self.near[some] - self.far[i], self.near[i] - self.far[some]), 0)
        least = np.maximum(np.where(p == q, 0, between) - self.far[i] - self.far[some], rings)
        return np.where(self.width[some] != self.width[i], np.inf, np.where(known, least, 0))

    def meetings(self, i: int, angle: float) -> np.ndarray:
        """Blocks from ``i`` on that block ``i`` meets."""
        some = np.arange(i, len(self.pivot))
        return some[self.apart(i, some) <= angle + SLACK]

    def compared(self, angle: float) -> int:
        """Pairs of vectors that are compared."""
        total = 0
        for i in range(len(self.pivot)):
            met = self.meetings(i, angle)
            total += int(self.rows[i]) * int(self.rows[met].sum()) - int(self.rows[i]) * (int(self.rows[i]) + 1) // 2
        return total


def dealt(reps: DataFrame, block_rows: int | None = None) -> tuple[DataFrame, Cells]:
    """Vectors (o, v, l, and what else a row has) with their block, and the blocks. The driver sees the pivots, a count of each
    ring and the blocks, never vectors by number of rows."""
    n, width = reps.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    block_rows = block_rows or max(1, BLOCK // width)
    wanted = max(1, min(CELLS, PIVOTS // width, 4 * -(-n // block_rows)))
    # vectors of the least hashes are a sample that reruns agree on
    sample = [np.array(r[0], float) / r[1] for r in reps.orderBy(F.xxhash64("v"), "o").select("v", "l").limit(wanted).collect()] if n > block_rows else []
    common = max((len(p) for p in sample), key=[len(p) for p in sample].count) if sample else 0
    pivots = np.array([p for p in sample if len(p) == common and np.isfinite(p).all()]).reshape(-1, max(common, 1))
    names = ["o", "v", "l", *(c for c in reps.columns if c not in ("o", "v", "l"))]
    kinds = ", ".join(f"{c} {reps.schema[c].dataType.simpleString()}" for c in names)

    def nearest(batches):
        for b in batches:
            vectors, l = b.column(1), b.column(2).to_numpy()
            sizes = np.asarray(vectors.value_lengths())
            pivot, ring = np.full(len(l), -1, np.int32), np.zeros(len(l), np.int32)
            own = np.flatnonzero(sizes == common)
            if len(own) and len(pivots):
                x = matrix(vectors.take(pa.array(own)), len(own)) / l[own, None]
                cosines = x @ pivots.T
                fine = np.isfinite(cosines).all(axis=1)
                best = cosines.argmax(axis=1)
                angle = np.arccos(np.clip(cosines[np.arange(len(own)), best], -1, 1))
                pivot[own[fine]] = best[fine]
                ring[own[fine]] = np.minimum(angle[fine] / np.pi * RINGS, RINGS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes, pa.int32()), pa.array(pivot), pa.array(ring)], names=[*names, "width", "pivot", "ring"])

    rows = kept(reps.select(*names).mapInArrow(nearest, f"{kinds}, width int, pivot int, ring int"))
    counts = sorted(map(tuple, rows.groupBy("width", "pivot", "ring").agg(F.count("*")).collect()))
    step, blocks, table = np.pi / RINGS, [], []
    held: list[tuple] = []

    def close() -> None:
        if not held:
            return
        total = sum(c[3] for c in held)
        parts = -(-total // block_rows)
        first = len(blocks)
        w, p = held[0][:2]
        for part in range(parts):
            blocks.append((w, p, held[0][2] * step if p >= 0 else 0.0, (held[-1][2] + 1) * step if p >= 0 else np.pi, -(-total // parts), part))
        table.extend((w, p, c[2], first, parts) for c in held)
        held.clear()

    for c in counts:
        # neighbouring rings of a cell share a block while they fit
        if held and (held[0][:2] != c[:2] or sum(x[3] for x in held) + c[3] > block_rows):
            close()
        held.append(c)
    close()
    cells = Cells(pivots, *(np.array(x) for x in zip(*blocks, strict=True))) if blocks else Cells(pivots, *(np.zeros(0, int) for _ in range(6)))
    spark = reps.sparkSession
    known = spark.createDataFrame(table, "width int, pivot int, ring int, first int, parts int")
    # at most CELLS * RINGS rows for each width of vectors, of which one has more than one pivot
    placed = rows.join(F.broadcast(known), ["width", "pivot", "ring"]).withColumn("block", F.col("first") + F.pmod(F.xxhash64("o"), F.col("parts")).cast("int"))
    return placed.select(*names, "block"), cells


def compare(x: np.ndarray, y: np.ndarray, threshold: float, same: bool, tile: int = TILE):
    """(i, j) of rows of unit vectors that may reach the threshold, told in single precision, in parts; ``same``: each pair once."""
    x, across = x.astype(np.float32), np.ascontiguousarray(y.T, np.float32)
    wide = min(max(len(y), 1), 2048)
    step, least = max(1, tile // wide), np.float32(threshold - SINGLE)
    found, held = [], 0
    for at in range(0, len(x), step):
        for left in range(at - at % wide if same else 0, len(y), wide):
            near = x[at : at + step] @ across[:, left : left + wide] >= least
            # places of a flat array are found many times faster than those of a matrix
            i, j = np.divmod(np.flatnonzero(near), near.shape[1])
            i, j = i + at, j + left
            if same:
                i, j = i[j > i], j[j > i]
            if len(i):
                found.append((i, j))
                held += len(i)
        if held >= tile:
            yield tuple(np.concatenate(c) for c in zip(*found, strict=True))
            found, held = [], 0
    if found:
        yield tuple(np.concatenate(c) for c in zip(*found, strict=True))


def read(data: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all().combine_chunks()


def written(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def product(packed: DataFrame, run: Callable[[pa.Table, pa.Table, bool], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``run`` makes of each two packs (i, met, data) that meet, and of each pack with itself. Packs are kept, and a
    partition holds one or few; a task of their product reads those of its two partitions where they are kept."""
    packed = kept(packed)
    left = packed.select("i", "met", F.col("data").alias("x"))
    right = packed.select(F.col("i").alias("j"), F.col("data").alias("y")).hint("shuffle_replicate_nl")
    pairs = left.join(right, (F.col("i") <= F.col("j")) & (F.col("met").isNull() | F.array_contains("met", F.col("j"))))
    pairs = pairs.select("x", F.when(F.col("i") != F.col("j"), F.col("y")).alias("y"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one, other in zip(b.column("x"), b.column("y"), strict=True):
                x = read(one)
                yield from run(x, read(other) if other.is_valid else x, not other.is_valid)

    return pairs.mapInArrow(meet, schema)


def packs(cells: Cells, width: int) -> np.ndarray:
    """The pack of each block: neighbouring blocks share one of at most ``PACK`` doubles or one block, and of so few
    that a table of many blocks has ``PACKS`` packs."""
    most = min(PACK // max(width, 1), -(-int(cells.rows.sum()) // PACKS))
    found, held = [], 0
    for n in cells.rows.tolist():
        new = not found or held + n > most
        held = n if new else held + n
        found.append((found[-1] if found else -1) + new)
    return np.array(found, np.int32)


def meetings(placed: DataFrame, cells: Cells, angle: float, run: Callable[[pa.Table, pa.Table, bool], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``run`` makes of each two blocks of ``dealt`` that meet, and of each block with itself."""
    spark = placed.sparkSession
    of = packs(cells, int(cells.width.max()) if len(cells.width) else 1)
    sent, total = spark.sparkContext.broadcast((cells, of)), int(of[-1]) + 1 if len(of) else 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (batches := list(batches)):
            return
        (cells, of), table = sent.value, pa.Table.from_batches(batches).sort_by("block")
        mine = of[table["block"].to_numpy()]
        for i in np.unique(mine):
            first, last = np.searchsorted(mine, (i, i + 1))
            met = np.unique(np.concatenate([of[cells.meetings(b, angle)] for b in np.flatnonzero(of == i)])).astype(np.int32)
            data = written(table.slice(first, last - first))
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([met], pa.list_(pa.int32())), pa.array([data], pa.binary())], names=["i", "met", "data"])

    def meet(x: pa.Table, y: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        cells = sent.value[0]
        (own, first), (others, at) = ((b.tolist(), [*f.tolist(), len(t)]) for t in (x, y) for b, f in [np.unique(t["block"].to_numpy(), return_index=True)])
        x, y = x.drop_columns(["block"]), y.drop_columns(["block"])
        for k, i in enumerate(own):
            met = set(cells.meetings(i, angle).tolist())
            one = x.slice(first[k], first[k + 1] - first[k])
            for m, j in enumerate(others):
                if j in met:
                    yield from run(one, one if i == j else y.slice(at[m], at[m + 1] - at[m]), i == j)

    places = spark.createDataFrame([(i, int(p)) for i, p in enumerate(of)], "block int, pack int")
    # of more ranges than packs each pack has its own
    dealt_out = placed.join(F.broadcast(places), "block").repartitionByRange(4 * total, "pack").drop("pack").coalesce(total)
    return product(dealt_out.mapInArrow(pack, "i int, met array<int>, data binary"), meet, schema)


def mirror_pairs(reps: DataFrame, threshold: float, block_rows: int | None = None) -> DataFrame:
    """(a, b, similarity) of ``classes``' representatives whose cosine is at least ``threshold``, above 0; a before b."""
    if threshold <= 0:
        raise ValueError("all pairs reach a threshold of 0; see similar_pairs")
    placed, cells = dealt(reps, block_rows)
    kind = reps.schema["o"].dataType.simpleString()

    def run(x: pa.Table, y: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        (v, l, ids), (w, m, others) = ((matrix(t["v"].combine_chunks(), len(t)), t["l"].to_numpy(), t["o"].combine_chunks()) for t in (x, y))
        by_position, across = np.ascontiguousarray(v.T), np.ascontiguousarray(w.T)
        for i, j in compare(v / l[:, None], w / m[:, None], threshold, same):
            # the deciding sum runs by positions, as in SQL
            total = np.zeros(len(i))
            for p, q in zip(by_position, across, strict=True):
                total += p[i] * q[j]
            total /= l[i] * m[j]
            good = total >= threshold
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(i[good])), others.take(pa.array(j[good])), pa.array(total[good])], names=["x", "y", "similarity"])

    found = meetings(placed, cells, float(np.arccos(min(threshold, 1.0))), run, f"x {kind}, y {kind}, similarity double")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def mirror_links(pages: DataFrame, threshold: float, ord_: str = "ord", vector: str = "vector") -> DataFrame:
    """(a, b, similarity): pairs of classes, by their first pages, and each copy with the first page
    of its class. No link between different vectors is lost, and links are not squared by copies."""
    reps, copies = classes(pages, ord_, vector)
    return mirror_pairs(reps, threshold).unionByName(copies.select(F.col("first").alias("a"), F.col("page").alias("b"), F.lit(1.0).alias("similarity")))
