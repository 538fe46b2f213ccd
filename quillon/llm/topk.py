"""Exact top-k by inner product, norm-bucketed.

Rows are sorted by length over the whole table and cut into buckets. A query starts with a
threshold: its k-th score among a small sample of the rows, which no later result can
undercut. For a query and a bucket, the score to beat, divided by the query's length and the
bucket's largest, is a local cosine threshold: above one the bucket is skipped (and all
shorter ones of the task); if it lets the query's largest coordinates decide, products over
these and a bound for the rest prune rows (coordinate pruning); else rows are taken up to the
length at which no product can pass (length pruning). What is left is verified by exact
integer products.

Queries are numbered and go out in blocks of ``BLOCK_BYTES``, one after the other, so neither
the driver nor a task holds more of them; each block meets all rows. A task keeps k rows of
each query, and a window takes the best of these.

Vectors null, empty or with null or non-finite components take no part; vectors are
compared with queries of their own dimension; a query never meets rows of its own id;
rows repeated with one id and vector are one query but each a candidate; null ids are
candidates and no queries. Ties go to the smaller id. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import running, saved, sized_parts

SCALE = 1024
K = 10
#: Bytes of the queries of a block: 130,000 of 64 dimensions.
BLOCK_BYTES = 64 << 20
#: Rows and bytes of the sample that gives queries their first thresholds.
SAMPLE = 1024
SAMPLE_BYTES = 8 << 20
BUCKET = 1024
#: Share of its coordinates that a query may look at to prune.
MOST_FOCUS = 0.75
#: Rows between two searches of a task.
ROWS = 65_536
_SAFE = float(1 << 53)
#: Stands for a null id, which loses ties.
_NULL = np.iinfo(np.int64).max


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, integer components as doubles) of the vectors that take part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & fine)
    return rows.select(F.col(id_column).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("double")).alias("v"))


def _matrices(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension, ids (null: the largest long) and components of a batch."""
    ids = batch.column(0).fill_null(_NULL).to_numpy(zero_copy_only=False)
    lists = batch.column(1)
    flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(n) - n
    return {int(d): (ids[at := np.flatnonzero(n == d)], flat[start[at][:, None] + np.arange(d)]) for d in np.unique(n)}


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products (queries, vectors) as doubles or, if large, 64-bit integers."""
    if q.size and v.size and float(np.abs(q).max()) * float(np.abs(v).max()) * q.shape[1] >= _SAFE:
        return q.astype(np.int64) @ v.T.astype(np.int64)
    return q @ v.T


def floors(ids: np.ndarray, q: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """By query its k-th score among the sample's rows of other ids; -inf where there are fewer."""
    out = np.full(len(ids), -np.inf)
    for a in range(0, len(ids) if len(sample_ids) >= k else 0, 512):
        score = products(q[a : a + 512], sample).astype(np.float64)
        score[ids[a : a + 512, None] == sample_ids[None, :]] = -np.inf
        out[a : a + 512] = np.partition(score, len(sample_ids) - k, axis=1)[:, len(sample_ids) - k]
    return out


class Search:
    """Best k of each query of one dimension, over the vectors shown so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, least: np.ndarray | None = None):
        self.ids, self.q, self.k = ids, q, k
        self.norms = np.sqrt((q * q).sum(axis=1))
        self.score: list[np.ndarray] = [np.zeros(0, np.int64)] * len(ids)
        self.found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(ids)
        self.least = np.full(len(ids), -np.inf) if least is None else least.copy()
        self.order = np.argsort(-np.abs(q), axis=1, kind="stable")
        energy = np.cumsum(np.take_along_axis(q * q, self.order, axis=1), axis=1)
        self.rest = np.sqrt(np.maximum(energy[:, -1:] - energy, 0)) / np.maximum(self.norms, 1e-300)[:, None]
        #: Pairs of queries and rows whose bucket was skipped, that were pruned, and that were multiplied.
        self.skipped = self.pruned = self.verified = 0

    def _take(self, i: int, ids: np.ndarray, score: np.ndarray) -> None:
        keep = (score >= self.least[i]) & (ids != self.ids[i])
        if not keep.any():
            return
        ids, score = np.concatenate((self.found[i], ids[keep])), np.concatenate((self.score[i], score[keep].astype(np.int64)))
        best = np.lexsort((ids, -score))[: self.k]
        self.found[i], self.score[i] = ids[best], score[best]
        if len(best) == self.k:
            self.least[i] = max(self.least[i], float(score[best[-1]]))

    def show(self, ids: np.ndarray, v: np.ndarray) -> None:
        norms = np.sqrt((v * v).sum(axis=1))
        order = np.argsort(-norms, kind="stable")
        ids, v, norms = ids[order], v[order], norms[order]
        alive = np.arange(len(self.ids))
        for a in range(0, len(ids), BUCKET):
            bi, bv, bn = ids[a : a + BUCKET], v[a : a + BUCKET], norms[a : a + BUCKET]
            with np.errstate(divide="ignore", invalid="ignore"):
                local = self.least[alive] / (self.norms[alive] * bn[0])
            # a little slack for the rounding of lengths; products are verified exactly
            going = ~(local > 1 + 1e-9)
            self.skipped += int((~going).sum()) * (len(ids) - a)
            alive, local = alive[going], local[going]
            if not len(alive):
                break
            # coordinates that leave a rest of the query too short to pass by itself
            focus = (self.rest[alive] > np.maximum(local, 0)[:, None]).sum(axis=1) + 1
            few = (local > 0) & (focus <= MOST_FOCUS * self.q.shape[1])
            squares = bv * bv if few.any() else None
            for i, m in zip(alive[few].tolist(), focus[few].tolist(), strict=True):
                self._coordinates(i, m, bi, bv, squares, bn)
            self._lengths(alive[~few], bi, bv, bn)

    def _lengths(self, some: np.ndarray, ids: np.ndarray, v: np.ndarray, norms: np.ndarray) -> None:
        """Rows as long as the least hopeful of some queries needs."""
        for b in range(0, len(some), 512):
            at = some[b : b + 512]
            with np.errstate(divide="ignore", invalid="ignore"):
                need = float(np.nan_to_num(self.least[at] / self.norms[at], nan=-np.inf, posinf=np.inf, neginf=-np.inf).min())
            n = int(np.searchsorted(-norms, -need * (1 - 1e-9), "right")) if need > 0 else len(ids)
            self.pruned += len(at) * (len(ids) - n)
            score = products(self.q[at], v[:n])
            self.verified += score.size
            for row in np.flatnonzero((score >= self.least[at][:, None]).any(axis=1)).tolist():
                self._take(int(at[row]), ids[:n], score[row])

    def _coordinates(self, i: int, m: int, ids: np.ndarray, v: np.ndarray, squares: np.ndarray, norms: np.ndarray) -> None:
        """A product is at most that of the query's ``m`` largest coordinates and the lengths of
        what is left of both vectors, multiplied."""
        f = self.order[i, :m]
        part = v[:, f] @ self.q[i, f]
        left = np.sqrt(np.maximum(norms * norms - squares[:, f].sum(axis=1), 0))
        bound = part + self.rest[i, m - 1] * self.norms[i] * left
        slack = 1e-9 * self.norms[i] * norms
        at = np.flatnonzero(bound + slack >= self.least[i])
        self.pruned += len(ids) - len(at)
        self.verified += len(at)
        if len(at):
            self._take(i, ids[at], products(self.q[i : i + 1], v[at])[0])


def _grouped(rows: list) -> dict[int, tuple[np.ndarray, ...]]:
    """(id, v, ...) rows as arrays, by dimension."""
    grouped = defaultdict(list)
    for r in rows:
        grouped[len(r[1])].append(r)
    return {d: (np.array([r[0] if r[0] is not None else _NULL for r in some], np.int64), np.array([r[1] for r in some], np.float64), *(np.array(c, np.float64) for c in zip(*(r[2:] for r in some), strict=True))) for d, some in grouped.items()}


def _with_floors(queries: DataFrame, sample: list, k: int) -> DataFrame:
    """``queries`` (id, v) with ``least``, their first threshold."""
    sent = queries.sparkSession.sparkContext.broadcast(_grouped(sample))

    def run(batches):
        for b in batches:
            for d, (ids, q) in _matrices(b).items():
                if d in sent.value:
                    least = floors(ids, q, *sent.value[d], k)
                else:
                    least = np.full(len(ids), -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(np.arange(0, len(ids) * d + 1, d, dtype=np.int32), q.ravel()), pa.array(least)], names=["id", "v", "least"])

    return queries.mapInArrow(run, "id long, v array<double>, least double")


def _one_block(rows: DataFrame, queries: list, k: int) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(_grouped(queries))

    def run(batches):
        searches = {d: Search(i, q, k, least) for d, (i, q, least) in sent.value.items()}
        held, n = defaultdict(list), 0

        def flush():
            for d, parts in held.items():
                if d in searches:
                    searches[d].show(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            held.clear()

        for b in batches:
            for d, part in _matrices(b).items():
                held[d].append(part)
            if (n := n + b.num_rows) >= ROWS:
                flush()
                n = 0
        flush()
        for s in searches.values():
            if len(s.ids):
                counts = np.array([len(x) for x in s.found])
                found = np.concatenate(s.found)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(s.ids, counts)), pa.array(found, mask=found == _NULL), pa.array(np.concatenate(s.score))], names=["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query, k: int = K, id_column: str = "vec_id", vector: str = "embedding", block_bytes: int = BLOCK_BYTES, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of each query. ``is_query`` is a
    condition on ``id``. Blocks of queries are searched in turn; with more than one, what each
    finds is kept in the shared folder."""
    usable_rows = usable(vectors, id_column, vector)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n, widest = usable_rows.agg(F.count("*"), F.max(F.size("v"))).first()
    # sorted by length over the whole table; the id and a salt part rows of one length
    order = [F.desc("norm"), F.asc("id"), F.xxhash64(F.monotonically_increasing_id())]
    rows = saved(usable_rows.withColumn("norm", length).repartitionByRange(sized_parts(n, ROWS), *order).sortWithinPartitions(F.desc("norm")), "vectors")
    spark = vectors.sparkSession
    out = spark.createDataFrame([], "query_id long, vec_id long, score long")
    take = max(1, min(sample, SAMPLE_BYTES // (8 * (widest or 1))))
    first = rows.select("id", "v").where(F.rand(7) * n < 2 * take).limit(take).collect()
    queries = rows.where(F.col("id").isNotNull() & is_query).select("id", "v").distinct()
    queries = _with_floors(queries, first, k).withColumn("bytes", F.size("v").cast("long") * 8 + 64)
    queries, total = running(queries, ["id", F.xxhash64("v")], "bytes", 1 + n // ROWS, "row", "before")
    blocks = -(-total // block_bytes)
    for i in range(blocks):
        some = queries.where(F.floor(F.col("before") / block_bytes) == i).select("id", "v", "least").collect()
        if some:
            found = _one_block(rows, some, k)
            out = out.unionByName(found if blocks == 1 else saved(found, "found"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 10
"""
