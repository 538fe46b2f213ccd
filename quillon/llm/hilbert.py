"""Sharding along a Hilbert curve over quantised metadata.

Each dimension (source, language, size) is cut at approximate quantiles into ``2**bits``
levels, so the curve follows the data. Rows are sorted by (curve index, group, id) and cut into
runs of equal counts, so a shard covers a compact box of every dimension and files can be
pruned by any of them: ``sharded`` writes the files, ``manifest`` has the box of each, and
``matching`` names those that a filter must read. Rows of equal text form a group: it takes
the place of its smallest id, its rows follow each other, and only a cut can part them. Texts
count as equal if their sizes and two 64-bit hashes agree.

Strings are quantised by the rank of their whole value, so common prefixes do not matter.
Null texts are empty, null metadata take level 0, null ids come first; repeated rows
each get a slot; an empty table gives an empty result. Other columns are carried along by
``sharded`` under their own names, but for ``shard__`` and ``slot__``, which it sets. ``digest``
sorts keys of a few bytes, never texts, however long; ``sharded`` sorts rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SEND, ranked, saved, sent, sized_parts

BITS = 4

def curve(points: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of integer points (n, dims), by Skilling's transform."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | (x[i] >> b & 1)
    return out


def with_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the rank of its strings in ``column`` (not null) among the distinct ones, by
    code point over their whole length."""
    values, _ = ranked(df.select(column).distinct(), [column], name)
    size = values.agg(F.sum(F.octet_length(column) + 16)).first()[0] or 0
    # kept by itself, so that the join can part a value of many rows
    return df.join(F.broadcast(values) if size <= SEND else saved(values, "ranks"), column)


def with_curve(df: DataFrame, dims: dict[str, Column], bits: int = BITS, name: str = "curve") -> DataFrame:
    """``df`` with its curve index. One aggregate finds the cuts; the table from cells to
    indices has ``2**(bits * dims)`` rows, whatever the data."""
    cuts = df.agg(*[F.percentile_approx(c, F.array(*[F.lit(i / 2**bits) for i in range(1, 2**bits)]), 2000).alias(d) for d, c in dims.items()]).first()
    cell = F.lit(0)
    for d, c in dims.items():
        level = sum((F.when(c > F.lit(cut), 1).otherwise(0) for cut in sorted(set(cuts[d] or []))), F.lit(0))
        cell = cell * 2**bits + level
    grid = np.indices([2**bits] * len(dims)).reshape(len(dims), -1).T
    table = df.sparkSession.createDataFrame([(i, int(h)) for i, h in enumerate(curve(grid, bits))], f"cell__ int, {name} int")
    return df.withColumn("cell__", cell.cast("int")).join(F.broadcast(table), "cell__").drop("cell__")


def slots(keys: DataFrame, order: list[str], shards: int) -> DataFrame:
    """``keys`` sorted by ``order`` and cut into ``shards`` runs whose counts differ by one
    at most: columns ``shard`` and ``slot`` (from 0 without gaps)."""
    placed, total = ranked(keys, order, "rank__")
    shard = F.expr(f"CAST((rank__ * {shards}) DIV {max(total, 1)} AS INT)")
    # the first rank r with r * shards DIV total = shard is shard * total / shards, rounded up
    first = F.expr(f"(CAST(shard AS BIGINT) * {total} + {shards - 1}) DIV {shards}")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("rank__") - first).drop("rank__")


def size_of(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def placed(docs: DataFrame, shards: int, carry: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, ``carry``, shard and slot of every document."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        size_of("text").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("group__"),
        F.xxhash64(F.lit(1), text).alias("group2__"),
        F.coalesce("source", F.lit("")).alias("source__"),
        F.coalesce("lang", F.lit("")).alias("lang__"),
        *carry,
    )
    rows = with_rank(with_rank(rows, "source__", "source_rank__"), "lang__", "lang_rank__")
    rows = with_curve(rows, {"source": F.col("source_rank__"), "lang": F.col("lang_rank__"), "size": F.col("size")})
    if not carry:
        # texts are hashed once; the quantiles have read their sizes before
        rows = saved(rows, "keys", docs.count())
    # a group's place; groups of one are most and keep their own. Saved, so that its size is known
    # and the join can part a group of many rows
    group = ["size", "group__", "group2__"]
    lead = rows.groupBy(*group).agg(F.min(F.struct("doc_id", "curve")).alias("lead__"), F.count("*").alias("n__")).where("n__ > 1")
    lead = saved(lead.select(*group, F.col("lead__.curve").alias("lead__")), "leads", docs.count())
    rows = rows.join(sent(lead, 32), group, "left").withColumn("curve", F.coalesce("lead__", "curve")).drop("lead__", "source__", "lang__", "source_rank__", "lang_rank__")
    return slots(rows, ["curve", "group__", "group2__", "doc_id"], shards)


def digest(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document, by rows
    of equal counts. Only keys of a few bytes are grouped, sorted and joined, never texts."""
    out = placed(docs, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")).coalesce(sized_parts(docs.count(), 50_000))


def sharded(docs: DataFrame, path: str, shards: int = 24) -> None:
    """Write ``docs`` to folder ``path`` as Parquet, a folder shard__=N for each shard, rows in the
    order of ``slot__``."""
    names = [c for c in docs.columns if c not in ("shard__", "slot__")]
    out = placed(docs, shards, (F.struct(*[F.col(f"`{c}`") for c in names]).alias("row__"),))
    out.select("row__.*", F.col("shard").alias("shard__"), F.col("slot").alias("slot__")).write.partitionBy("shard__").parquet(path)


def manifest(files: DataFrame) -> DataFrame:
    """By shard of what ``sharded`` wrote: rows, the least and largest source and language (null
    as empty), and sizes."""
    ends = [f(c).alias(f"{n}_{c.removesuffix('__')}") for c in ("source__", "lang__", "size__") for n, f in (("min", F.min), ("max", F.max))]
    rows = files.select("shard__", F.coalesce("source", F.lit("")).alias("source__"), F.coalesce("lang", F.lit("")).alias("lang__"), size_of("text").alias("size__"))
    return rows.groupBy("shard__").agg(F.count("*").alias("rows"), *ends)


def matching(boxes: DataFrame, source: str | None = None, lang: str | None = None, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Shards of a manifest that may hold rows of a source, a language, a range of sizes."""
    out = boxes
    for name, value in (("source", source), ("lang", lang)):
        if value is not None:
            out = out.where((F.col(f"min_{name}") <= value) & (F.col(f"max_{name}") >= value))
    if sizes is not None:
        out = out.where((F.col("min_size") <= sizes[1]) & (F.col("max_size") >= sizes[0]))
    return out.select("shard__")
