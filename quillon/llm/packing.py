"""Best-fit packing with several permitted sequence lengths.

Items go by falling size into the open bin that they fill best. For an item that fits none,
each permitted length that holds it is filled, on trial, from the items still left; the bin
opens at the length whose contents cost least a word, downsized to them. All bins are at last
downsized to the shortest permitted length that holds their contents. Openings at a fixed least
length are tried as well, and the way of least total cost wins. Groups of about ``GROUP`` items,
dealt by a hash of the item and its row's place in the written sizes, are packed apart, so work
and memory of a task stay the same at any size, however many rows are alike.

A text longer than the longest length is cut into pieces of that length and a rest. Null and
empty texts have size 0 and share bins without filling them. Ties go by id, then piece; null ids
come last; repeated rows are items of their own. Other columns are ignored. A text is read
whole to count its words; only sizes move.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import SPLIT_ROWS, with_size
from .shared import saved, sized_parts

LENGTHS = (512, 1024, 2048, 4096)
#: A bin's cost is its length and this.
OVERHEAD = 16
GROUP = 20_000


def cost(length: int) -> int:
    return length + OVERHEAD


def contents(length: int, size: int, left: dict[int, int], mask: int) -> int:
    """What a bin of ``length`` opened for ``size`` will hold if it is filled by falling size from
    the items ``left`` (counts by size; ``mask`` has their sizes as bits)."""
    rest = length - size
    while some := mask & ((1 << (rest + 1)) - 2):
        s = some.bit_length() - 1
        rest -= s * min(left[s], rest // s)
        mask &= ~(1 << s)
    return length - rest


def _fill(sizes: list[int], lengths: tuple[int, ...], opening: int | None) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, capacity and contents of each bin); sizes fall. ``opening`` None: a bin
    opens at the length of least cost a word of what it will hold; else at the shortest
    length of at least ``opening`` that holds the item."""
    bins, capacity, used = [], [], []
    by_rest: dict[int, list[int]] = {}
    mask = 0
    left = Counter(sizes)
    sizes_left = sum(1 << s for s in left)
    for s in sizes:
        left[s] -= 1
        if not left[s]:
            sizes_left &= ~(1 << s)
        fits = mask >> s
        if fits:
            rest = s + (fits & -fits).bit_length() - 1
            stack = by_rest[rest]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << rest)
        else:
            length = min(c for c in lengths if c >= max(s, opening or 0))
            if opening is None and s:
                held = [contents(c, s, left, sizes_left) for c in lengths if c >= s]
                ends = [(min(c for c in lengths if c >= u), u) for u in held]
                length = min(ends, key=lambda e: (cost(e[0]) / e[1], e[0]))[0]
            b, rest = len(capacity), length
            capacity.append(length)
            used.append(0)
        bins.append(b)
        used[b] += s
        by_rest.setdefault(rest - s, []).append(b)
        mask |= 1 << (rest - s)
    return bins, capacity, used


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, length of each bin, contents of each bin) of least total cost over all
    ways of opening; ``sizes`` fall and none is above the longest length."""
    best = None
    for opening in (None, *sorted(lengths)):
        bins, _, used = _fill(sizes, lengths, opening)
        final = [min(c for c in lengths if c >= u) for u in used]
        total = sum(map(cost, final))
        if best is None or total < best[0]:
            best = total, bins, final, used
    return best[1:]


PACKED = "doc_id long, piece int, start long, size long, bin_id string, capacity int, bin_offset int, bin_used int"


def pack_sizes(sizes: DataFrame, lengths: tuple[int, ...] = LENGTHS, group: int = GROUP) -> DataFrame:
    """``sizes`` (doc_id, size; a written table, whose rows have places) to one row for each piece:
    doc_id, piece, start (word of the text), size, bin_id, capacity, bin_offset, bin_used."""
    longest = max(lengths)
    pieces = sizes.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "size", F.explode(F.sequence(F.lit(0), F.greatest((F.col("size") - 1).cast("double") / longest, F.lit(0.0)).cast("int"))).alias("piece"))
    pieces = pieces.select("row", F.col("doc_id").cast("long").alias("doc_id"), "piece", (F.col("piece").cast("long") * longest).alias("start"), F.least(F.col("size") - F.col("piece").cast("long") * longest, F.lit(longest)).alias("size"))
    groups = sized_parts(sizes.agg(F.sum(F.greatest(F.ceil(F.col("size") / longest), F.lit(1)))).first()[0] or 0, group)
    pieces = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "size", "row"), F.lit(groups))).drop("row")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        each = table["size"].to_pylist()
        bins, length, used = pack(each, lengths)
        offsets, filled = [], [0] * len(length)
        for b, s in zip(bins, each, strict=True):
            offsets.append(filled[b])
            filled[b] += s
        g, at = table["g"][0].as_py(), np.array(bins)
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "piece": table["piece"],
                "start": table["start"],
                "size": table["size"],
                "bin_id": pa.array([f"{g}-{b}" for b in bins]),
                "capacity": pa.array(np.array(length, np.int32)[at]),
                "bin_offset": pa.array(np.array(offsets, np.int32)),
                "bin_used": pa.array(np.array(used, np.int32)[at]),
            }
        )

    return pieces.groupBy("g").applyInArrow(run, PACKED)


def pack_documents(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """Packing of the words of ``docs`` (doc_id, text)."""
    sizes = saved(with_size(docs.select("doc_id", "text")), "sizes", docs.count(), SPLIT_ROWS)
    return pack_sizes(sizes, lengths)
