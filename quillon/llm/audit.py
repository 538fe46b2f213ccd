"""Filter interactions as a product of incidence matrices.

Five filters give each document a mask of those that it fails. The masks of a part (a source) are
counted in a histogram of 32 cells, once for all documents, once for those labelled good, once
for the toxic ones. The three rows of each part, stacked, are multiplied by integer matrices of
32 rows and 600 columns (120 orders of five filters, five steps), which say of each mask whether a
document that has it is kept after a step, removed by it, redundant there, or fails its filter
alone. So the audit of all orders reads each document once, and its products are as many as
there are parts.

Identity with a smaller id's text is told by SHA-256. Only the smallest id of each text is sought,
by an aggregate, and met again by (id, text), so a text or an id with very many rows is no
hot key: rows are counted by id, text, part and mask before they are joined.

Null texts are empty and null sources are the part '', as empty ones are. A row without an id
repeats no text, is repeated by none and has no label. Rows that repeat id and text do not repeat
each other. A label holds if any row of ``labels`` for the id says so. No documents, no
parts. Other columns are ignored. A task holds a run of texts of about ``k.CHUNK`` bytes, a longer
text alone.
"""

from __future__ import annotations

import hashlib
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as k
from .shared import saved

FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_CAPITAL_PERCENT = 5
SYMBOLS = b"#$%&*|"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(ORDERS) * len(FILTERS)
MASKS = 1 << len(FILTERS)

_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def masks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """By text the bits of A to D that it fails."""
    words, n = k.Words(data, offsets), len(offsets) - 1
    owner = np.repeat(np.arange(n), words.counts)
    order = np.lexsort((hashes := k.Prefix(data)(words.starts, words.ends), owner))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
    distinct = np.bincount(owner[order[new]], minlength=n)
    inside = lambda marks: np.diff(np.concatenate(([0], np.cumsum(marks)))[offsets])
    points, capitals = inside((data & 0xC0) != 0x80), inside((data >= 65) & (data <= 90))
    fails = [words.counts < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * words.counts, 100 * capitals > MAX_CAPITAL_PERCENT * points, inside(_SYMBOL[data]) > 0]
    return sum((f.astype(np.int8) << i for i, f in enumerate(fails)), np.zeros(n, np.int8))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest and mask (A to D) of every document."""

    def run(batches):
        for b in batches:
            data, offsets = k.buffers(b.column(2))
            for lo, hi, d, o in k.pieces(data, offsets):
                raw, ends = d.tobytes(), o.tolist()
                digests = [hashlib.sha256(raw[a:z]).digest() for a, z in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in (0, 1)), pa.array(digests, pa.binary()), pa.array(masks(d, o))], names=["doc_id", "part", "digest", "mask"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")
    return rows.mapInArrow(run, "doc_id long, part string, digest binary, mask byte")


def histograms(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by the filters that they fail."""
    rows = saved(judged(docs), "judged")
    cells = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    firsts = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    repeats = F.col("doc_id").isNotNull() & F.col("first").isNull()
    cells = cells.join(firsts, ["doc_id", "digest"], "left").withColumn("mask", F.col("mask") + F.when(repeats, 1 << FILTERS.index("E")).otherwise(0))
    # an id has at most as many rows as there are parts and masks
    cells = cells.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good__"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic__"))
    cells = cells.join(marks, "doc_id", "left")
    of = lambda mark: F.sum(F.when(F.col(mark) == 1, F.col("n")).otherwise(0))
    return cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good__").alias("good"), of("toxic__").alias("toxic"))


@cache
def matrices() -> dict[str, np.ndarray]:
    """Matrices of ``MASKS`` rows and ``STEPS`` columns, by outcome."""
    mask = np.arange(MASKS)[:, None]
    bits = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    own = 1 << bits.ravel()
    earlier = np.concatenate((np.zeros((len(ORDERS), 1), np.int64), np.cumsum(1 << bits, axis=1)[:, :-1]), axis=1).ravel()
    fails, before = mask & own > 0, mask & earlier > 0
    found = {"kept": ~fails & ~before, "removed": fails & ~before, "redundant": fails & before, "unique_fails": mask == own}
    found = {c: m.astype(np.int64) for c, m in found.items()}
    # removals by a filter over all orders, whatever the step
    found["shapley"] = found["removed"] @ (own[:, None] == own[None, :]).astype(np.int64)
    return found


OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The outcomes of each step of each order, by part, of ``docs`` (doc_id, source, text) with ``labels``
    (doc_id, quality, toxic). The histogram of a part has 32 cells."""
    cells = histograms(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    orders, steps = pa.array(np.repeat(ORDERS, len(FILTERS)).tolist()), pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS)))

    def run(batches):
        times = matrices()
        for b in batches:
            stack = np.zeros((b.num_rows, 3, MASKS), np.int64)
            for i, some in enumerate(b.column(1).to_pylist()):
                for c in some:
                    stack[i, :, c["mask"]] = c["n"], c["good"], c["toxic"]
            for part, (n, good, toxic) in zip(b.column(0).to_pylist(), stack, strict=True):
                outcomes = [n @ times[c] for c in ("kept", "removed", "redundant", "unique_fails")] + [good @ times["removed"], toxic @ times["removed"], n @ times["shapley"]]
                yield pa.RecordBatch.from_arrays([pa.array([part] * STEPS), orders, steps, *map(pa.array, outcomes)], names=[c.split()[0] for c in OUT.split(", ")])

    return cells.mapInArrow(run, OUT)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
m AS (
  SELECT part, doc_id, (len(w) < 50) AS a, (100 * len(list_distinct(w)) < 65 * len(w)) AS b,
    (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t)) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > least, false) AS e FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
x AS (
  SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(range(1, 6)) AS f),
orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT o, list_aggregate(list_transform(o, lambda i: substr('ABCDE', i, 1)), 'string_agg', '') AS filter_order, unnest(range(1, 6)) AS step FROM orders),
y AS (
  SELECT part, filter_order, step, o[step] AS f, n, good, toxic, fails[o[step]] AS own, coalesce(list_bool_or(list_transform(o[:step - 1], lambda i: fails[i])), false) AS before,
    list_sum(list_transform(fails, lambda v: v::INT)) AS fails_n
  FROM x, steps),
z AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (NOT own AND NOT before), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (own AND NOT before), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (own AND before), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (own AND fails_n = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (own AND NOT before), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (own AND NOT before), 0)::BIGINT AS toxic_lost
  FROM y GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM z
"""
