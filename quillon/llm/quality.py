"""Quality rules by host: rule failures summed by domain, rates shrunk with an
empirical beta prior, host verdicts joined back to the documents.

Null texts and texts without words have no words (and fail the length rule); a null
source is a host of its own; repeated rows and rows without an id count as often as they
occur; an empty table gives an empty result. Columns other than those named are ignored
by ``host_rules`` and carried by ``keep_documents``. A text is read whole: a task holds a
few times the bytes of its longest one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as k
from .shared import saved

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host goes if the odds that its documents fail are surely above this many times the corpus's.
ODDS = 10
#: Standard deviations of a host's posterior from its mean to its lower bound.
SURE = 2

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
#: Smaller splits of the texts are read together.
SPLIT_ROWS = 5_000
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _within(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (owner, value), stable, and the flags of rows equal to the one before in it."""
    order = np.lexsort((value, owner))
    same = np.zeros(len(order), bool)
    same[1:] = (value[order][1:] == value[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    return order, same


def _sum(owner: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, weight, minlength=n).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The five counts of FEATURES for each text."""
    n = len(offsets) - 1
    words, hashed = k.Words(data, offsets), k.Prefix(data)
    owner = np.repeat(np.arange(n), words.counts)
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~words.space & ((data & 0xC0) != 0x80), out=sums[1:])
    chars = sums[offsets[1:]] - sums[offsets[:-1]]
    np.cumsum(_SYMBOL[data], out=sums[1:])
    symbols = sums[offsets[1:]] - sums[offsets[:-1]]

    # lines end at \n or with their text
    ends = np.union1d(np.flatnonzero(data == 10), offsets[1:])
    starts = np.concatenate(([0], ends[:-1]))
    starts = starts + ((starts < len(data)) & (data[np.minimum(starts, max(len(data) - 1, 0))] == 10) if len(data) else 0)
    # a text that starts with \n has an empty first line; a start after it is the next line's
    keep = starts < ends
    starts, ends = starts[keep], ends[keep]
    has = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[has], ends[has]
    line_owner = np.searchsorted(offsets, starts, "right") - 1
    order, same = _within(line_owner, hashed(starts, ends))
    dup_lines = _sum(line_owner[order][same], n)

    three = k.windows(hashed(words.starts, words.ends), 3)
    inside = owner[: len(three)] == owner[2:] if len(three) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    order, same = _within(owner[at], three[at])
    twice = same.copy()
    twice[:-1] |= same[1:]
    hit = at[order][twice]
    covered = np.zeros(len(owner), bool)
    for i in range(3):
        covered[hit + i] = True
    return [words.counts.astype(np.int64), chars, symbols, dup_lines, _sum(owner[covered], n)]


def _arrays(column: pa.Array) -> list[pa.Array]:
    data, offsets = k.buffers(column)
    parts = [features(d, o) for _, _, d, o in k.pieces(data, offsets)]
    return [pa.array(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64)) for i in range(len(FEATURES))]


def with_features(df: DataFrame, text: str, prefix: str = "", drop_text: bool = False) -> DataFrame:
    """``df`` and the five counts; ``prefix`` keeps their names apart from those of ``df``."""
    names = [c for c in df.columns if not (drop_text and c == text)]
    schema = df.select(*[f"`{c}`" for c in names]).schema
    for c in FEATURES:
        schema = schema.add(prefix + c, "long")
    at, kept = df.columns.index(text), [df.columns.index(c) for c in names]

    def run(batches):
        for b in batches:
            arrays = [b.column(i) for i in kept] + _arrays(b.column(at))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.mapInArrow(run, schema)


def base_failed(prefix: str = ""):
    c = lambda name: F.col(prefix + name)
    return (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"))


def host_verdicts(df: DataFrame, host: str, failed: str) -> DataFrame:
    """By host: n, failures, shrunk rate, its lower bound and ``host_ok``. The beta prior is
    fitted by moments over all hosts, weighted by their documents, from one small aggregate of
    the saved counts; no host is collected. A host goes if the lower bound of its rate (``SURE``
    deviations of its posterior) has more than ``ODDS`` times the odds of the corpus."""
    counts = df.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("long")).alias("f"))
    hosts = saved(counts, "hosts")
    nn, ff, hh, qq = hosts.agg(F.sum("n"), F.sum("f"), F.count("*"), F.sum(F.col("f").cast("double") * F.col("f") / F.col("n"))).first()
    mean = ff / nn if nn else 0.0
    spread = max(qq / nn - mean * mean - mean * (1 - mean) * hh / nn, 1e-6) if nn else 1.0
    strength = max(mean * (1 - mean) / spread - 1, 1.0)
    rate = (F.col("f") + mean * strength) / (F.col("n") + strength)
    lower = F.col("rate") - SURE * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + strength + 1))
    verdict = F.col("lower") * (1 - mean) <= ODDS * mean * (1 - F.col("lower"))
    return hosts.withColumn("rate", rate).withColumn("lower", lower).withColumn("host_ok", verdict)


def _bad_hosts(df: DataFrame, host: str, failed: str) -> DataFrame:
    return host_verdicts(df, host, failed).where(~F.col("host_ok")).select("host")


def host_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the five counts, base_failed and kept of every document."""
    found = with_features(docs.select("doc_id", "source", "text"), "text", drop_text=True).withColumn("base_failed", base_failed())
    found = saved(found, "quality", docs.count(), SPLIT_ROWS)
    bad = _bad_hosts(found, "source", "base_failed").withColumn("bad", F.lit(True))
    out = found.join(bad, F.col("source").eqNullSafe(F.col("host")), "left")
    return out.select("doc_id", *FEATURES, "base_failed", (~F.col("base_failed") & F.col("bad").isNull()).alias("kept"))


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules and their host's verdict keep. Words are
    counted once: rows are written with the rules' verdict, rejected ones without their text."""
    rows = with_features(docs, "text", prefix="q__").withColumn("q__failed", base_failed("q__"))
    rows = rows.withColumn("text", F.when(~F.col("q__failed"), F.col("text"))).select(*[f"`{c}`" for c in docs.columns], "q__failed")
    rows = saved(rows, "judged")
    bad = _bad_hosts(rows, "source", "q__failed")
    left = rows.where(~F.col("q__failed")).select(*[f"`{c}`" for c in docs.columns])
    return left.join(bad, left["source"].eqNullSafe(bad["host"]), "left_anti")


ORACLE = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (
  SELECT doc_id, sum(c - 1) AS n_dup_lines FROM (
    SELECT doc_id, line, count(*) AS c FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM words)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line) GROUP BY doc_id),
tri AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
reps AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM hits) GROUP BY doc_id),
feats AS (
  SELECT w.doc_id, w.source, len(w.w)::BIGINT AS n_words,
    length(regexp_replace(w.t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(w.t) - length(regexp_replace(w.t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(l.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM words w LEFT JOIN lines l USING (doc_id) LEFT JOIN reps r USING (doc_id)),
base AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM feats),
hosts AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM base GROUP BY source),
tot AS (SELECT sum(n) AS nn, sum(f) / sum(n) AS m, count(*) AS hh, sum(f * f / n) AS qq FROM hosts),
prior AS (SELECT m, greatest(m * (1 - m) / greatest(qq / nn - m * m - m * (1 - m) * hh / nn, 1e-6) - 1, 1.0) AS s FROM tot),
rates AS (SELECT source, m, s, n, (f + m * s) / (n + s) AS r FROM hosts, prior),
lowers AS (SELECT source, m, r - 2 * sqrt(r * (1 - r) / (n + s + 1)) AS l FROM rates),
verdict AS (SELECT source, l * (1 - m) <= 10 * m * (1 - l) AS ok FROM lowers)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND ok) AS kept
FROM base b JOIN verdict v ON b.source IS NOT DISTINCT FROM v.source
"""
