"""Spelling variants by wildcard groups, without pairs.

Words come from maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lowered. A word stands in one
group for each of its positions: that of all words with the same prefix and suffix around it. A
group keeps its size and its two best words, which is all that a member needs to know of the
others (they are its replacements). Deletions of a word join the vocabulary: a deletion that is
a word links the two, seen from both ends. No group has more members than the alphabet has
letters, and no pair is written anywhere.

Words are known by their rank (falling count, then code point), so groups, links and roots are
of integers, and the best of several words is the smallest rank. Prefixes and suffixes are held
as two 64-bit polynomial hashes from prefix sums, so a word of any length takes work and memory
linear in it; groups are as right as those 128 bits. A form has several times its word's count,
so paths of forms double in a few joins, as many as the largest count allows.

Null and empty texts have no words. A null id is an empty string in the hash that picks runs to
be garbled. Repeated rows count each. Other columns are ignored. A task holds a run of texts of
about ``PIECE`` bytes, a longer text alone.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as k
from .shared import discard, ranked, saved

MIN_LETTERS = 6
MIN_COUNT = 5
#: A form has at least so many times the count of its word.
RATIO = 5
#: One run in so many loses a letter.
GARBLE = 199
PIECE = 4 << 20
#: Longer runs are hashed one by one.
LONG = 96
#: Rows of groups in one batch.
ROWS = 1 << 20

_LATIN = np.zeros(256, bool)
_LATIN[[*range(65, 91), *range(97, 123), 0xC3]] = True
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)
#: Values of the letters in the two hashes; positions and lengths of wildcards.
_VALUES = [k.mix(np.arange(s, s + 256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for s in (1_000, 2_000)]
_PLACE, _LENGTH = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, letters) of the maximal runs; in UTF-8, U+00C0 to U+00FF are the pairs that begin with C3."""
    inside = _LATIN[data]
    inside[1:] |= data[:-1] == 0xC3
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = ~inside[:-1], ~inside[1:]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    letters = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return starts, ends, letters[ends] - letters[starts]


def crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """crc32 of each byte range, going on from ``seeds``, all ranges side by side."""
    length = ends - starts
    out = np.zeros(len(starts), np.uint32)
    for i in np.flatnonzero(length > LONG).tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(seeds[i]))
    order = np.flatnonzero(length <= LONG)
    order = order[np.argsort(-length[order], kind="stable")]
    state, at, falling = ~seeds[order], starts[order], -length[order]
    for p in range(int(-falling[0]) if len(order) else 0):
        live = int(np.searchsorted(falling, -p, "left"))
        some = state[:live]
        state[:live] = _CRC[(some ^ data[at[:live] + p]) & 0xFF] ^ (some >> 8)
    out[order] = ~state
    return out


def _counted(ids: list, column: pa.Array, min_letters: int, garble: int) -> list[tuple[list[bytes], list[int]]]:
    """Words and counts of the texts of a column, in runs of texts."""
    data, offsets = k.buffers(column)
    out = []
    for lo, _, d, o in k.pieces(data, offsets, PIECE):
        d = k.lower(d)
        starts, ends, letters = runs(d, o)
        # a shorter run is no word, garbled or not
        long = letters >= min_letters
        starts, ends, letters = starts[long], ends[long], letters[long]
        raw, words, counts = d.tobytes(), [], []
        if garble:
            seeds = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids[lo : lo + len(o) - 1]], np.uint32)
            h = crcs(d, starts, ends, seeds[np.searchsorted(o, starts, "right") - 1])
            hit = h % garble == 0
            for a, b, x in zip(starts[hit].tolist(), ends[hit].tolist(), h[hit].tolist(), strict=True):
                run = raw[a:b].decode()
                i = x % len(run)
                if len(run) > min_letters:
                    words.append((run[:i] + run[i + 1 :]).encode())
                    counts.append(1)
            starts, ends = starts[~hit], ends[~hit]
        _, first, n = np.unique(k.Prefix(d)(starts, ends), return_index=True, return_counts=True)
        words += [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        out.append((words, counts + n.tolist()))
    return out


def vocabulary(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, garble: int = GARBLE, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: runs of at least ``min_letters`` letters that occur ``min_count`` times in all texts. A run
    of a document loses a letter if ``garble`` divides its hash (0: none does). Counts are added
    up in each run of texts and before the shuffle, so a frequent word is no hot key."""

    def run(batches):
        for b in batches:
            for words, n in _counted(b.column(0).to_pylist(), b.column(1), min_letters, garble):
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    found = docs.select(id_column, text).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def memberships(column: pa.Array, ranks: np.ndarray):
    """Rows (a, b, kind, rank) of a batch of words: kind 0 for a wildcard group, 1 for the word
    itself, 2 for a string that it becomes by one deletion. Yields arrays of at most ``ROWS`` rows
    but for a longer word."""
    data, offsets = k.buffers(column)
    for lo, hi, d, o in k.pieces(data, offsets, ROWS // 2):
        own = ranks[lo:hi]
        head = np.flatnonzero((d & 0xC0) != 0x80)
        letter = d[head].astype(np.int64)
        wide = letter == 0xC3
        letter[wide] = 0xC0 + (d[head[wide] + 1] & 0x3F)
        first = np.searchsorted(head, o)
        size = np.diff(first)
        word = np.repeat(np.arange(hi - lo), size)
        begin, place = first[word], np.arange(len(letter)) - first[word]
        up, down = k.powers(len(letter) + 1)
        # of equal neighbours only the first is taken out
        same = np.zeros(len(letter), bool)
        same[1:] = (letter[1:] == letter[:-1]) & (place[1:] > 0)
        keys = []
        for values in _VALUES:
            step = values[letter] * up[: len(letter)]
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(step, dtype=np.uint64)))
            whole = (sums[first[1:]] - sums[first[:-1]]) * down[first[:-1]]
            hole = whole[word] - step * down[begin]
            wild = k.mix(hole + place.astype(np.uint64) * _PLACE + (size[word] + 1).astype(np.uint64) * _LENGTH)
            gone = (sums[:-1] - sums[begin]) * down[begin] + (sums[first[word + 1]] - sums[1:]) * down[begin + 1]
            keys.append(np.concatenate((wild, k.mix(whole), k.mix(gone[~same]))).view(np.int64))
        kind = np.repeat(np.array([0, 1, 2], np.int8), [len(letter), hi - lo, int((~same).sum())])
        yield *keys, kind, np.concatenate((own[word], own, own[word[~same]]))


def _near(words: DataFrame) -> DataFrame:
    """rank, n_near, best: how many words are one edit away, and the smallest rank among them."""

    def run(batches):
        for b in batches:
            for arrays in memberships(b.column(1), b.column(0).to_numpy()):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["a", "b", "kind", "rank"])

    rows = words.select("rank", "word").mapInArrow(run, "a long, b long, kind byte, rank long")
    group = Window.partitionBy("a", "b").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kind, rank = F.col("kind"), F.col("rank")
    # of a wildcard group: its size and its two best words; of a string: the word that it is,
    # and the number and the best of those that become it
    seen = {"size": F.count("*"), "top": F.nth_value("rank", 1), "next": F.nth_value("rank", 2), "self": F.max(F.when(kind == 1, rank)), "longer": F.count(F.when(kind == 2, 1)), "longest": F.min(F.when(kind == 2, rank))}
    rows = rows.withColumns({c: x.over(group) for c, x in seen.items()}).where("size > 1")
    near = F.when(kind == 0, F.col("size") - 1).when(kind == 1, F.col("longer")).otherwise(F.col("self").isNotNull().cast("long"))
    best = F.when(kind == 0, F.when(F.col("top") == rank, F.col("next")).otherwise(F.col("top"))).when(kind == 1, F.col("longest")).otherwise(F.col("self"))
    return rows.select("rank", near.alias("n_near"), best.alias("best")).where("n_near > 0").groupBy("rank").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame, longest: int) -> tuple[DataFrame, list[DataFrame]]:
    """(rank, root) of the words of ``forms`` (rank, form), and the tables written on the way; no
    path has more than ``longest`` forms."""
    roots = forms.select("rank", F.col("form").alias("root"))
    tables = []
    for _ in range(max(longest, 1).bit_length()):
        ahead = roots.select(F.col("rank").alias("root"), F.col("root").alias("ahead"))
        roots = saved(roots.join(ahead, "root", "left").select("rank", F.coalesce("ahead", "root").alias("root")), "roots")
        tables.append(roots)
    return roots, tables


def variants(vocab: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of ``vocab`` (word, n; words are distinct): the near word of largest
    count (ties: the smallest) if it has ``ratio`` times the word's count, and the last word on the path of forms."""
    if ratio < 2:
        raise ValueError("a form must have at least twice its word's count")
    words, total = ranked(vocab, [F.col("n").desc(), F.col("word")])
    if not total:
        return words.select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"))
    counts = words.select(F.col("rank").alias("best"), F.col("n").alias("best_n"))
    near = words.select("rank", "n").join(_near(words), "rank").join(counts, "best", "left")
    near = saved(near.select("rank", "n_near", F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best")).alias("form")), "near")
    # counts grow by the ratio on each step of a path
    roots, tables = _roots(near.where("form IS NOT NULL").select("rank", "form"), math.ceil(math.log(words.agg(F.max("n")).first()[0] + 1, ratio)))
    discard(*tables[:-1])
    form = words.select(F.col("rank").alias("form_"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    root = words.select(F.col("rank").alias("root_"), F.col("word").alias("root"))
    linked = near.withColumnRenamed("form", "form_").join(form, "form_", "left")
    linked = linked.join(roots.withColumnRenamed("root", "root_").join(root, "root_").select("rank", "root"), "rank", "left")
    out = words.join(linked, "rank", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, ratio: int = RATIO, garble: int = GARBLE) -> DataFrame:
    """Variants of the words of ``docs`` (doc_id, text)."""
    return variants(saved(vocabulary(docs, min_letters, min_count, garble), "words"), ratio)


ORACLE = r"""
WITH RECURSIVE bits AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
runs AS (
  SELECT doc_id, run, count(*) AS c FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (SELECT doc_id, run, c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
hashed AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
    lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295) AS h
  FROM bytes, bits),
words AS (
  SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, c FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
wild AS (SELECT word, n, i, substr(word, 1, i - 1) AS p, substr(word, i + 1) AS s FROM places),
cuts AS (SELECT DISTINCT word, n, p || s AS v FROM wild),
pairs AS (
  SELECT a.word, b.word AS w, b.n AS m FROM wild a JOIN wild b ON a.i = b.i AND a.p = b.p AND a.s = b.s AND a.word <> b.word
  UNION ALL SELECT c.word, v.word, v.n FROM cuts c JOIN words v ON c.v = v.word
  UNION ALL SELECT v.word, c.word, c.n FROM cuts c JOIN words v ON c.v = v.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(w, (-m, w)) AS w FROM pairs GROUP BY word),
forms AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN w END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n
  FROM words LEFT JOIN best USING (word)),
paths AS (
  SELECT word, word AS at FROM forms UNION ALL SELECT p.word, f.form FROM paths p JOIN forms f ON p.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, p.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN paths p ON p.word = f.word JOIN forms e ON e.word = p.at AND e.form IS NULL
"""
