"""Chunking, as expressions that yield arrays of (text, chunk_index, token_count, char_start,
char_end); ``exploded`` makes rows of them. Windows are over words joined by blanks: a text of
at most a window's words is one chunk, the last sliding window is moved back to end with the
text, the last overlapping one is short."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.config import DEFAULT
from quillon.functions.text import word_count, words

#: Characters of a block of text in which a piece's place is sought.
BLOCK = 8192


def _window(w: Column, start: Column, size: int) -> Column:
    return F.array_join(F.slice(w, start + 1, size), " ")


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is made once, not anew wherever ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _with_words(text: Column, make) -> Column:
    return _bound(words(text), lambda w: F.when(F.size(w) > 0, make(w)))


def sliding(text: Column, size: int = DEFAULT.window_words, step: int = DEFAULT.window_step) -> Column:
    def make(w: Column) -> Column:
        last = F.greatest(F.size(w) - size, F.lit(0))
        starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(step)), F.array(last)))
        return F.transform(starts, lambda i: _window(w, i, size))

    return F.coalesce(_with_words(text, make), F.array().cast("array<string>"))


def overlapping(text: Column, size: int = DEFAULT.window_words, overlap: int = DEFAULT.window_overlap) -> Column:
    """Windows that share ``overlap`` words, up to the one that reaches the end."""
    step = max(1, size - overlap)

    def make(w: Column) -> Column:
        count = F.greatest(F.ceil((F.size(w) - size) / step), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), count), lambda i: _window(w, i * step, size))

    return F.coalesce(_with_words(text, make), F.array().cast("array<string>"))


def by_pattern(text: Column, patterns: str = r"\n\n") -> Column:
    """Split by each of the comma-separated patterns in turn; blank patterns count for nothing."""
    used = [p.strip() for p in patterns.split(",") if p.strip()] or [r"\n\n"]
    parts = F.array(text)
    for p in used:
        parts = F.flatten(F.transform(parts, _splitter(p)))
    return parts


def _splitter(pattern: str):
    return lambda t: F.split(t, pattern)


def legacy(text: Column, size: int = 512, overlap: int = 50) -> Column:
    """Windows of words by the older rule, with their exact places in the joined words. Places are running
    sums over the steps, so each word is measured once and not again for every window behind it."""
    step = max(1, size - overlap)

    def make(w: Column) -> Column:
        n = F.size(w)
        windows = F.sequence(F.lit(0), F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int"))
        lengths = F.transform(windows, lambda i: F.length(_window(w, i * step, step)))
        before = F.aggregate(lengths, F.array(F.lit(-1)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x + 1)))

        def one(i: Column, t: Column, start: Column) -> Column:
            return F.struct(t.alias("text"), i.alias("chunk_index"), F.least(n - i * step, F.lit(size)).alias("token_count"), start.alias("char_start"), (start + F.length(t)).alias("char_end"))

        placed = _bound(before, lambda p: F.transform(windows, lambda i: _bound(_window(w, i * step, size), lambda t: one(i, t, F.greatest(F.element_at(p, i + 1), F.lit(0))))))
        return F.filter(placed, lambda _: n > 0)

    return _bound(words(text), make)


def located(text: Column, pieces: Column) -> Column:
    """Pieces with index, word count and place: each is sought from just behind the start of the
    one before; one not found stands at that place. Blank pieces go, indices keep their gaps.

    A piece is sought in the blocks of the text that follow its place, and beyond these only if it
    may be there: words joined by single blanks are in no text whose runs of such words are all
    shorter. So the work is linear where pieces are near or runs short; it is the text's length
    for each piece that is in no near block although the text has runs as long."""
    indexed = F.transform(pieces, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    full = F.filter(indexed, lambda x: F.trim(F.regexp_replace(x["t"], r"\s+", " ")) != "")
    blocks = F.when(F.length(text) > BLOCK, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))).otherwise(F.array(text))
    runs = F.when(F.length(text) > 2 * BLOCK, F.array_max(F.transform(F.split(text, r"\s\s+|[^\S ]"), lambda r: F.length(r)))).otherwise(0)

    def place(k: Column, t: Column, at: Column) -> Column:
        first, ahead = F.floor(at / BLOCK).cast("int"), at % BLOCK
        many = F.floor((ahead + F.length(t)) / BLOCK).cast("int") + 2
        near = F.call_function("locate", t, F.array_join(F.slice(k["blocks"], first + 1, many), ""), ahead + 1)
        nowhere = (first + many >= F.size(k["blocks"])) | ((F.length(t) > k["runs"]) & ~t.rlike(r"^\s|\s$|\s\s|[^\S ]"))
        far = F.when(nowhere, 0).otherwise(F.call_function("locate", t, k["text"], at + 1))
        found = _bound(near, lambda n: F.when(n > 0, first * BLOCK + n).otherwise(far))
        return _bound(found, lambda n: F.when(n > 0, n - 1).otherwise(at))

    def located_in(k: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("places"), F.lit(0).alias("at"))
        turn = lambda acc, x: _bound(place(k, x["t"], acc["at"]), lambda p: F.struct(F.concat(acc["places"], F.array(p)).alias("places"), F.greatest(acc["at"], p + 1).alias("at")))
        places = F.aggregate(k["full"], start, turn, lambda acc: acc["places"])
        row = lambda x, p: F.struct(x["t"].alias("text"), x["i"].alias("chunk_index"), word_count(x["t"]).alias("token_count"), p.alias("char_start"), (p + F.length(x["t"])).alias("char_end"))
        return F.zip_with(k["full"], places, row)

    return _bound(F.struct(text.alias("text"), blocks.alias("blocks"), runs.alias("runs"), full.alias("full")), located_in)


def chunks(text: Column, strategy: str = "sliding_window") -> Column:
    pieces = {"regex": by_pattern, "overlapping": overlapping}.get(strategy.lower(), sliding)(text)
    return located(text, pieces)


def exploded(df: DataFrame, column: Column) -> DataFrame:
    """A row for each chunk, with the columns of ``df``; texts without chunks give none."""
    return df.withColumn("c__", F.explode(column)).select(*df.columns, "c__.*")


def windows_needed(n: int, size: int, step: int) -> int:
    return max(0, math.ceil((n - size) / step)) + 1 if n else 0
