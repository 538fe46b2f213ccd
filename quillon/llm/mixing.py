"""Mixing sources to target weights.

The words of a source, its documents one after the other, are packed into blocks of
``BLOCK`` words (the last is shorter). A source's target becomes a number of slots. Output
shards have ``SHARD_SLOTS`` slots each (the last has the rest). The source counts of a shard
are drawn from the multinomial of the targets, conditioned on all shards together coming to
them (drawn without replacement), as a source at its bound has no slot to spare: a keyed
permutation of the numbered slots of all sources deals them to the shards. Slot j of a
source stands for block ``perm(j)``, where perm is a keyed pseudorandom permutation of its
block numbers, a new one for each pass over the source: so a block comes once in each pass,
and no pass begins before the last has ended. Slots meet blocks by a join on (source, block
number). The last slot is cut so that a source's words come to its target.

Everything follows from the seed and the data, so reruns agree. Prefix sums are taken over
ranges of sorted rows, so a source with most of the rows is dealt over many tasks.

Null and empty texts have size 0 and are never taken; null sources are one source, the last;
repeated rows are taken apart; null ids are ids. Other columns are ignored by ``mix`` and carried
by ``mixed_documents``. A text is read whole to count its words; ``mix`` moves only sizes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as k
from .shared import ranked, running, saved, sized_parts

BLOCK = 256
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 20_240_901
SHARD_SLOTS = 4096
#: Smaller splits of the texts are read together.
SPLIT_ROWS = 5_000
PART_ROWS = 20_000
#: Slots that a task takes at a time.
PIECE = 1 << 17
_U = np.uint64


def _round(x: np.ndarray, key: int, half: int) -> np.ndarray:
    return k.mix(x + _U(key & (1 << 64) - 1)) & _U((1 << half) - 1)


def _keys(seed: int) -> list[int]:
    return [int(v) for v in k.mix(np.arange(1, 5, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed & (1 << 64) - 1))]


def _half(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _walk(x: np.ndarray, n: int, step) -> np.ndarray:
    """Apply a permutation of a larger domain until all values are below n."""
    out = step(x.astype(np.uint64))
    while len(far := np.flatnonzero(out >= _U(n))):
        out[far] = step(out[far])
    return out.astype(np.int64)


def permute(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Images of x under a keyed permutation of 0..n-1 (Feistel rounds, cycle walking)."""
    half, keys = _half(n), _keys(seed)

    def step(v):
        left, right = v >> _U(half), v & _U((1 << half) - 1)
        for key in keys:
            left, right = right, left ^ _round(right, key, half)
        return left << _U(half) | right

    return _walk(x, n, step)


def unpermute(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    half, keys = _half(n), _keys(seed)

    def step(v):
        left, right = v >> _U(half), v & _U((1 << half) - 1)
        for key in reversed(keys):
            left, right = right ^ _round(left, key, half), left
        return left << _U(half) | right

    return _walk(x, n, step)


def pass_seed(seed: int, source: int, turn: int) -> int:
    return int(k.mix(np.array([seed * 1_000_003 + source * 64 + turn & (1 << 64) - 1], np.uint64))[0])


def plan_source(source: int, size: int, want: int, seed: int = SEED, block: int = BLOCK) -> tuple[int, int]:
    """(slots, words of the last slot) that give ``want`` words of a source of ``size`` words."""
    if not size or not want:
        return 0, 0
    blocks = -(-size // block)
    short = size - (blocks - 1) * block
    turn, rest = divmod(want, size)
    if not rest:
        turn, rest = turn - 1, size
    place = int(unpermute(np.array([blocks - 1]), blocks, pass_seed(seed, source, turn))[0])
    have = lambda i: i * block - (block - short if place < i else 0)
    i = rest // block
    while have(i) < rest:
        i += 1
    return turn * blocks + i, rest - have(i - 1)


def word_counts(column: pa.Array) -> np.ndarray:
    data, offsets = k.buffers(column)
    parts = [k.Words(d, o).counts for _, _, d, o in k.pieces(data, offsets)]
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


def with_size(df: DataFrame, text: str = "text", name: str = "size") -> DataFrame:
    """``df`` without its text, with its number of words."""
    names = [c for c in df.columns if c != text]
    at, kept = df.columns.index(text), [df.columns.index(c) for c in names]
    schema = df.select(*[f"`{c}`" for c in names]).schema.add(name, "long")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(word_counts(b.column(at)))], names=schema.names)

    return df.mapInArrow(run, schema)


def targets(sizes: DataFrame) -> DataFrame:
    """By source: sid (its rank by code point, null last), source_size and target. Shares that
    end at ``MOST`` times a size are found by raising one level over all sources until no
    more of them are at their end: each turn is one small aggregate."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources, _ = ranked(sources.withColumn("last__", F.col("source").isNull()), ["last__", "source"], "sid")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("sid") % len(WEIGHTS) + 1).cast("int"))
    sources = saved(sources.drop("last__").withColumns({"weight": weight, "most": F.col("source_size") * float(MOST)}), "sources")
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * SHARE
    level, ended = 0.0, -1
    while total:
        at_end = F.col("most") <= F.col("weight") * level if ended >= 0 else F.lit(False)
        r = sources.agg(F.sum(F.when(at_end, F.col("most")).otherwise(0.0)), F.sum(F.when(~at_end, F.col("weight")).otherwise(0.0)), F.count_if(at_end)).first()
        if r[2] == ended or not r[1]:
            break
        level, ended = (total - r[0]) / r[1], r[2]
    return sources.withColumn("target", F.least(F.col("most"), F.col("weight") * level)).select("source", "sid", "source_size", "target")


def draws(sources: DataFrame, seed: int = SEED, block: int = BLOCK) -> tuple[DataFrame, int]:
    """sid, source_size, target, n_slots, last_words (of the last slot) and first (slots of all
    sources before it) of each source; and the number of slots."""
    schema = "sid long, source_size long, target double, n_slots long, last_words long"

    def run(batches):
        for b in batches:
            sid, size, target = (c.to_pylist() for c in b.columns)
            plans = [plan_source(i, n, min(round(t), MOST * n), seed, block) for i, n, t in zip(sid, size, target, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([p[0] for p in plans], pa.int64()), pa.array([p[1] for p in plans], pa.int64())], names=["sid", "source_size", "target", "n_slots", "last_words"])

    planned = sources.select("sid", "source_size", "target").mapInArrow(run, schema)
    out, slots = running(planned, ["sid"], "n_slots", 1 + sources.count() // PART_ROWS, "row__n", "first")
    return out.drop("row__n"), slots


def slot_blocks(drawn: DataFrame, slots: int, seed: int = SEED, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """sid, block, turn (pass), shard, place (in its shard) and words (taken from the block's head)
    of each slot."""
    schema = "sid long, block long, turn int, shard long, place long, words long"
    deal = pass_seed(seed, -1, 0)

    def run(batches):
        for b in batches:
            for sid, size, total, last, first, lo in zip(*(c.to_pylist() for c in b.columns), strict=True):
                blocks = -(-size // block)
                slot = np.arange(lo, min(lo + PIECE, total))
                turn, number = slot // blocks, np.zeros(len(slot), np.int64)
                for t in np.unique(turn).tolist():
                    at = turn == t
                    number[at] = permute(slot[at] % blocks, blocks, pass_seed(seed, sid, t))
                words = np.minimum(block, size - number * block)
                words[slot == total - 1] = last
                where = permute(first + slot, slots, deal)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), sid)), pa.array(number), pa.array(turn.astype(np.int32)), pa.array(where // shard_slots), pa.array(where % shard_slots), pa.array(words)], names=["sid", "block", "turn", "shard", "place", "words"])

    pieces = drawn.where("n_slots > 0").select("sid", "source_size", "n_slots", "last_words", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_slots") - 1, F.lit(PIECE).cast("long"))).alias("lo"))
    # a number of its own: the few rows of a piece each stand for many
    return pieces.repartition(sized_parts(slots, PIECE), "sid", "lo").mapInArrow(run, schema)


def shard_counts(slots: DataFrame) -> DataFrame:
    """shard, sid, slots: the source counts drawn for each output shard."""
    return slots.groupBy("shard", "sid").agg(F.count("*").alias("slots"))


def _placed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """``sizes`` with sid, source_size, target, row, and start: words of the source before the row."""
    n = sizes.count()
    ahead, _ = running(sources, ["sid"], "source_size", 1 + sources.count() // PART_ROWS, "row", "ahead")
    ahead = ahead.select(F.col("source").alias("source__"), "sid", "source_size", "target", "ahead")
    rows = sizes.join(ahead, F.col("source").eqNullSafe(F.col("source__"))).drop("source__", "source")
    keys = [c for c in ("doc_id", "tie") if c in sizes.columns]
    # equal rows are alike; the last key only keeps them from falling into one range
    order = ["sid", F.xxhash64(*keys), *keys, "size", F.xxhash64(F.monotonically_increasing_id())]
    placed, _ = running(rows, order, "size", sized_parts(n, PART_ROWS), "row", "start")
    return placed.withColumn("start", F.col("start") - F.col("ahead")).drop("ahead")


def _met(placed: DataFrame, slots: DataFrame, block: int) -> DataFrame:
    """Rows by block, joined with the slots that take it: lo and hi are words of the row."""
    number = F.when(F.col("size") > 0, F.sequence(F.expr(f"start DIV {block}"), F.expr(f"(start + size - 1) DIV {block}")))
    rows = placed.withColumn("block", F.explode_outer(number))
    # slots come from a table of a few rows, by which their size must not be guessed
    rows = rows.join(slots.select("sid", "block", "turn", "words").hint("merge"), ["sid", "block"], "left")
    head = F.col("block") * block
    # a block that no slot takes has no words, and least() would pass over its null
    hi = F.when(F.col("words").isNotNull(), F.least(F.col("start") + F.col("size"), head + F.col("words")) - F.col("start"))
    return rows.withColumns({"lo": F.greatest(F.col("start"), head) - F.col("start"), "hi": hi})


def mix(docs: DataFrame, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes) of every document."""
    n = docs.count()
    sizes = saved(with_size(docs.select("doc_id", "source", "text")), "sizes", n, SPLIT_ROWS)
    sources = saved(targets(sizes), "targets")
    met = _met(_placed(sizes, sources), slot_blocks(*draws(sources, seed, block), seed, block), block)
    keys = ["row", "doc_id", "size", "source_size", "target"]
    out = met.groupBy(*keys).agg(F.sum(F.greatest(F.coalesce(F.col("hi") - F.col("lo"), F.lit(0)), F.lit(0))).alias("taken"))
    return out.select("doc_id", "size", "source_size", "target", "taken").coalesce(sized_parts(n, 50_000))


def mixed_documents(docs: DataFrame, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each document and pass that takes
    any of its words. Taken whole, its text is unchanged; else it is the taken runs of words,
    each as it stands in the text, in order, with a line between runs. n_chars follows the text."""
    keyed = docs.withColumn("tie__", F.xxhash64(F.coalesce("text", F.lit(""))))
    sizes = saved(with_size(keyed.select("doc_id", "source", F.col("tie__").alias("tie"), "text")), "sizes", docs.count(), SPLIT_ROWS)
    repeated = sizes.groupBy("doc_id", "tie").count().where("count > 1").limit(1).count()
    sources = saved(targets(sizes), "targets")
    placed = _placed(sizes, sources)
    one = Window.partitionBy("doc_id", "tie").orderBy("row")
    placed = placed.withColumn("copy", F.row_number().over(one) if repeated else F.lit(1))
    met = _met(placed, slot_blocks(*draws(sources, seed, block), seed, block), block).where(F.col("hi") > F.col("lo"))
    spans = met.groupBy("doc_id", "tie", "copy", "turn", "size").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans__"))
    spans = spans.select(F.col("doc_id").alias("id__"), F.col("tie").alias("tie_"), F.col("copy").alias("copy_"), F.col("turn").alias("turn__"), "spans__")
    again = Window.partitionBy("doc_id", "tie__").orderBy(F.col("source").asc_nulls_last())
    keyed = keyed.withColumn("copy__", F.row_number().over(again) if repeated else F.lit(1))
    out = keyed.join(spans, keyed["doc_id"].eqNullSafe(spans["id__"]) & (keyed["tie__"] == spans["tie_"]) & (keyed["copy__"] == spans["copy_"]))
    names, at = docs.columns, docs.columns.index("text")
    schema = docs.schema

    def run(batches):
        for whole in batches:
            data, offsets = k.buffers(whole.column(at))
            # a few texts at a time, so that a batch of long ones is not held twice
            for first, end, _, _ in k.pieces(data, offsets, 4 * k.CHUNK):
                b = whole.slice(first, end - first)
                texts, spans = b.column(at).to_pylist(), b.column(len(names)).to_pylist()
                new = [cut(t, [(s["lo"], s["hi"]) for s in some]) for t, some in zip(texts, spans, strict=True)]
                arrays = [b.column(i) for i in range(len(names))]
                arrays[at] = pa.array(new, pa.string())
                if "n_chars" in names:
                    arrays[names.index("n_chars")] = pa.array(list(map(len, new)), pa.int64())
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return out.select(*[F.col(f"`{c}`") for c in names], "spans__").mapInArrow(run, schema)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """Runs of words lo..hi-1 of a text; the text itself if they are all its words."""
    runs: list[list[int]] = []
    for lo, hi in spans:
        if runs and runs[-1][1] >= lo:
            runs[-1][1] = max(hi, runs[-1][1])
        else:
            runs.append([lo, hi])
    data = np.frombuffer(text.encode(), np.uint8)
    words = k.Words(data, np.array([0, len(data)]))
    if runs == [[0, len(words.starts)]]:
        return text
    raw = data.tobytes()
    return "\n".join(raw[words.starts[lo] : words.ends[hi - 1]].decode() for lo, hi in runs)
