"""A stored inverted index for BM25: written once, searched for many queries.

Each partition of the documents is sorted by two minwise words, which brings like texts together, and
cut into blocks of 64. A row holds what one term has in one block: the documents as a mask, their
counts and the largest weight among them, so no row grows with the documents that hold a term; one
more row a block, without a term, holds ids and numbers of words. A task that reads texts writes their
blocks sorted by term; nothing is shuffled, and a scan skips the pages of other terms where a search asks
for few.

A search is exact. Queries of at most 100,000 terms go to all tasks and meet a block together, so what a term has in a
block is read once for all of them. For more, the largest weights bound the score that a block can give; the blocks of
largest bound are scored first, and of the others only those whose bound reaches the k-th score found there.

Scores are those of ``operators.bm25``, rounded to nine decimals, so that ties do not hang on the
order of sums. Texts that are null or blank count as documents without words. Each row is a
document, whatever its id. Ids of queries are distinct; queries without an id, or whose words are in no
document, find nothing. ``index.json`` is written last: without it a folder is no index."""

from __future__ import annotations

import json
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.config import DEFAULT
from quillon.functions.text import keywords, words
from quillon.lineage import kept
from quillon.operators.bm25 import K1, B

from . import fs

BLOCK = 64  # documents that a mask holds
LEADS = 4
SENT = 100_000  # rows of queries' terms, or of pairs, that go to all tasks; more are shuffled
GATHERED = 64  # blocks that a task gathers
TOLD = 1000  # distinct terms that a scan is told
SLACK = 1e-8  # more than rounding can take from a bound
_WORD = re.compile("[^ \\t\\n\\x0b\\f\\r]+")


def _small(df: DataFrame) -> DataFrame:
    """Kept rows that are sent to all tasks if they are counted to be few."""
    return F.broadcast(df) if df.count() <= SENT else df


def _types(id_type: str) -> str:
    return f"term string, block long, n int, best double, mask long, tfs array<int>, ids array<{id_type}>, lens array<int>"


def _blocks(k1: float, b: float, mean: float):
    """Rows of all blocks of a partition, a block at a time."""

    def block(ids: list, texts: list, number: int, id_type: pa.DataType) -> pa.RecordBatch:
        codes, code, slots, counts, lens = {}, [], [], [], []
        for slot, text in enumerate(texts):
            tf = Counter(_WORD.findall(text))
            lens.append(tf.total())
            code += [codes.setdefault(w, len(codes)) for w in tf]
            counts += tf.values()
            slots += [slot] * len(tf)
        terms = list(codes)
        order = np.argsort(np.array(code, dtype=np.int64), kind="stable")  # by term, then as the texts stand
        slots, counts = np.array(slots, dtype=np.uint64)[order], np.array(counts, dtype=np.int32)[order]
        n = np.bincount(code, minlength=len(terms)).astype(np.int32) if terms else np.zeros(0, dtype=np.int32)
        ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        norm = k1 * (1 - b + b * np.array(lens, dtype=float)[slots.astype(np.int64)] / mean)
        weight = counts * (k1 + 1) / (counts + norm)
        best = np.maximum.reduceat(weight, ends[:-1]) if terms else weight
        masks = np.bitwise_or.reduceat(np.uint64(1) << slots, ends[:-1]).view(np.int64) if terms else np.zeros(0, dtype=np.int64)
        none = [None] * len(terms)
        columns = {
            "term": pa.array([*terms, None], pa.string()),
            "block": pa.array([number] * (len(terms) + 1), pa.int64()),
            "n": pa.array([*n.tolist(), len(ids)], pa.int32()),
            "best": pa.array([*best.tolist(), None], pa.float64()),
            "mask": pa.array([*masks.tolist(), None], pa.int64()),
            "tfs": pa.concat_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(counts, pa.int32())), pa.array([None], pa.list_(pa.int32()))]),
            "ids": pa.array([*none, ids], pa.list_(id_type)),
            "lens": pa.array([*none, lens], pa.list_(pa.int32())),
        }
        return pa.RecordBatch.from_pydict(columns)

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        ids, texts, id_type = [], [], None
        for batch in batches:
            id_type = batch.schema.field("id").type
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                ids += piece.column("id").to_pylist()
                texts += piece.column("text").to_pylist()
                if len(ids) >= BLOCK:
                    yield block(ids[:BLOCK], texts[:BLOCK], number, id_type)
                    ids, texts, number = ids[BLOCK:], texts[BLOCK:], number + 1
        if ids:
            yield block(ids, texts, number, id_type)

    return run


def _scores(k: int, k1: float, b: float, mean: float):
    """Of each pair of a query and a block, the documents whose score is among the block's ``k`` largest."""

    def run(batches):
        for batch in batches:
            q, at, ids, score = [], [], [], []
            for i, row in enumerate(batch.select(["block", "terms", "ids", "lens"]).to_pylist()):
                norm = k1 * (1 - b + b * np.array(row["lens"], dtype=float) / mean)
                total = np.zeros(len(norm))
                for t in row["terms"]:
                    slots = np.flatnonzero(np.unpackbits(np.array([t["mask"]], dtype="<i8").view(np.uint8), bitorder="little"))
                    tf = np.array(t["tfs"], dtype=float)
                    total[slots] += t["idf"] * tf * (k1 + 1) / (tf + norm[slots])
                total = np.round(total, 9)
                held = np.flatnonzero(total > 0)
                if len(held) > k:
                    held = held[total[held] >= np.sort(total[held])[-k]]
                q += [i] * len(held)
                at += [row["block"] * BLOCK + int(s) for s in held]
                ids += [row["ids"][s] for s in held]
                score += total[held].tolist()
            columns = [batch.column("q").take(pa.array(q, pa.int64())), pa.array(at, pa.int64()), pa.array(ids, batch.schema.field("ids").type.value_type), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["q", "at", "id", "score"])

    return run


def _met(k: int, k1: float, b: float, mean: float, sent):
    """Of each block, the documents that reach the ``k`` best scores of a query so far in this task. ``sent``: places of
    queries, in order, with places and weights of their terms."""

    def run(batches):
        of_query, of_term, idf = sent.value
        row_of = np.full(int(of_term.max()) + 1, -1)
        top = np.full((int(of_query.max()) + 1, k), 0.0)
        for batch in batches:
            q, at, ids, score = [], [], [], []
            terms = batch.column("terms")
            for i in range(batch.num_rows):
                block, held = batch.column("block")[i].as_py(), terms[i].values
                lens, own = batch.column("lens")[i].values.to_numpy(), batch.column("ids")[i].values
                t = held.field("t").to_numpy()
                bits = np.unpackbits(held.field("mask").to_numpy().astype("<i8").view(np.uint8).reshape(len(t), 8), axis=1, bitorder="little")[:, : len(lens)]
                row, slot = np.nonzero(bits)
                tf = held.field("tfs").flatten().to_numpy().astype(float)
                norm = k1 * (1 - b + b * lens.astype(float) / mean)
                weight = np.zeros((len(t), len(lens)))
                weight[row, slot] = tf * (k1 + 1) / (tf + norm[slot])
                row_of[t] = np.arange(len(t))
                rows = row_of[of_term]
                some = np.flatnonzero(rows >= 0)
                row_of[t] = -1
                asking, first = np.unique(of_query[some], return_index=True)
                total = np.zeros((len(asking), len(lens)))
                for n in range(0, len(some), 1 << 14):  # so many weights at a time
                    part = some[n : n + (1 << 14)]
                    whose, begins = np.unique(of_query[part], return_index=True)
                    total[np.searchsorted(asking, whose)] += np.add.reduceat(idf[part, None] * weight[rows[part]], begins, axis=0)
                total = np.round(total, 9)
                top[asking] = -np.partition(-np.hstack([top[asking], total]), k - 1, axis=1)[:, :k]
                who, slot = np.nonzero((total > 0) & (total >= top[asking].min(axis=1)[:, None]))
                q.append(asking[who])
                at.append(block * BLOCK + slot)
                ids.append(own.take(pa.array(slot)))
                score.append(total[who, slot])
            if q:
                columns = [pa.array(np.concatenate(q), pa.int64()), pa.array(np.concatenate(at), pa.int64()), pa.concat_arrays(ids), pa.array(np.concatenate(score), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["i", "at", "id", "score"])

    return run


class TextIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.facts = json.loads(fs.read_text(spark, f"{self.path}/index.json"))

    @classmethod
    def write(
        cls, docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", k1: float = K1, b: float = B
    ) -> TextIndex:
        spark, path = docs.sparkSession, path.rstrip("/")
        rows = docs.select(F.col(id_column).alias("id"), F.lower(F.coalesce(text, F.lit(""))).alias("text"))
        w = words(F.col("text"))
        n, mean = rows.agg(F.count("*"), F.avg(F.size(w))).first()
        mean = mean or 1.0
        least = [F.array_min(F.transform(w, lambda x, seed=seed: F.xxhash64(F.lit(seed), x))) for seed in range(2)]
        id_type = rows.schema["id"].dataType.simpleString()
        like = rows.select("id", "text", *[c.alias(f"least{i}") for i, c in enumerate(least)])
        made = like.sortWithinPartitions("least0", "least1").select("id", "text").mapInArrow(_blocks(k1, b, mean), _types(id_type))
        made.sortWithinPartitions("term", "block").write.parquet(f"{path}/postings")
        facts = {"documents": n, "mean": mean, "k1": k1, "b": b, "id": id_column, "id_type": id_type}
        fs.write_new(spark, f"{path}/index.json", json.dumps(facts))
        return cls(spark, path)

    # parts of a search

    def _postings(self) -> DataFrame:
        return self.spark.read.schema(_types(self.facts["id_type"])).parquet(f"{self.path}/postings")

    def _of_terms(self, asked: DataFrame) -> DataFrame:
        """Rows of the terms asked for, once a query."""
        told = [r[0] for r in asked.select("term").distinct().limit(TOLD + 1).collect()]
        rows = self._postings().where(F.col("term").isin(told) if len(told) <= TOLD else F.col("term").isNotNull())
        return rows.join(_small(asked), "term")

    @staticmethod
    def _words(queries: DataFrame, query_id: str, query: str) -> DataFrame:
        kept_words = words(F.lower(keywords(F.col(query))))
        return kept(queries.where(F.col(query_id).isNotNull()).select(F.col(query_id).alias("q"), F.explode(F.array_distinct(kept_words)).alias("term")))

    def _weighted(self, asked: DataFrame, met: DataFrame) -> DataFrame:
        df = met.groupBy("term").agg(F.sum("n").alias("df"))
        idf = F.log(1 + (self.facts["documents"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return kept(asked.join(df, "term").select("q", "term", idf.alias("idf")))

    def _at_once(self, asked: DataFrame, k: int) -> DataFrame:
        """Scores of the best documents for queries of at most ``SENT`` terms: each row of the index is read and shuffled
        once, however many queries ask for its term, and a block meets all queries in one step."""
        f = self.facts
        terms = asked.select("term").distinct()
        asked = self._weighted(asked, self._of_terms(terms).select("term", "n"))
        found = asked.collect()
        names, places = sorted({r["term"] for r in found}), {}
        place = {t: i for i, t in enumerate(names)}
        pairs = sorted((places.setdefault(r["q"], len(places)), place[r["term"]], r["idf"]) for r in found)
        types = f"i long, at long, id {f['id_type']}, score double"
        of_query = self.spark.createDataFrame([(i, q) for q, i in places.items()], f"i long, q {asked.schema['q'].dataType.simpleString()}")
        if not pairs:
            return of_query.select("q", F.lit(0).cast("long").alias("at"), F.lit(None).cast(f["id_type"]).alias("id"), F.lit(0.0).alias("score"))
        sent = self.spark.sparkContext.broadcast(tuple(np.array(c) for c in zip(*pairs)))
        rows = self._of_terms(self.spark.createDataFrame(list(place.items()), "term string, t int")).select("block", "t", "mask", "tfs", F.lit(None).cast(f"array<{f['id_type']}>").alias("ids"), F.lit(None).cast("array<int>").alias("lens"))
        heads = self._postings().where(F.col("term").isNull()).select("block", F.lit(None).cast("int").alias("t"), "mask", "tfs", "ids", "lens")
        # a task gathers a bounded number of blocks, whose rows are at most the terms asked for
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-f["documents"] // (BLOCK * GATHERED)))
        each = rows.unionByName(heads).repartition(parts, "block").groupBy("block").agg(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("t", "mask", "tfs"))).alias("terms"), F.first("ids", ignorenulls=True).alias("ids"), F.first("lens", ignorenulls=True).alias("lens"))
        best = each.where(F.size("terms") > 0).mapInArrow(_met(k, f["k1"], f["b"], f["mean"], sent), types)
        return best.join(F.broadcast(of_query), "i").select("q", "at", "id", "score")

    def _asked(self, queries: DataFrame, query_id: str, query: str) -> tuple[DataFrame, DataFrame]:
        """Terms of the queries that documents hold, with their weights, and the bounds of pairs of a
        query and a block."""
        asked = self._words(queries, query_id, query)
        met = kept(self._of_terms(kept(asked.select("term").distinct())).select("term", "block", "n", "best"))
        asked = self._weighted(asked, met)
        bound = met.join(_small(asked), "term").groupBy("q", "block").agg(F.sum(F.col("idf") * F.col("best")).alias("bound"))
        return asked, kept(bound)

    def _scored(self, pairs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
        """Scores of the best documents in pairs, which are kept, of a query and a block."""
        f = self.facts
        found = self._of_terms(asked).select("q", "block", "idf", "mask", "tfs").join(_small(pairs.select("q", "block")), ["q", "block"])
        each = found.groupBy("q", "block").agg(F.collect_list(F.struct("idf", "mask", "tfs")).alias("terms"))
        whole = each.join(self._postings().where(F.col("term").isNull()).select("block", "ids", "lens"), "block").select("q", "block", "terms", "ids", "lens")
        types = f"q {pairs.schema['q'].dataType.simpleString()}, at long, id {f['id_type']}, score double"
        return whole.mapInArrow(_scores(k, f["k1"], f["b"], f["mean"]), types)

    @staticmethod
    def _first(scored: DataFrame, k: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id", "at"))
        return scored.withColumn("rank", place).where(F.col("rank") <= k)

    def plan(self, queries: DataFrame, k: int, query_id: str = "query_id", query: str = "query", leads: int = LEADS):
        """Pairs of a query and a block with their bound and whether they are ``lead``, ``read`` or
        ``skipped``; the best of the leading blocks; terms asked for."""
        asked, bounds = self._asked(queries, query_id, query)
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "block"))
        lead = kept(bounds.withColumn("place", place).where(F.col("place") <= leads).select("q", "block"))
        best = kept(self._first(self._scored(lead, asked, k), k))
        floors = kept(best.where(F.col("rank") == k).select("q", F.col("score").alias("floor")))
        state = F.when(F.col("led"), "lead").when(F.col("floor").isNull() | (F.col("bound") + SLACK >= F.col("floor")), "read").otherwise("skipped")
        marked = bounds.join(_small(lead).withColumn("led", F.lit(True)), ["q", "block"], "left").join(_small(floors), "q", "left")
        return kept(marked.select("q", "block", "bound", state.alias("state"))), best, asked

    def search(self, queries: DataFrame, k: int = DEFAULT.search_results, query_id: str = "query_id", query: str = "query", leads: int = LEADS) -> DataFrame:
        """The ``k`` best documents of each query: query id, rank from 1, document id, score and the
        score squashed to [0, 1]; ties to the smaller id."""
        asked = self._words(queries, query_id, query)
        if asked.count() <= SENT:
            found = self._first(self._at_once(asked, k), k)
        else:
            pairs, best, asked = self.plan(queries, k, query_id, query, leads)
            others = self._scored(pairs.where(F.col("state") == "read"), asked, k)
            found = self._first(best.drop("rank").unionByName(others), k)
        return found.select(F.col("q").alias(query_id), "rank", F.col("id").alias(self.facts["id"]), "score", (F.col("score") / (F.col("score") + 1)).alias("relevance"))
