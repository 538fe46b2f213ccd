"""Okapi BM25 over a document table.

The texts are read and split once: a row of a few figures for each document is kept, from which
both the statistics of the corpus (one row) and the scores are taken; nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.config import DEFAULT, STOP_WORDS
from quillon.functions.text import words
from quillon.lineage import kept

K1, B = 1.2, 0.75


def scores(docs: DataFrame, query: str, id_column: str = "doc_id", text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """Id, score and the score squashed to [0, 1] of documents that hold a term of the query.
    idf = ln(1 + (N - df + 0.5) / (df + 0.5)); squash = s / (s + 1)."""
    asked = list(dict.fromkeys(_plain_keywords(query)))
    w = words(F.lower(F.col(text)))
    # the words are made once, cut down to those asked for, and these counted for each term
    hits = F.filter("w__", lambda x: x.isin(asked)) if asked else F.array().cast("array<string>")
    tf = F.array(*[F.size(F.filter("hits__", _equals(t))) for t in asked]) if asked else F.array().cast("array<int>")
    split = docs.select(F.col(id_column).alias("id__"), w.alias("w__")).select("id__", F.size("w__").alias("len"), hits.alias("hits__"))
    rows = kept(split.select("id__", "len", tf.alias("tf")))
    n = len(asked)
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"), *[F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(n)])
    joined = rows.where(F.exists("tf", lambda x: x > 0)).join(F.broadcast(stats))
    norm = k1 * (1 - b + b * F.col("len") / F.col("avgdl"))
    score = F.lit(0.0)
    for i in range(n):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * F.col("tf")[i] * (k1 + 1) / (F.col("tf")[i] + norm)
    return joined.select(F.col("id__").alias(id_column), score.alias("score")).withColumn("relevance", F.col("score") / (F.col("score") + 1))


def _equals(term: str):
    return lambda w: w == F.lit(term)


def _plain_keywords(query: str) -> list[str]:
    kept = [t for t in query.lower().split() if t not in STOP_WORDS]
    return kept or query.lower().split()


def top(docs: DataFrame, query: str, n: int = DEFAULT.search_results, **options) -> DataFrame:
    id_column = options.get("id_column", "doc_id")
    return scores(docs, query, **options).orderBy(F.desc("score"), id_column).limit(n)


def content_filter(blocks: DataFrame, query: str, threshold: float = DEFAULT.bm25_threshold, id_column: str = "block_id", text: str = "text") -> DataFrame:
    """Blocks whose score reaches the threshold."""
    good = scores(blocks, query, id_column=id_column, text=text).where(F.col("score") >= threshold)
    return blocks.join(good.select(id_column), id_column, "left_semi")


def pruned(blocks: DataFrame, text: str = "text", links: str = "n_link_words", threshold: float = DEFAULT.pruning_threshold, least_words: int = DEFAULT.min_block_words) -> DataFrame:
    """Blocks of enough words of which few stand in links: the share of other words, which
    counts for more in longer blocks, reaches the threshold. A definition of our own."""
    n = F.size(words(F.col(text)))
    density = (1 - F.col(links) / F.greatest(n, F.lit(1))) * F.least(F.lit(1.0), n / F.lit(float(least_words)))
    return blocks.where((n >= least_words) & (density >= threshold))

