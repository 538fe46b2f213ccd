"""A corpus pipeline of four stages over ``documents``: quality rules, near-duplicates,
mixing of sources, packing. Each stage is written to the shared folder and read again, so a
lost executor costs at most one stage's tasks.

Null texts and texts of under 50 words go in the first stage; a null source is a source; a null
id is an id to no other row, and stays; an empty table passes through. The columns of
``documents``, and any others, go through all stages but the last, which gives pieces and bins.
Texts are taken whole, however long."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import minhash, mixing, packing, quality
from quillon.llm.shared import saved, sent

#: Similarity of five-word shingles, in percent, from which two documents are linked.
PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule and no host verdict rejects; repeated rows are judged alike."""
    return quality.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (links at ``PERCENT``): that of the smallest id.
    Of rows that repeat an id, the first by text stays, null before all; rows without an id stay,
    and so do empty texts."""
    found = saved(minhash.near_duplicates(docs, percent=PERCENT), "near")
    gone = saved(found.where(~F.col("kept")).select("doc_id").distinct(), "gone", found.count())
    out = docs.join(sent(gone, 16), "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
    again = saved(found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again", found.count())
    if not again.limit(1).count():
        return out
    # a row at a time is compared, before the shuffle as well, so no task holds an id's rows
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    firsts = out.join(sent(again, 16), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct("text")).alias("row__")).select("row__.*")
    return out.join(sent(again, 16), "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns]).unionByName(firsts)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them, a row for each pass over a document; repeated rows are
    taken apart, texts without words never."""
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents with their bins; repeated rows are items of their own."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("mixing", mix_sources),
    ("packing", best_fit_packing),
]

#: SQL has no pseudorandom permutation and no best fit; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
