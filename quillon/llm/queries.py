"""One query for each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chat, hilbert, minhash, mixing, packing, quality, retrieval, shared, spelling, tokenbin, tokencount, topk, warc

END_ID = 1


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    definition = chat.definition_of(public_tokenizers.path("byte_bpe_50k.json"))
    turns = chat.format_turns(chat.with_probe(_table(spark, sf_dir, "conversations")), definition)
    return chat.read_back(turns, definition, clustered=True)


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        definition = f.read()
    path = shared.fresh_dir(spark, "tokens")
    tokenbin.write_tokens(_table(spark, sf_dir, "documents"), path, definition, END_ID)
    return tokenbin.read_tokens(spark, path)


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = tokencount.pieces_of(public_tokenizers.path("word_bpe_49k.json"))
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), tokencount.Automaton(sorted(pieces)))


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.digest(_table(spark, sf_dir, "documents"), shards=24)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.fresh_dir(spark, "warc")
    written = warc.write_archives(_table(spark, sf_dir, "pages"), path)
    return warc.complete(warc.digest(warc.read_archives(written)), written)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.host_rules(_table(spark, sf_dir, "documents"))


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    return retrieval.digest(retrieval.pack_by_retrieval(_table(spark, sf_dir, "documents"), definition, END_ID))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    # imported here, as its stages are made of this package
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_minhash_dedup, op2_chat_format, op3_token_binary, op4_exact_topk, op5_source_mix, op6_token_counts, op7_hilbert_shards, op8_warc, op9_quality_rules, op10_best_fit, op11_spelling_variants, op12_filter_audit, op13_retrieval_packing, pipeline)
}

ORACLES: dict[str, str] = {
    "op1_minhash_dedup": minhash.ORACLE,
    "op2_chat_format": chat.ORACLE,
    "op4_exact_topk": topk.ORACLE,
    "op8_warc": warc.ORACLE,
    "op9_quality_rules": quality.ORACLE,
    "op11_spelling_variants": spelling.ORACLE,
    "op12_filter_audit": audit.ORACLE,
}
