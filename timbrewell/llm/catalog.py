"""The queries of this subpackage: one opN_<name> for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from timbrewell.llm import chat, fingerprints, jaccard, lines, packing, passages, pieces, quality_rules, shards, varbyte


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


def op4_size_tiered_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(_table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digest(_table(spark, sf_dir, "documents"))


def op7_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digest(_table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return varbyte.round_trip(_table(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passage_digest(_table(spark, sf_dir, "documents"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.with_probe(_table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_best_fit_packing,
        op3_document_fingerprints,
        op4_size_tiered_sharding,
        op5_ngram_jaccard_join,
        op6_line_dedup,
        op7_sentencepiece_sampling,
        op8_token_files,
        op9_suffix_array_dedup,
        op10_chat_formatting,
    )
}
ORACLES: dict[str, str] = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op3_document_fingerprints": fingerprints.ORACLE,
    "op5_ngram_jaccard_join": jaccard.ORACLE,
    "op6_line_dedup": lines.ORACLE,
    "op9_suffix_array_dedup": passages.ORACLE,
    "op10_chat_formatting": chat.ORACLE,
}
