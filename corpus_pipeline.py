"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns
of documents, with n_chars following the text; further columns pass through. Null texts count as empty. Of rows that
duplicate one another one stays, the one with the smallest id (null ids come last); unlike texts under one id all stay.
An empty table gives an empty result of the same columns at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbrewell.llm import common, jaccard, lines, packing, passages, quality_rules


def _documents(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns, with n_chars counted anew."""
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    return rows.select(*[F.col(f"`{c}`") for c in columns])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the others go."""
    return quality_rules.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in the last of them."""
    return _documents(lines.dedup_lines(docs), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id stays; rows are judged by their texts, not by id."""
    return _documents(jaccard.keep_one(docs), docs.columns)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that occur earlier go, by whole characters."""
    return _documents(passages.dedup_passages(docs, whole_characters=True), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with the sequence and place of each."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", good_quality),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", passage_dedup),
    ("best_fit_packing", packed),
]

#: Tokenizing and packing are beyond SQL; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.durable(docs, name)
    return docs
