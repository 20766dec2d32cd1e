"""From raw documents to packed training sequences, in five stages of the llm operators.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept;
all but the last return the columns of documents.  Each stage's rows are written as
Parquet and reread as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import cutting_stock, line_dedup, near_dedup, substring_dedup, toxicity
from corpusloom.llm.common import WorkTable

#: The classifier is trained by numpy, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score 0.5 or more for toxicity."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out multi-line chunks that stand elsewhere before."""
    return line_dedup.dedup_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return near_dedup.keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out repeated passages of 35 words or more."""
    return substring_dedup.dedup_substrings(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the ids of what is left into sequences."""
    return cutting_stock.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", clean), ("line_dedup", lines), ("near_dedup", near), ("substring_dedup", passages), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = WorkTable(stage(spark, docs, sf_dir)).df
    return STAGES[-1][1](spark, docs, sf_dir)
