"""From raw documents to token files: every stage works on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from signalsieve.llm import decontamination, mixing, ngram_join, quality_rules, token_files
from signalsieve.llm.shared import new_folder, written


BATCH_ROWS = 500  # whole texts in an Arrow batch, in and outside the workers


def _whole_texts(spark: SparkSession) -> None:
    """Smaller Arrow batches, also for what a stage returns and its caller writes: a batch of whole texts is
    held several times, in the executor and in its worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    _whole_texts(spark)
    return ngram_join.one_of_each(docs, width=5, share=(80, 100))


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of test items."""
    _whole_texts(spark)
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share takes it."""
    return mixing.mixed_corpus(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and each document's place in them as read back."""
    _whole_texts(spark)
    path = new_folder(spark, "pipeline-tokens")
    token_files.encode(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_back(spark, path)


STAGES = [
    ("quality_rules", quality),
    ("ngram_join", near_duplicates),
    ("decontamination", benchmarks),
    ("mixing", mixture),
    ("token_files", tokens),
]

#: Hash thresholds, components and tokens are not expressible; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
