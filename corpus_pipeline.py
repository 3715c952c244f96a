"""The corpus pipeline: quality rules, near copies, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
stage's documents.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mercantor.llm import decontam, jaccard, mixing, quality, sharding
from mercantor.llm.workspace import drop, keep, table

#: None: near-copy components, the mix's hash places and label propagation have no SQL form.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the production policy go."""
    return quality.keep_good(docs)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return jaccard.keep_one(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of a benchmark go."""
    return decontam.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def keep_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix of sources takes them."""
    return mixing.take(docs)


def deal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard and slot."""
    return sharding.digest(docs)


STAGES = [("quality_rules", keep_quality), ("jaccard_join", keep_distinct), ("decontamination", keep_clean), ("mixing", keep_mix), ("sharding", deal)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the session's shared folder and read again.

    A stage's rows are deleted once the next stage has written its own.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir))
        if before is not None:
            drop(before)
        before = docs
    return docs
