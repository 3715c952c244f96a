"""Names that no input column clashes with, input tables, and bounds that all operators share.

Intermediate tables are those of `mercantor.workspace`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import drop, folder, fresh_path, keep, release

__all__ = ["BATCH_BYTES", "OWN", "drop", "folder", "fresh_path", "keep", "prepared", "release", "small_batches", "table", "whole_numbers"]

#: Prefix of the columns that operators add for themselves while they work.
OWN = "__mx_"


def whole_numbers(df: DataFrame, id_col: str) -> None:
    """Ids that order classes and components must be whole numbers; anything else is told at once, not in a task."""
    kind = df.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must hold whole numbers, not {kind}")


#: Bytes of an Arrow batch on its way to Python; a longer text is a batch by itself.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of texts by bytes, so that JVM and Python hold few texts at a time.

    Spark's own bound is some 64 MB for each task on both sides; a smaller one that the session set is kept.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is not None and int(str(now).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by the path the caller gave (a folder in any store that Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepared(df: DataFrame, **named: str) -> DataFrame:
    """Only the named columns, under new names: extra columns with clashing names are left behind."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in named.items()])
