"""Identifier fields: statistics, the acceptance gate, the dictionary and lookups in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import entropy, identifier, signature

MIN_UNIQUE, MIN_VALUES = 0.95, 100


def field_stats(values: DataFrame) -> DataFrame:
    """(field, value, variant_scoped) to one row for each field.

    Signatures are counted by field and signature first, so the most frequent one needs no ordering of values.
    """
    norm = values.where("value is not null").withColumns({"norm": identifier("value"), "sig": signature("value"), "bits": entropy("value")})
    base = norm.groupBy("field").agg(F.count("*").alias("n"), F.countDistinct("norm").alias("n_distinct"), F.round(F.avg("bits"), 6).alias("mean_entropy"), F.bool_or("variant_scoped").alias("variant_scoped"))
    modal = norm.groupBy("field", "sig").agg(F.count("*").alias("c")).groupBy("field").agg(F.max("c").alias("modal"))
    out = base.join(modal, "field")
    return out.withColumns({"uniqueness": F.round(F.col("n_distinct") / F.col("n"), 6), "modal_share": F.round(F.col("modal") / F.col("n"), 6)}).drop("modal")


def accepted(stats: DataFrame) -> DataFrame:
    """Nearly unique values of variants, at least a hundred of them."""
    return stats.where((F.col("n_distinct") / F.col("n") >= MIN_UNIQUE) & F.col("variant_scoped") & (F.col("n") >= MIN_VALUES))


def dictionary(values: DataFrame, *ids: str) -> DataFrame:
    """(norm, ids): many to many."""
    return values.select(identifier("value").alias("norm"), *ids).where("norm <> ''").distinct()


def inserted(book: DataFrame, values: DataFrame, *ids: str) -> DataFrame:
    """The book with more values: only those are read and only what is new is added, the book is not made again."""
    return book.union(dictionary(values, *ids).join(book, ["norm", *ids], "left_anti").select(*book.columns))


def lookup(book: DataFrame, words: DataFrame, *ids: str) -> DataFrame:
    """(word) to the ids of every field that has it."""
    asked = words.select("word", identifier("word").alias("norm"))
    return asked.join(book, "norm").select("word", *ids).distinct()
