"""Filtered search, ranking, sorting and paging over the flat catalog table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import space_tokens
from ..model import Query, Request
from .predicates import matches, preference_score, where_all

IDS = ("product_id", "variant_id")


def execute(catalog: DataFrame, q: Query) -> DataFrame:
    """(product_id, variant_id) of the variants that meet all constraints; comparisons reach the scan as pushed filters."""
    return where_all(catalog, q.constraints).select(*IDS)


def title_tokens(catalog: DataFrame) -> Column:
    """The titles' words: as the index holds them, or split now in a table that was not compiled."""
    return F.col("title_tokens") if "title_tokens" in catalog.columns else space_tokens("title")


def text_score(residual: tuple[str, ...], title: Column) -> Column:
    """Two for each leftover word in the title, one for each in other texts (here, the words attribute).

    The index holds the titles' tokens, so no title is split while a query runs.
    """
    other = F.transform("words", F.lower)
    parts = [F.when(F.array_contains(title, w.lower()), 2.0).otherwise(0.0) + F.when(F.array_contains(other, w.lower()), 1.0).otherwise(0.0) for w in residual]
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def ranked(catalog: DataFrame, q: Query, k: int) -> DataFrame:
    """The k best: preferences score if there are any, leftover words otherwise; ties by ids."""
    score = preference_score(q.preferences) if q.preferences else text_score(q.residual, title_tokens(catalog))
    return where_all(catalog, q.constraints).select(*IDS, score.alias("score")).orderBy(F.desc("score"), *IDS).limit(k)


def narrowed(catalog: DataFrame, candidates: DataFrame, q: Query, k: int) -> DataFrame:
    """Candidates that still meet the constraints, in the order of ids, with score 0."""
    return where_all(catalog, q.constraints).join(candidates.select("variant_id"), "variant_id", "left_semi").select(*IDS, F.lit(0.0).alias("score")).orderBy(*IDS).limit(k)


def tiered(catalog: DataFrame, q: Query, k: int) -> DataFrame:
    """Rank by constraints met, then preferences met, then the brand's number of variants, then ids."""
    met = lambda cs: reduce(lambda a, b: a + b, [matches(c).cast("int") for c in cs], F.lit(0))
    brands = catalog.groupBy("brand").agg(F.count("*").alias("popularity"))
    rows = catalog.join(brands, "brand").select(*IDS, met(q.constraints).alias("n_constraints"), met([p.constraint for p in q.preferences]).alias("n_preferences"), "popularity")
    return rows.orderBy(F.desc("n_constraints"), F.desc("n_preferences"), F.desc("popularity"), *IDS).limit(k)


def sort_key(name: str, descending: bool) -> list[Column]:
    """Values before missing ones in both directions; NaN is missing; -0.0 equals 0.0; ties by ids, ascending."""
    x = F.col(name).cast("double")
    missing = x.isNull() | F.isnan(x)
    value = F.when(~missing, x + 0.0)
    return [missing.asc(), value.desc() if descending else value.asc(), *(F.col(c).asc() for c in IDS)]


def legacy_sort_key(name: str, descending: bool) -> list[Column]:
    """The older order: missing first ascending and last descending."""
    x = F.col(name).cast("double")
    value = F.when(~F.isnan(x), x)
    return [value.desc_nulls_last() if descending else value.asc_nulls_first(), *(F.col(c).asc() for c in IDS)]


def page(rows: DataFrame, r: Request) -> DataFrame:
    order = sort_key(r.sort, r.descending) if r.sort else [F.col(c) for c in IDS]
    shown = rows.select(*IDS, (F.col(r.sort).cast("double") if r.sort else F.lit(None).cast("double")).alias("sort_value"))
    out = rows.orderBy(*order) if not r.sort else shown.withColumnRenamed("sort_value", r.sort).orderBy(*order).withColumnRenamed(r.sort, "sort_value")
    return out.offset(r.offset).limit(r.limit).select(*IDS, "sort_value") if r.sort else out.offset(r.offset).limit(r.limit).select(*IDS, F.lit(None).cast("double").alias("sort_value"))


def pages(rows: DataFrame, size: int, most: int = 1_000_000):
    """All pages of (product_id, variant_id) in order, one after the other, by keyset.

    Each page must begin after the last one's end and be in order without repeats, else the source is at fault; the
    caller holds one page at a time.
    """
    last = None
    for _ in range(most):
        page_ = [tuple(r) for r in after(rows, last, size).collect()]  # one page
        if any(a >= b for a, b in zip([last, *page_] if last else page_, page_ if last else page_[1:], strict=False)):
            raise ValueError("a page is out of order or repeats the one before")
        if page_:
            yield page_
        if len(page_) < size:
            return
        last = page_[-1]


def best_of_groups(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The k first rows of each group with their place: each task keeps k of a group before any are shuffled."""
    from pyspark.sql import Window

    some = rows.withColumn("_t", F.spark_partition_id())
    some = some.withColumn("place", F.row_number().over(Window.partitionBy("_t", group).orderBy(*order))).where(F.col("place") <= k).drop("_t")
    return some.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= k)


def after(rows: DataFrame, last: tuple[int, int] | None, size: int) -> DataFrame:
    """Keyset paging: the page after the last (product_id, variant_id) seen."""
    if last:
        p, v = last
        rows = rows.where((F.col("product_id") > p) | ((F.col("product_id") == p) & (F.col("variant_id") > v)))
    return rows.select(*IDS).orderBy(*IDS).limit(size)
