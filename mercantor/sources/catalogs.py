"""Catalog feeds: JSON lines, tab-separated feeds with feature bags, option grids, judgments, and their sinks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import NUMBER

_TEXTS = lambda *names: ", ".join(f"{n} STRING" for n in names)
RECORDS = _TEXTS("id", "title", "description", "bullets", "brand", "color")
FURNITURE = _TEXTS("id", "title", "description", "product_class", "category_leaf", *(f"category_depth_{k}" for k in range(1, 7)), "color", "style", "primarymaterial", "material", "shape") + ", rating_count DOUBLE, average_rating DOUBLE, review_count DOUBLE"
JUDGMENTS = "query_id LONG, query STRING, product_id STRING, label STRING"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORDS).json(path)


def read_furniture(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FURNITURE).json(path)


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """Rows with a label of the scale E, S, C, I; others are dropped."""
    return spark.read.schema(JUDGMENTS).json(path).where(F.col("label").isin("E", "S", "C", "I"))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated feed with a header, all columns strings."""
    return spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)


def features(bag: Column) -> Column:
    """``a:b|c:d`` as a map; of a key given twice the first value stays; parts without a colon are left out."""
    parts = F.filter(F.split(bag, r"\|"), lambda x: F.instr(x, ":") > 0)
    pairs = F.transform(parts, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    keys = F.transform(pairs, lambda p: p.k)
    first = F.filter(pairs, lambda p, i: F.array_position(keys, p.k) == i + 1)
    return F.map_from_entries(first)


def feature_rows(feed: DataFrame, id_col: str, bag_col: str) -> DataFrame:
    """(id, key, value) of every feature."""
    return feed.select(F.col(id_col).alias("id"), F.explode(features(F.col(bag_col))).alias("key", "value"))


def breadcrumbs(path: Column, deepest: int = 6) -> list[Column]:
    """The path's prefixes of one to ``deepest`` levels, null where it is shorter."""
    parts = F.filter(F.transform(F.split(path, "/"), lambda x: F.trim(x)), lambda x: x != "")
    return [F.when(F.size(parts) >= d, F.array_join(F.slice(parts, 1, d), " / ")).alias(f"category_depth_{d}") for d in range(1, deepest + 1)]


def product_class(classes: Column, *depths: Column) -> Column:
    """The first of the ``|``-separated classes, else the deepest category."""
    first = F.nullif(F.trim(F.split(classes, r"\|")[0]), F.lit(""))
    return F.coalesce(first, *reversed(depths))


def option_grid(parents: DataFrame) -> DataFrame:
    """Parents (sku, name, price_cents, colors, sizes) to variants: every other cell of the color by size grid."""
    rows = parents.select("sku", "name", "price_cents", F.posexplode("colors").alias("ci", "color"), "sizes").select("sku", "name", "price_cents", "ci", "color", F.posexplode("sizes").alias("si", "size"))
    kept = rows.where((F.col("ci") + F.col("si")) % 2 == 0)
    return kept.select("sku", "name", "price_cents", "color", "size", F.concat_ws("-", "sku", "color", "size").alias("variant_sku"))


def feature_stats(rows: DataFrame) -> DataFrame:
    """(key, n, values, numeric, mean_length) of features (id, key, value)."""
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("value").alias("values"), F.count_if(F.col("value").rlike(NUMBER)).alias("numeric"), F.round(F.avg(F.length("value")), 6).alias("mean_length"))


def vertical(records: DataFrame, pattern: str, cap: int, order: str = "id", locale: str | None = None, most: int | None = None) -> DataFrame:
    """Records of a locale whose texts match a pattern: the first seen, ``cap`` of each brand and ``most`` in all.

    The brand's rows are kept by a bounded top-k before any window, so a brand of any size is no single task.
    """
    from pyspark.sql import Window

    text = F.lower(F.concat_ws(" ", "title", "description", "bullets"))
    rows = records.where(text.rlike(pattern))
    if locale is not None:
        rows = rows.where(F.col("locale") == locale)
    some = rows.withColumn("_s", F.spark_partition_id())
    for group in (["brand", "_s"], ["brand"]):
        some = some.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(order))).where(F.col("_k") <= cap)
    some = some.drop("_k", "_s")
    return some if most is None else some.orderBy(order).limit(most)


def interned(records: DataFrame, name: str) -> DataFrame:
    """The records with a number for each distinct trimmed, lower-cased value; 0 where there is none."""
    from ..catalog import with_ordinal

    key = F.lower(F.trim(F.col(name)))
    known = with_ordinal(records.select(key.alias("_key")).where("_key <> ''").distinct(), "_key", name=f"{name}_id").withColumn(f"{name}_id", F.col(f"{name}_id") + 1)
    return records.withColumn("_key", key).join(known, "_key", "left").withColumn(f"{name}_id", F.coalesce(f"{name}_id", F.lit(0))).drop("_key")


def typed(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Only accepted fields, each under its type: enum, text, number or boolean.  What doesn't parse is missing."""
    number = lambda c: F.when(F.col(c).rlike(NUMBER), F.col(c).try_cast("double"))
    truth = lambda c: F.when(F.lower(F.trim(F.col(c))).isin("true", "yes", "1"), True).when(F.lower(F.trim(F.col(c))).isin("false", "no", "0"), False)
    make = {"number": number, "boolean": truth}
    return rows.select("id", *[make.get(kind, F.col)(c).alias(f"{c}__{kind}") for c, kind in fields.items()])


#: Roles of a descriptor that become a column, and the kind they become.
_ROLE_KINDS = {"enum": "enum", "numeric": "number", "boolean": "boolean", "free_text": "text", "identifier": "text"}


def described(rows: DataFrame, descriptors: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows under their descriptors (field, role, confidence, accepted): only accepted ones of enough confidence.

    Descriptors are one row a field, so they come to the driver; the rows are only projected.
    """
    good = descriptors.where(F.col("accepted") & (F.col("confidence") >= least)).orderBy("field").collect()
    return typed(rows, {r["field"]: _ROLE_KINDS[r["role"]] for r in good if r["role"] in _ROLE_KINDS and r["field"] in rows.columns})


# What the generated catalogs of four verticals are made of.
VERTICALS = {
    "apparel": {"types": ("shirt", "jacket"), "colors": ("black", "white", "red", "blue"), "sizes": tuple(map(float, range(6, 14))), "price": (4999, 15000)},
    "furniture": {"types": ("sofa", "desk", "bed"), "colors": ("oak", "walnut", "grey"), "sizes": (90.0, 140.0, 160.0, 200.0), "price": (9999, 90000)},
    "electronics": {"types": ("phone", "laptop", "camera"), "colors": ("black", "silver"), "sizes": (64.0, 128.0, 256.0), "price": (19999, 150000)},
    "grocery": {"types": ("coffee", "tea"), "colors": ("dark", "green"), "sizes": (0.25, 0.5, 1.0), "price": (299, 3000)},
}


def synthetic(products: DataFrame, vertical_: str = "apparel", seed: int = 42) -> DataFrame:
    """Two variants for each product id, the same for the same seed: a pure function of the ids."""
    v = VERTICALS[vertical_]
    rows = products.select("product_id").withColumn("variant_id", F.explode(F.array(F.col("product_id") * 2, F.col("product_id") * 2 + 1)))
    pick = lambda tag, values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64("variant_id", F.lit(tag), F.lit(seed)), F.lit(len(values))) + 1).cast("int"))
    low, wide = v["price"]
    return rows.select("product_id", "variant_id", F.element_at(F.array(*map(F.lit, v["types"])), (F.col("product_id") % len(v["types"]) + 1).cast("int")).alias("product_type"), pick("color", v["colors"]).alias("color"), pick("size", v["sizes"]).alias("size"), (low + F.pmod(F.xxhash64("variant_id", F.lit("price"), F.lit(seed)), F.lit(wide))).alias("price_cents"), (F.col("product_id") % 3 == 0).alias("waterproof"))


def replicated(rows: DataFrame, times: int, *ids: str) -> DataFrame:
    """Each row ``times`` times, its ids made new by the copy's number."""
    out = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return out.withColumns({c: F.col(c) * times + F.col("copy") for c in ids})


def expanded(rows: DataFrame, times: int, made: dict[str, Column], *ids: str) -> DataFrame:
    """As `replicated`, with attributes computed from the copy's number and the row."""
    return replicated(rows, times, *ids).withColumns(made)


def dataset(spark: SparkSession, folder: str, kind: str) -> dict[str, DataFrame]:
    """A dataset of one of two kinds, read from its JSON files: its catalog, the names of its dimensions and its judgments.

    names: (dimension, id, name) with the ids that `interned` gives; 0 stands for no name.
    """
    records = {"records": read_records, "furniture": read_furniture}[kind](spark, f"{folder}/catalog")
    own = {"records": ("brand", "color"), "furniture": ("product_class", "color", "style")}[kind]
    catalog = records
    for name in own:
        catalog = interned(catalog, name)
    names = None
    for name in own:
        one = catalog.where(F.col(f"{name}_id") > 0).groupBy(F.lit(name).alias("dimension"), F.col(f"{name}_id").alias("id")).agg(F.lower(F.trim(F.min(name))).alias("name"))
        names = one if names is None else names.union(one)
    return {"catalog": catalog, "names": names, "judgments": read_judgments(spark, f"{folder}/judgments")}


def tenants(catalog: DataFrame, most: int, largest: bool = True) -> DataFrame:
    """The rows of the ``most`` largest or smallest tenants, a tenant being a region."""
    sizes = catalog.groupBy("region").agg(F.count("*").alias("tenant_size"))
    top = sizes.orderBy(F.desc("tenant_size") if largest else F.asc("tenant_size"), "region").limit(most)
    return catalog.join(top, "region")


def write_tenants(catalog: DataFrame, path: str) -> None:
    """One folder for each tenant, so that one can be read alone."""
    catalog.write.partitionBy("region").parquet(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def append_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def manifest(spark: SparkSession, **facts) -> str:
    """A run's facts as JSON text."""
    return json.dumps({"spark": spark.version, "settings": {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}, **facts}, sort_keys=True)
