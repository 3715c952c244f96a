"""Ingestion steps over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import index as ix
from ..catalog import SQL, catalog, products, table
from ..registry import query
from ..sources import catalogs as src
from ..workspace import fresh_path


@query("SELECT p_partkey AS sku, c.color, s.size, p_partkey || '-' || c.color || '-' || s.size AS variant_sku FROM part, (VALUES (0, 'red'), (1, 'blue'), (2, 'black')) AS c(ci, color), (VALUES (0, 'S'), (1, 'M'), (2, 'L')) AS s(si, size) WHERE (ci + si) % 2 = 0")
def s_option_grid(spark, d):
    parents = table(spark, d, "part").select(F.col("p_partkey").alias("sku"), F.col("p_name").alias("name"), F.lit(100).alias("price_cents"), F.array(*map(F.lit, ("red", "blue", "black"))).alias("colors"), F.array(*map(F.lit, "SML")).alias("sizes"))
    return src.option_grid(parents).select("sku", "color", "size", "variant_sku")


@query("SELECT p_partkey AS id, unnest(['color', 'size']) AS key, unnest([p_name, CAST(p_size AS VARCHAR)]) AS value FROM part")
def s_feature_bag(spark, d):
    bag = F.concat(F.lit("color : "), "p_name", F.lit("|size:"), F.col("p_size").cast("string"), F.lit("|odd|color:again"))
    return src.feature_rows(table(spark, d, "part").select(F.col("p_partkey").alias("id"), bag.alias("bag")), "id", "bag")


@query(f"{SQL} SELECT supplier_id, region AS category_depth_1, path AS category_depth_2, CAST(NULL AS VARCHAR) AS category_depth_3, coalesce(CASE WHEN supplier_id % 2 = 0 THEN 'Sofas' END, path) AS class FROM category")
def s_breadcrumbs(spark, d):
    from ..catalog import categories

    rows = categories(spark, d)
    depths = src.breadcrumbs(F.col("path"), 3)
    classes = F.when(F.col("supplier_id") % 2 == 0, " Sofas | Beds").otherwise(" | Beds")
    return rows.select("supplier_id", *depths, src.product_class(classes, *depths).alias("class"))


_SOME_BRANDS = "SELECT p_partkey AS product_id, CASE WHEN p_size % 9 = 0 THEN NULL WHEN p_size % 9 = 1 THEN '  ' WHEN p_size % 2 = 0 THEN ' ' || upper(p_brand) ELSE p_brand END AS brand FROM part"


@query(f"WITH r AS ({_SOME_BRANDS}), b AS (SELECT k, row_number() OVER (ORDER BY k) AS brand_id FROM (SELECT DISTINCT lower(trim(brand)) AS k FROM r WHERE trim(brand) <> '')) SELECT product_id, coalesce(brand_id, 0) AS brand_id FROM r LEFT JOIN b ON lower(trim(brand)) = k")
def s_interned_brands(spark, d):
    """Numbers for names that differ in case and spaces; 0 where there is none."""
    size = F.col("p_size")
    brand = F.when(size % 9 == 0, None).when(size % 9 == 1, "  ").when(size % 2 == 0, F.concat(F.lit(" "), F.upper("p_brand"))).otherwise(F.col("p_brand"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), brand.alias("brand"))
    return src.interned(rows, "brand").select("product_id", "brand_id")


@query(f"{SQL}, t AS (SELECT region, count(*) AS tenant_size FROM catalog GROUP BY region ORDER BY tenant_size DESC, region LIMIT 2) SELECT variant_id, region, tenant_size FROM catalog JOIN t USING (region)")
def s_tenants(spark, d):
    return src.tenants(catalog(spark, d), 2).select("variant_id", "region", "tenant_size")


@query("SELECT p_partkey * 3 + c AS product_id, p_brand AS brand, CAST(c AS INT) AS copy FROM part, (SELECT unnest(range(3)) AS c)")
def s_replicated(spark, d):
    return src.replicated(products(spark, d).select("product_id", "brand"), 3, "product_id").select("product_id", "brand", "copy")


@query("SELECT p_partkey * 3 + c AS product_id, p_brand AS brand, CAST(c AS INT) AS copy, p_name || ' no. ' || c AS title, p_retailprice * (c + 1) AS price FROM part, (SELECT unnest(range(3)) AS c)")
def s_expanded(spark, d):
    """Copies with attributes computed from the copy's number."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"))
    made = {"title": F.concat("title", F.lit(" no. "), F.col("copy").cast("string")), "price": F.col("price") * (F.col("copy") + 1)}
    return src.expanded(rows, 3, made, "product_id").select("product_id", "brand", "copy", "title", "price")


@query("SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS size__number, p_size >= 25 AS large__boolean, p_brand AS brand__enum FROM part")
def s_typed(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("string").alias("size"), F.when(F.col("p_size") >= 25, "Yes").otherwise(" no").alias("large"), F.col("p_brand").alias("brand"))
    return src.typed(rows, {"size": "number", "large": "boolean", "brand": "enum"})


@query("SELECT p_partkey AS id, p_brand AS brand__enum, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS size__number, p_name AS title__text FROM part")
def s_described(spark, d):
    """Columns by a table of descriptors; rejected and unsure ones give none."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("odd").alias("size"), F.col("p_brand").alias("brand"), F.col("p_name").alias("title"), F.col("p_type").alias("kind"))
    descriptors = spark.createDataFrame([("size", "numeric", 0.9, True), ("brand", "enum", 0.8, True), ("title", "free_text", 0.6, True), ("kind", "enum", 0.9, False), ("nowhere", "enum", 0.9, True), ("id", "enum", 0.1, True)], "field string, role string, confidence double, accepted boolean")
    return src.described(rows, descriptors)


@query("SELECT id, brand FROM (SELECT p_partkey AS id, p_brand AS brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part WHERE regexp_matches(lower(p_name), 'red|blue') AND p_size % 2 = 0) WHERE k <= 3 ORDER BY id LIMIT 20")
def s_vertical(spark, d):
    """One locale's matching records, the first three of each brand and twenty in all."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("description"), F.lit("").alias("bullets"), F.col("p_brand").alias("brand"), F.when(F.col("p_size") % 2 == 0, "us").otherwise("jp").alias("locale"))
    return src.vertical(rows, "red|blue", 3, locale="us", most=20).select("id", "brand")


_MADE = " UNION ALL ".join(f"SELECT '{name}' AS vertical, p_partkey AS product_id, [{', '.join(repr(t) for t in v['types'])}][CAST(p_partkey % {len(v['types'])} + 1 AS INT)] AS product_type, p_partkey % 3 = 0 AS waterproof, 2 AS variants, TRUE AS sound FROM part" for name, v in src.VERTICALS.items())


@query(_MADE)
def s_synthetic(spark, d):
    """Four generated verticals; drawn values come from this engine's hash, so SQL checks their bounds."""
    parts = []
    ids = table(spark, d, "part").select(F.col("p_partkey").alias("product_id"))
    for name, v in src.VERTICALS.items():
        low, wide = v["price"]
        sound = F.bool_and(F.col("color").isin(*v["colors"]) & F.col("size").isin(*v["sizes"]) & F.col("price_cents").between(low, low + wide - 1))
        parts.append(src.synthetic(ids, name).groupBy(F.lit(name).alias("vertical"), "product_id", "product_type", "waterproof").agg(F.count("*").cast("int").alias("variants"), sound.alias("sound")))
    return reduce(DataFrame.union, parts)


def _records(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select(F.concat(F.lit("B"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"), F.when(size % 3 == 0, "it's \"new\"\nhere").alias("description"), F.lit(None).cast("string").alias("bullets"), F.when(size % 5 > 0, F.col("p_brand")).alias("brand"), F.split("p_name", " ")[0].alias("color"))


_RECORDS = """SELECT 'B' || p_partkey AS id, p_name AS title, CASE WHEN p_size % 3 = 0 THEN 'it''s "new"' || chr(10) || 'here' END AS description, CAST(NULL AS VARCHAR) AS bullets, CASE WHEN p_size % 5 > 0 THEN p_brand END AS brand, string_split(p_name, ' ')[1] AS color FROM part"""


@query(_RECORDS)
def s_records(spark, d):
    """Records written as JSON lines and read again."""
    src.write_jsonl(_records(spark, d), path := fresh_path(spark, "records"))
    return src.read_records(spark, path)


def _judgments(spark, d):
    label = F.element_at(F.array(*map(F.lit, "ESCIX")), (F.col("p_size") % 5 + 1).cast("int"))
    return table(spark, d, "part").select((F.col("p_partkey") % 100).alias("query_id"), F.split("p_name", " ")[1].alias("query"), F.concat(F.lit("B"), F.col("p_partkey").cast("string")).alias("product_id"), label.alias("label"))


@query("SELECT p_partkey % 100 AS query_id, string_split(p_name, ' ')[2] AS query, 'B' || p_partkey AS product_id, substr('ESCIX', CAST(p_size % 5 + 1 AS INT), 1) AS label FROM part WHERE p_size % 5 < 4")
def s_judgments(spark, d):
    """Judgments with a label of the scale; others are dropped."""
    src.write_jsonl(_judgments(spark, d), path := fresh_path(spark, "judgments"))
    return src.read_judgments(spark, path)


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, p_type AS product_class, 'Home / ' || p_type AS category_depth_2, CAST(p_size AS DOUBLE) AS rating_count, p_retailprice / 1000 AS average_rating FROM part")
def s_furniture(spark, d):
    """Furniture records of many columns, most of them absent in the file."""
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("product_class"), F.concat(F.lit("Home / "), "p_type").alias("category_depth_2"), F.col("p_size").cast("double").alias("rating_count"), (F.col("p_retailprice") / 1000).alias("average_rating"))
    src.write_jsonl(rows, path := fresh_path(spark, "furniture"))
    return src.read_furniture(spark, path).select("id", "title", "product_class", "category_depth_2", "rating_count", "average_rating")


_FEED = "f AS (SELECT p_partkey AS id, unnest(['color', 'size']) AS key, unnest([p_name, CAST(p_size AS VARCHAR)]) AS value FROM part)"


@query(f"WITH {_FEED} SELECT key, count(*) AS n, count(DISTINCT value) AS values, count(*) FILTER (try_cast(value AS DOUBLE) IS NOT NULL) AS numeric, round(avg(length(value)), 6) AS mean_length FROM f GROUP BY key")
def s_feed_stats(spark, d):
    """A tab-separated feed written and read again: the statistics of each key of its feature bags."""
    bag = F.concat(F.lit("color : "), "p_name", F.lit("|size:"), F.col("p_size").cast("string"), F.lit("|odd|color:again"))
    feed = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("product_id"), F.lit('a "quoted" name').alias("product_name"), bag.alias("product_features"))
    feed.write.option("sep", "\t").option("header", True).option("quote", "").csv(path := fresh_path(spark, "feed"))
    return src.feature_stats(src.feature_rows(src.read_feed(spark, path), "product_id", "product_features"))


@query(f"{SQL} SELECT region, count(*) AS n, min(variant_id) AS first FROM catalog WHERE region IN ('AFRICA', 'ASIA') GROUP BY region")
def s_tenant_files(spark, d):
    """A file set for each tenant; reading some tenants reads their folders only."""
    src.write_tenants(catalog(spark, d).select("region", "variant_id", "price_cents"), path := fresh_path(spark, "tenants"))
    return spark.read.parquet(path).where("region in ('AFRICA', 'ASIA')").groupBy("region").agg(F.count("*").alias("n"), F.min("variant_id").alias("first"))


@query("SELECT p_type AS cell, 2 * count(*) AS samples, CAST(2 * sum(p_size) AS BIGINT) AS total FROM part GROUP BY p_type")
def s_sample_files(spark, d):
    """Measurements appended to one CSV folder by two runs."""
    rows = table(spark, d, "part").select(F.col("p_type").alias("cell"), F.col("p_size").alias("value"))
    path = fresh_path(spark, "samples")
    for run in (1, 2):
        src.append_csv(rows.withColumn("run", F.lit(run)), path)
    read = spark.read.option("header", True).schema("cell string, value int, run int").csv(path)
    return read.groupBy("cell").agg(F.count("*").alias("samples"), F.sum("value").alias("total"))


@query("SELECT count(*) AS products, 'records' AS dataset, TRUE AS adaptive FROM part")
def s_manifest(spark, d):
    """A run's facts, written as JSON and read again."""
    import json

    facts = json.loads(src.manifest(spark, dataset="records", products=table(spark, d, "part").count()))
    return spark.createDataFrame([(facts["products"], facts["dataset"], facts["settings"]["spark.sql.adaptive.enabled"] == "true")], "products long, dataset string, adaptive boolean")


@query(f"WITH r AS ({_RECORDS}), j AS (SELECT 1 FROM part WHERE p_size % 5 < 4) SELECT 'catalog' AS part, count(*) AS n FROM r UNION ALL SELECT 'names', (SELECT count(DISTINCT brand) FROM r) + (SELECT count(DISTINCT color) FROM r) UNION ALL SELECT 'judgments', count(*) FROM j")
def s_dataset(spark, d):
    """A dataset loaded from its files: catalog, names of dimensions, judgments."""
    path = fresh_path(spark, "dataset")
    src.write_jsonl(_records(spark, d), f"{path}/catalog")
    src.write_jsonl(_judgments(spark, d), f"{path}/judgments")
    loaded = src.dataset(spark, path, "records")
    return reduce(DataFrame.union, [df.agg(F.lit(k).alias("part"), F.count("*").alias("n")) for k, df in loaded.items()])


@query(f"WITH r AS ({_RECORDS}) SELECT 'brand' AS dimension, CAST(row_number() OVER (ORDER BY k) AS BIGINT) AS id, k AS name FROM (SELECT DISTINCT lower(brand) AS k FROM r WHERE brand IS NOT NULL) UNION ALL SELECT 'color', row_number() OVER (ORDER BY k), k FROM (SELECT DISTINCT lower(color) AS k FROM r)")
def s_structural_names(spark, d):
    """The dimensions' names with their ids."""
    path = fresh_path(spark, "dataset")
    src.write_jsonl(_records(spark, d), f"{path}/catalog")
    src.write_jsonl(_judgments(spark, d), f"{path}/judgments")
    return src.dataset(spark, path, "records")["names"].select("dimension", F.col("id").cast("long").alias("id"), "name")


# Attribute maps whose names come in several kinds.
_MAPS = "m AS (SELECT p_partkey AS id, p_type, string_split(p_name, ' ') AS w, p_size FROM part)"


def _maps(spark, d):
    size, w = F.col("p_size"), F.split("p_name", " ")
    attributes = F.map_from_arrays(
        F.array(F.lit("color"), F.lit("size"), F.lit("words"), F.lit("large")),
        F.array(ix.value("enum", w[0]), F.when(size % 2 == 0, ix.value("number", size)).otherwise(ix.value("enum", size.cast("string"))), ix.value("multi", w), ix.value("boolean", size >= 25)),
    )
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("product_type"), attributes.alias("attributes"))
    return rows.withColumn("attributes", F.map_filter("attributes", lambda k, v: (k != "large") | v["b"]))


@query(f"WITH {_MAPS} SELECT id, w[1] AS color__enum, CASE WHEN p_size >= 25 THEN TRUE END AS large__boolean, CASE WHEN p_size % 2 = 1 THEN CAST(p_size AS VARCHAR) END AS size__enum, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS size__number, w AS words__multi FROM m")
def s_attributes(spark, d):
    """Attribute maps as one typed column for each name and kind."""
    return ix.pivot(_maps(spark, d), "attributes", "id")


@query(f"WITH {_MAPS}, k AS (SELECT p_type, 'color' AS name, 'enum' AS kind FROM m UNION SELECT p_type, 'words', 'multi' FROM m UNION SELECT p_type, 'size', CASE WHEN p_size % 2 = 0 THEN 'number' ELSE 'enum' END FROM m UNION SELECT p_type, 'large', 'boolean' FROM m WHERE p_size >= 25) SELECT p_type AS product_type, name, list_sort(list(kind)) AS kinds FROM k GROUP BY ALL")
def a_attribute_kinds(spark, d):
    """The kinds in which each product type's attributes come."""
    return ix.kinds(_maps(spark, d), "product_type", "attributes")


@query(f"{SQL} SELECT 'catalog' AS structure, count(*) AS rows, TRUE AS stored FROM catalog UNION ALL SELECT 'postings', count(*), TRUE FROM (SELECT DISTINCT product_id, unnest(words) FROM catalog) UNION ALL SELECT 'facets', (SELECT count(DISTINCT returnflag) + count(DISTINCT linestatus) + count(DISTINCT brand) + count(DISTINCT product_type) + count(DISTINCT category) + count(DISTINCT region) FROM catalog) + (SELECT count(DISTINCT w) FROM (SELECT unnest(words) AS w FROM catalog)), TRUE")
def s_index(spark, d):
    """What the compiled catalog consists of, and whether its files hold anything."""
    return ix.opened(spark, d).sizes(spark).select("structure", "rows", ((F.col("bytes") > 0) & (F.col("files") > 0)).alias("stored"))
