"""Lookups and joins by key, identifier, hierarchy and edit distance; paired and set comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import SQL, catalog, categories, products, table, variants
from ..operators import identifiers as idf
from ..operators.search import IDS
from ..plans import lexicon as lx
from ..registry import query


@query(f"{SQL} SELECT product_id, variant_id, price_cents FROM variant WHERE variant_id IN (17000017, 5000005, 100000001) OR product_id = 42")
def j_exact(spark, d):
    return variants(spark, d).where(F.col("variant_id").isin(17000017, 5000005, 100000001) | (F.col("product_id") == 42)).select(*IDS, "price_cents")


@query(f"{SQL} SELECT v.variant_id, p.title FROM variant v JOIN product p USING (product_id) JOIN (SELECT DISTINCT user_id FROM events) e ON e.user_id = p.product_id")
def j_lookup_many(spark, d):
    """Many lookups as one join; Spark picks its kind by size."""
    asked = table(spark, d, "events").select(F.col("user_id").alias("product_id")).distinct()
    return variants(spark, d).join(products(spark, d), "product_id").join(asked, "product_id", "left_semi").select("variant_id", "title")


def _values(spark, d):
    c = table(spark, d, "customer").select(F.lit("customer").alias("field"), F.col("c_name").alias("value"), F.lit(True).alias("variant_scoped"), F.col("c_custkey").alias("id"))
    s = table(spark, d, "supplier").select(F.lit("supplier"), "s_name", F.lit(True), "s_suppkey")
    b = table(spark, d, "part").select(F.lit("brand"), "p_brand", F.lit(False), "p_partkey")
    return c.unionAll(s).unionAll(b)


_VALUES = "SELECT 'customer' AS field, c_name AS value, TRUE AS variant_scoped, c_custkey AS id FROM customer UNION ALL SELECT 'supplier', s_name, TRUE, s_suppkey FROM supplier UNION ALL SELECT 'brand', p_brand, FALSE, p_partkey FROM part"
_NORM = "lower(regexp_replace(value, '[^a-zA-Z0-9]', '', 'g'))"


@query(f"SELECT DISTINCT {_NORM} AS norm, field, id FROM ({_VALUES})")
def j_identifier_dictionary(spark, d):
    return idf.dictionary(_values(spark, d), "field", "id")


@query(f"WITH v AS ({_VALUES}), book AS (SELECT DISTINCT {_NORM} AS norm, field, id FROM v), w AS (SELECT upper(c_name) || '-' AS value FROM customer UNION ALL SELECT s_name || ' ' FROM supplier) SELECT DISTINCT w.value AS word, field, id FROM w JOIN book ON {_NORM.replace('value', 'w.value')} = norm")
def j_identifier_lookup(spark, d):
    """Every name of a customer or supplier, written another way."""
    words = table(spark, d, "customer").select(F.concat(F.upper("c_name"), F.lit("-")).alias("word")).union(table(spark, d, "supplier").select(F.concat("s_name", F.lit(" "))))
    return idf.lookup(idf.dictionary(_values(spark, d), "field", "id"), words, "field", "id")


@query(f"SELECT DISTINCT {_NORM} AS norm, field, id FROM ({_VALUES} UNION ALL SELECT 'customer', upper(c_name) || ' / new', TRUE, c_custkey FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'customer', c_name, TRUE, c_custkey FROM customer)")
def j_identifier_insert(spark, d):
    """A book that grows by values, of which some are known already."""
    c = table(spark, d, "customer")
    more = c.where("c_custkey % 3 = 0").select(F.lit("customer").alias("field"), F.concat(F.upper("c_name"), F.lit(" / new")).alias("value"), F.col("c_custkey").alias("id"))
    more = more.union(c.select(F.lit("customer"), "c_name", "c_custkey"))
    return idf.inserted(idf.dictionary(_values(spark, d), "field", "id"), more, "field", "id")


_STATS = f"""WITH v AS ({_VALUES}),
chars AS (SELECT field, id, c, count(*) AS k FROM (SELECT field, id, unnest(string_split(value, '')) AS c FROM v) GROUP BY ALL),
bits AS (SELECT field, id, -sum(k / n * log2(k / n)) AS bits FROM (SELECT *, sum(k) OVER (PARTITION BY field, id) AS n FROM chars) GROUP BY field, id),
sig AS (SELECT field, max(k) AS modal FROM (SELECT field, regexp_replace(regexp_replace(value, '[A-Za-z]', 'A', 'g'), '[0-9]', '9', 'g') AS s, count(*) AS k FROM v GROUP BY ALL) GROUP BY field),
b AS (SELECT field, count(*) AS n, count(DISTINCT {_NORM}) AS n_distinct, bool_or(variant_scoped) AS variant_scoped FROM v GROUP BY field),
e AS (SELECT field, round(avg(bits), 6) AS mean_entropy FROM bits GROUP BY field),
stats AS (SELECT field, n, n_distinct, mean_entropy, variant_scoped, round(n_distinct / n, 6) AS uniqueness, round(modal / n, 6) AS modal_share FROM b JOIN e USING (field) JOIN sig USING (field))"""


@query(f"{_STATS} SELECT * FROM stats")
def a_field_stats(spark, d):
    return idf.field_stats(_values(spark, d))


@query(f"{_STATS} SELECT field FROM stats WHERE n_distinct / n >= 0.95 AND variant_scoped AND n >= 100")
def d_identifier_fields(spark, d):
    return idf.accepted(idf.field_stats(_values(spark, d))).select("field")


@query(f"{SQL} SELECT c.variant_id FROM catalog c WHERE c.brand = 'Brand#17' AND c.product_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def j_semi_restriction(spark, d):
    bought = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("product_id"))
    return catalog(spark, d).where("brand = 'Brand#17'").join(bought, "product_id", "left_semi").select("variant_id")


_PAIRED = "WITH a AS (SELECT l_orderkey AS k, l_quantity AS x FROM lineitem WHERE l_linenumber = 1), b AS (SELECT o_orderkey AS k, o_totalprice AS y FROM orders WHERE o_orderstatus = 'F')"


@query(f"{_PAIRED} SELECT 'both' AS side, count(*) AS n FROM a JOIN b USING (k) UNION ALL SELECT 'left', count(*) FROM a ANTI JOIN b USING (k) UNION ALL SELECT 'right', count(*) FROM b ANTI JOIN a USING (k)")
def j_paired(spark, d):
    a = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("k"))
    b = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    count = lambda x, side: x.agg(F.lit(side).alias("side"), F.count("*").alias("n"))
    return count(a.join(b, "k"), "both").union(count(a.join(b, "k", "left_anti"), "left")).union(count(b.join(a, "k", "left_anti"), "right"))


@query(f"{SQL}, a AS (SELECT brand AS q, product_id FROM catalog WHERE returnflag = 'R'), b AS (SELECT brand AS q, product_id FROM catalog WHERE quantity > 45) SELECT q, sum((s = 'a')::INT)::BIGINT AS only_a, sum((s = 'b')::INT)::BIGINT AS only_b FROM (SELECT DISTINCT *, 'a' AS s FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT DISTINCT *, 'b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) GROUP BY q")
def j_set_differences(spark, d):
    """For each query, how many ids only one side has: one grouping instead of two anti-joins."""
    c = catalog(spark, d)
    sides = c.groupBy(F.col("brand").alias("q"), "product_id").agg(F.bool_or(F.col("returnflag") == "R").alias("a"), F.bool_or(F.col("quantity") > 45).alias("b"))
    return sides.where("a <> b").groupBy("q").agg(F.count_if(F.col("a")).alias("only_a"), F.count_if(F.col("b")).alias("only_b"))


@query("WITH t AS (SELECT DISTINCT p_name AS name, list_sort(list_distinct(string_split(p_name, ' '))) AS w FROM part UNION SELECT DISTINCT string_split(p_name, ' ')[2], [string_split(p_name, ' ')[2]] FROM part) SELECT DISTINCT n.name AS narrow, w.name AS wide FROM t n, t w WHERE len(list_distinct(w.w)) < len(n.w) AND list_has_all(n.w, w.w)")
def j_hyponyms(spark, d):
    part = table(spark, d, "part")
    return lx.hyponyms(part.select(F.col("p_name").alias("name")).union(part.select(F.split("p_name", " ")[1])).distinct())


@query("WITH b AS (SELECT DISTINCT lower(replace(p_brand, '#', ' ')) AS key FROM part), n AS (SELECT DISTINCT p_brand || 'x' AS name, lower(replace(p_brand, '#', ' ')) || 'x' AS own FROM part), m AS (SELECT name, key, levenshtein(own, key) AS distance FROM n, b WHERE levenshtein(own, key) <= 2) SELECT name, key, CAST(distance AS INT) AS distance FROM m QUALIFY row_number() OVER (PARTITION BY name ORDER BY distance, key) = 1")
def j_fuzzy_alias(spark, d):
    brands = table(spark, d, "part").select(F.col("p_brand").alias("brand")).distinct()
    return lx.fuzzy_aliases(brands.select(F.concat("brand", F.lit("x")).alias("name")), lx.alias_groups(brands), 2)


@query(f"{SQL}, p AS (SELECT DISTINCT product_type AS key, path FROM catalog WHERE returnflag = 'R' AND quantity > 45), q AS (SELECT DISTINCT product_type AS key, path FROM catalog WHERE returnflag = 'A' AND quantity < 5) SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.l IS NOT NULL AND b.l IS NOT NULL THEN list_has_any(a.l, b.l) END AS overlap FROM (SELECT key, list(path) AS l FROM p GROUP BY key) a FULL JOIN (SELECT key, list(path) AS l FROM q GROUP BY key) b ON a.key = b.key")
def j_paths_overlap(spark, d):
    c = catalog(spark, d).select(F.col("product_type").alias("key"), "path", "returnflag", "quantity")
    return lx.paths_overlap(c.where("returnflag = 'R' and quantity > 45"), c.where("returnflag = 'A' and quantity < 5"))


@query("SELECT s_suppkey AS supplier_id, region, category, path FROM (SELECT s_suppkey, r_name AS region, n_name AS category, r_name || ' / ' || n_name AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)")
def j_categories(spark, d):
    return categories(spark, d)
