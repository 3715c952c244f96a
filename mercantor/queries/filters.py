"""Filters and structural search (predicates, linear scan, candidate sets, set operations)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import SQL, catalog, effective, table
from ..model import Bool, Brand, BrandAny, Category, Enum, EnumAny, Multi, Num, PriceOver, PriceUnder, ProductType, ProductTypeAny, Query, Text
from ..operators import bitmaps as bm
from ..operators import requirements as rq
from ..operators.predicates import matches, number_matches
from ..operators.predicates import where_all as kept_all
from ..operators.search import IDS, execute
from ..plans.sql import where, where_all
from ..registry import query

#: One query for each kind of constraint, and their combinations.
CASES = {
    "f_enum": (Enum("returnflag", "R"),),
    "f_enum_any": (EnumAny("linestatus", ("F", "X")),),
    "f_multi": (Multi("words", "red"),),
    "f_multi_any": (EnumAny("words", ("red", "small")),),
    "f_boolean": (Bool("large", False),),
    "f_number_eq": (Num("size", "=", 7.0),),
    "f_number_lt": (Num("quantity", "<", 9.0),),
    "f_number_lte": (Num("quantity", "<=", 9.0),),
    "f_number_gt": (Num("quantity", ">", 48.0),),
    "f_number_gte": (Num("quantity", ">=", 48.0),),
    "f_text": (Text("title", "re"),),
    "f_type_mismatch": (Num("brand", "=", 1.0),),
    "f_unknown_attribute": (Enum("nothing", "x"),),
    "f_empty_conjunction": (),
    "f_brand": (Brand("Brand#17"),),
    "f_brand_any": (BrandAny(("Brand#12", "Brand#17", "Brand#99")),),
    "f_brand_none": (BrandAny(()),),
    "f_type": (ProductType("ECONOMY"),),
    "f_type_any": (ProductTypeAny(("ECONOMY", "PROMO")),),
    "f_category": (Category("NATION_3"),),
    "f_price_under": (PriceUnder(150000),),
    "f_price_over": (PriceOver(9000000),),
    "f_execute": (ProductType("ECONOMY"), Brand("Brand#17"), Num("quantity", "<", 10.0), PriceUnder(2000000)),
    "f_narrow_then_verify": (ProductType("PROMO"), Text("title", "e"), Enum("returnflag", "N"), PriceOver(100000)),
}
for _name, _cs in CASES.items():
    query(f"{SQL} SELECT product_id, variant_id FROM catalog WHERE {where_all(_cs)}", _name)(lambda spark, d, cs=_cs: execute(catalog(spark, d), Query(cs)))

# NaN, missing values and signed zeros: the driver's tables have none, so a few rows are made from ids.
_ODD = "CASE product_id % 5 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN NULL WHEN 2 THEN -0.0 ELSE CAST(product_id AS DOUBLE) END"


@query(f"SELECT product_id, coalesce(x > 3 AND NOT isnan(x), FALSE) AS above, coalesce(x = 0 AND NOT isnan(x), FALSE) AS zero, coalesce(x <= 10 AND NOT isnan(x), FALSE) AS low FROM (SELECT p_partkey AS product_id, {_ODD.replace('product_id', 'p_partkey')} AS x FROM part)")
def f_nan_and_missing(spark, d):
    x = F.expr(_ODD)
    part = table(spark, d, "part").select(F.col("p_partkey").alias("product_id"))
    return part.select("product_id", number_matches(x, ">", 3).alias("above"), number_matches(x, "=", 0).alias("zero"), number_matches(x, "<=", 10).alias("low"))


@query(f"{SQL} SELECT count(*) AS n, count(DISTINCT product_id) AS products FROM catalog WHERE {where_all(CASES['f_execute'])}")
def f_candidate_counts(spark, d):
    return kept_all(catalog(spark, d), CASES["f_execute"]).agg(F.count("*").alias("n"), F.countDistinct("product_id").alias("products"))


@query(f"{SQL} SELECT DISTINCT product_id FROM catalog WHERE {where(Brand('Brand#17'))}")
def f_candidate_products(spark, d):
    return kept_all(catalog(spark, d), [Brand("Brand#17")]).select("product_id").distinct()


@query(f"{SQL} SELECT product_id, variant_id FROM catalog WHERE {where(Brand('Brand#17'))} ORDER BY product_id, variant_id LIMIT 20")
def f_first_n(spark, d):
    return kept_all(catalog(spark, d), [Brand("Brand#17")]).select(*IDS).orderBy(*IDS).limit(20)


@query(f"{SQL} SELECT variant_id, row_number() OVER (ORDER BY product_id, variant_id) - 1 AS ordinal FROM variant")
def f_ordinals(spark, d):
    return catalog(spark, d).select("variant_id", "ordinal")


@query(f"{SQL} SELECT variant_id, CASE WHEN units > 1 THEN 'lot' ELSE brand END AS brand, title FROM catalog")
def f_effective_attributes(spark, d):
    """A variant's own value of an attribute wins over its product's."""
    c = catalog(spark, d)
    own = F.when(F.col("units") > 1, F.create_map(F.lit("brand"), F.lit("lot"))).otherwise(F.create_map().cast("map<string,string>"))
    both = effective(F.create_map(F.lit("brand"), F.col("brand"), F.lit("title"), F.col("title")), own)
    return c.select("variant_id", both["brand"].alias("brand"), both["title"].alias("title"))


_A, _B = (Brand("Brand#17"), Enum("returnflag", "R")), (ProductType("ECONOMY"), Enum("returnflag", "R"))


def _set(kind: str):
    def run(spark, d):
        c = catalog(spark, d)
        a, b = (kept_all(c, x).select("variant_id") for x in (_A, _B))
        return {"INTERSECT": a.intersect, "UNION": lambda y: a.union(y).distinct(), "EXCEPT": a.subtract}[kind](b)

    return run


for _kind in ("INTERSECT", "UNION", "EXCEPT"):
    query(f"{SQL} SELECT variant_id FROM catalog WHERE {where_all(_A)} {_kind} SELECT variant_id FROM catalog WHERE {where_all(_B)}", f"u_{_kind.lower()}")(_set(_kind))


@query(f"{SQL} SELECT count(*) AS n FROM catalog WHERE {where_all(_A + _B)}")
def u_intersection_count(spark, d):
    return kept_all(catalog(spark, d), _A + _B).agg(F.count("*").alias("n"))


_CUTS = "n AS (SELECT price_cents, row_number() OVER (ORDER BY price_cents) - 1 AS k, count(*) OVER () AS n FROM variant), e AS (SELECT DISTINCT price_cents AS e FROM n, range(8) r(i) WHERE k = least(n * i // 8, n - 1))"


@query(f"{SQL}, {_CUTS}, b AS (SELECT price_cents, (SELECT max(e) FROM e WHERE e <= price_cents) AS lo FROM variant) SELECT lo, count(*) AS n FROM b GROUP BY lo")
def f_price_buckets(spark, d):
    """Eight buckets of about equal numbers, each a set of bitmaps of ordinals."""
    c = catalog(spark, d)
    edges = bm.quantile_edges(c, "price_cents", 8)
    lows = F.element_at(F.array(*map(F.lit, edges)), bm.bucket(F.col("price_cents"), edges) + 1)
    bits = bm.of_values(c.withColumn("lo", lows), F.col("lo"))
    return bits.groupBy(F.col("value").cast("long").alias("lo")).agg(F.sum(F.bitmap_count("bits")).alias("n"))


@query(f"{SQL} SELECT returnflag AS value, count(*) AS n FROM catalog GROUP BY 1 UNION ALL SELECT w, count(*) FROM (SELECT unnest(words) AS w FROM catalog) GROUP BY w")
def f_bitmaps(spark, d):
    """Bitmaps of two attributes' values, counted."""
    c = catalog(spark, d)
    bits = bm.of_attribute(c, "returnflag").union(bm.of_attribute(c, "words"))
    return bits.groupBy("value").agg(F.sum(F.bitmap_count("bits")).alias("n"))


@query(f"{SQL} SELECT 'both' AS op, count(*) AS n FROM catalog WHERE returnflag = 'R' AND brand = 'Brand#17' UNION ALL SELECT 'either', count(*) FROM catalog WHERE returnflag = 'R' OR brand = 'Brand#17'")
def f_bitmap_sets(spark, d):
    """Intersection and union of stored bitmaps."""
    c = catalog(spark, d)
    a, b = bm.of_attribute(c, "returnflag").where("value = 'R'"), bm.of_attribute(c, "brand").where("value = 'Brand#17'")
    return bm.size(bm.both(a, b)).select(F.lit("both").alias("op"), "n").union(bm.size(bm.either(a, b)).select(F.lit("either"), "n"))


@query("SELECT p_partkey AS query_id, attr, value FROM (SELECT p_partkey, lower(p_name || 's under ' || p_brand) AS low FROM part), (SELECT DISTINCT 'brand' AS attr, lower(p_brand) AS value FROM part UNION SELECT DISTINCT 'words', unnest(string_split(p_name, ' ')) FROM part) WHERE len(value) >= 3 AND contains(low, value)")
def f_values_in_text(spark, d):
    """Values of three letters or more that stand anywhere in a text, inside words too."""
    part = table(spark, d, "part")
    values = part.select(F.lit("brand").alias("attr"), F.lower("p_brand").alias("value")).union(part.select(F.lit("words"), F.explode(F.split("p_name", " ")))).distinct()
    texts = part.select(F.col("p_partkey").alias("query_id"), F.concat("p_name", F.lit("s under "), "p_brand").alias("text"))
    return rq.values_in_text(texts, values)


_NEEDS = (rq.Near("size", 20.0, 5.0), rq.Between("quantity", 10.0, 30.0), rq.Between("price", None, 4000000.0), rq.Same("title", "RED-Widget"))
_MET = "(abs(size - 20) <= 5)::INT + (quantity BETWEEN 10 AND 30)::INT + (price_cents <= 4000000)::INT + (title = 'red widget')::INT"


@query(f"{SQL} SELECT variant_id, CASE {_MET} WHEN 4 THEN 'exact' WHEN 0 THEN 'none' ELSE 'partial' END AS grade FROM catalog")
def f_requirements(spark, d):
    """Near numbers, inclusive ranges and a text equal but for case and marks."""
    return catalog(spark, d).select("variant_id", rq.grade(_NEEDS).alias("grade"))


_MANY = (Enum("returnflag", "R"), Enum("returnflag", "N"), Brand("Brand#17"), Brand("Brand#12"), Multi("words", "red"))


@query(f"{SQL} SELECT variant_id FROM catalog WHERE returnflag IN ('R', 'N') AND brand IN ('Brand#17', 'Brand#12') AND list_contains(words, 'red')")
def f_or_within(spark, d):
    """Values of one attribute are alternatives; different attributes must all be met."""
    return catalog(spark, d).where(rq.or_within(_MANY)).select("variant_id")


@query("SELECT p_partkey AS id FROM part WHERE p_type = 'PROMO' AND p_size % 3 > 0")
def f_generic(spark, d):
    """Equality on a store of documents that are maps of strings."""
    fields = F.create_map(F.lit("brand"), "p_brand", F.when(F.col("p_size") % 3 > 0, "type").otherwise("kind"), "p_type")
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("id"), fields.alias("fields"))
    return rq.with_value(docs, "fields", "type", "PROMO").select("id")


@query(f"{SQL} SELECT variant_id, row_number() OVER (ORDER BY product_id, variant_id) - 1 AS ordinal, product_id FROM variant QUALIFY ordinal IN (0, 7, 100) OR variant_id = 17000017")
def j_by_ordinal(spark, d):
    """Variants by ordinal, and an ordinal by variant."""
    return catalog(spark, d).where(F.col("ordinal").isin(0, 7, 100) | (F.col("variant_id") == 17000017)).select("variant_id", "ordinal", "product_id")


_INTENT = (ProductType("ECONOMY"), Enum("returnflag", "R"), PriceUnder(2000000))


@query(f"{SQL} SELECT grade, count(*) AS n FROM (SELECT CASE {' + '.join(f'({where(c)})::INT' for c in _INTENT)} WHEN 3 THEN 'exact' WHEN 0 THEN 'none' ELSE 'partial' END AS grade FROM catalog) GROUP BY grade")
def f_grades(spark, d):
    met = sum((matches(c).cast("int") for c in _INTENT), F.lit(0))
    grade = F.when(met == len(_INTENT), "exact").when(met == 0, "none").otherwise("partial")
    return catalog(spark, d).groupBy(grade.alias("grade")).agg(F.count("*").alias("n"))
