"""Profiles, traffic, hierarchies and other groupings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import SQL, catalog, table, variants
from ..functions import stats as st
from ..functions.text import identifier
from ..plans import lexicon as lx
from ..registry import query

_PROFILE = f"""{SQL}, pr AS (SELECT DISTINCT product_id, brand, product_type FROM catalog),
profile AS (SELECT kind, value, count(*) AS occurrences FROM (
  SELECT 'brand' AS kind, brand AS value FROM pr UNION ALL SELECT 'product_type', product_type FROM pr UNION ALL SELECT 'category', category FROM catalog
  UNION ALL SELECT 'enum:returnflag', returnflag FROM catalog UNION ALL SELECT 'enum:linestatus', linestatus FROM catalog
  UNION ALL SELECT 'enum:words', unnest(words) FROM catalog UNION ALL SELECT 'boolean:large', 'large' FROM catalog WHERE large) WHERE value IS NOT NULL GROUP BY ALL)"""


@query(f"{_PROFILE} SELECT * FROM profile")
def a_profile(spark, d):
    return lx.profile(catalog(spark, d))


@query(f"{_PROFILE}, g AS (SELECT lower(value) AS phrase, kind, value, list_position(['brand', 'product_type', 'category', 'boolean', 'enum'], string_split(kind, ':')[1]) AS rank FROM profile WHERE NOT regexp_matches(kind, '^(brand|enum)') OR occurrences >= 20) SELECT phrase, kind, value FROM g QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY rank DESC, kind DESC, value DESC) = 1")
def q_lexicon(spark, d):
    return lx.phrases(lx.profile(catalog(spark, d)), 20)


@query(f"{SQL} SELECT max(price_cents) AS max_price, min(price_cents) AS min_price, count(DISTINCT quantity) AS quantities, count(DISTINCT size) AS sizes FROM catalog")
def a_profile_numbers(spark, d):
    return catalog(spark, d).agg(F.max("price_cents").alias("max_price"), F.min("price_cents").alias("min_price"), F.countDistinct("quantity").alias("quantities"), F.countDistinct("size").alias("sizes"))


@query("SELECT kind, count(*) AS n, sum((try_cast(v AS DOUBLE) IS NOT NULL)::INT)::BIGINT AS numeric, round(avg(len(v)), 6) AS mean_length, count(DISTINCT v) AS n_distinct, list_sort(list(DISTINCT v))[1:5] AS samples, round(count(v) / count(*), 6) AS density FROM (SELECT event_type AS kind, json_extract_string(props, '$.k') AS v FROM events) GROUP BY kind")
def a_feed_stats(spark, d):
    """Density, share of numbers and mean length of a raw feed's values; a strict pattern guards the parse."""
    v = table(spark, d, "events").select(F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").alias("v"))
    numeric = F.col("v").rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return v.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(numeric).alias("numeric"), F.round(F.avg(F.length("v")), 6).alias("mean_length"), F.countDistinct("v").alias("n_distinct"), F.round(F.count("v") / F.count("*"), 6).alias("density")).join(_samples(v, 5), "kind")


def _samples(v, n):
    """(kind, samples): the n first distinct values of each kind; a window sees distinct values, n of each task's at most."""
    some = v.where("v is not null").distinct()
    k = F.row_number().over(Window.partitionBy("kind").orderBy("v"))
    return some.withColumn("k", k).where(F.col("k") <= n).groupBy("kind").agg(F.array_sort(F.collect_list("v")).alias("samples"))


@query("WITH t AS (SELECT p_name, CASE WHEN p_size % 2 = 0 THEN upper(p_brand) ELSE p_brand END AS p_brand, CASE WHEN p_size % 7 > 0 THEN p_brand END AS nb, len(string_split(p_name, ' ')) AS w FROM part) SELECT (SELECT count(*) FROM t) AS n, (SELECT count(DISTINCT p_brand) FROM t) AS raw_brands, (SELECT count(DISTINCT lower(p_brand)) FROM t) AS brands, (SELECT count(*) FROM (SELECT p_name FROM t GROUP BY p_name HAVING count(*) > 1)) AS duplicate_titles, (SELECT quantile_cont(w, 0.5) FROM t) AS p50_words, (SELECT quantile_cont(w, 0.95) FROM t) AS p95_words, (SELECT count(*) FROM t WHERE nb IS NULL) AS null_brands, (SELECT count(*) FROM (SELECT lower(replace(p_brand, '#', '')) AS k FROM t GROUP BY k HAVING count(DISTINCT p_brand) > 1)) AS collisions")
def a_data_quality(spark, d):
    """Nulls, raw against normalised brands, colliding spellings, repeated titles, words of titles."""
    own = F.when(F.col("p_size") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand"))
    t = table(spark, d, "part").select("p_name", own.alias("p_brand"), F.when(F.col("p_size") % 7 > 0, F.col("p_brand")).alias("nb"), F.size(F.split("p_name", " ")).alias("w"))
    same = t.groupBy(identifier("p_brand").alias("k")).agg(F.countDistinct("p_brand").alias("c")).agg(F.count_if(F.col("c") > 1).alias("collisions"))
    titles = t.groupBy("p_name").agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).alias("duplicate_titles"))
    base = t.agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("raw_brands"), F.countDistinct(F.lower("p_brand")).alias("brands"), F.percentile("w", 0.5).alias("p50_words"), F.percentile("w", 0.95).alias("p95_words"), F.count_if(F.col("nb").isNull()).alias("null_brands"))
    return base.crossJoin(titles).crossJoin(same).select("n", "raw_brands", "brands", "duplicate_titles", "p50_words", "p95_words", "null_brands", "collisions")  # one row each


@query("SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, brand LIMIT 15")
def a_top_brands(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "brand").limit(15)


@query("SELECT event_type, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)")
def a_traffic_shares(spark, d):
    n = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.select("event_type", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@query("SELECT round(sum((event_type = 'purchase')::INT) / sum((event_type = 'view')::INT), 6) AS view_to_purchase, round(sum((event_type = 'click')::INT) / sum((event_type = 'view')::INT), 6) AS view_to_click FROM events")
def a_traffic_funnel(spark, d):
    n = lambda t: F.count_if(F.col("event_type") == t)
    return table(spark, d, "events").agg(F.round(n("purchase") / n("view"), 6).alias("view_to_purchase"), F.round(n("click") / n("view"), 6).alias("view_to_click"))


@query("WITH v AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT round(avg(n), 6) AS mean, median(n) AS median, max(n) AS most, round(sum(n) FILTER (k <= 15) / sum(n), 6) AS top_share FROM (SELECT *, row_number() OVER (ORDER BY n DESC, user_id) AS k FROM v)")
def a_traffic_visitors(spark, d):
    """Events a visitor, and the share of the 15 busiest, by a top-k and not a global window."""
    v = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    top = v.orderBy(F.desc("n"), "user_id").limit(15).agg(F.sum("n").alias("t"))
    all_ = v.agg(F.round(F.avg("n"), 6).alias("mean"), F.median("n").alias("median"), F.max("n").alias("most"), F.sum("n").alias("s"))
    return all_.crossJoin(top).select("mean", "median", "most", F.round(F.col("t") / F.col("s"), 6).alias("top_share"))  # one row each


@query(f"{SQL} SELECT 1 AS depth, count(DISTINCT region) AS nodes, count(region) AS covered FROM catalog UNION ALL SELECT 2, count(DISTINCT path), count(path) FROM catalog")
def a_hierarchy_profile(spark, d):
    from ..functions.text import prefix

    c = catalog(spark, d)
    deep = c.select(F.explode(F.array(F.struct(F.lit(1).alias("depth"), prefix("path", 1).alias("node")), F.struct(F.lit(2).alias("depth"), prefix("path", 2).alias("node")))).alias("x")).select("x.*")
    return deep.groupBy("depth").agg(F.countDistinct("node").alias("nodes"), F.count("node").alias("covered"))


@query(f"{SQL} SELECT round(avg((string_split(path, ' / ')[-1] = CASE WHEN product_id % 3 = 0 THEN category ELSE product_type END)::INT), 6) AS leaf_is_class, count(*) AS n FROM catalog")
def a_leaf_rate(spark, d):
    """How often the deepest level of a path names the product's class."""
    from ..functions.text import leaf

    cls = F.when(F.col("product_id") % 3 == 0, F.col("category")).otherwise(F.col("product_type"))
    return catalog(spark, d).agg(F.round(F.avg((leaf("path") == cls).cast("int")), 6).alias("leaf_is_class"), F.count("*").alias("n"))


_POINTS = ", ".join(f"round(quantile_cont(value, {p}), 6) AS p{round(p * 100)}" for p in st.POINTS)


@query(f"SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(min(value), 6) AS least, round(max(value), 6) AS most, {_POINTS} FROM events GROUP BY event_type")
def a_distribution(spark, d):
    return st.distribution(table(spark, d, "events"), "event_type", "value")


@query("SELECT event_type, round(value, 6) AS value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE k = CAST(floor((n - 1) * 0.95 + 0.5) AS BIGINT)")
def a_nearest_rank(spark, d):
    return st.nearest_rank(table(spark, d, "events"), "event_type", "value", 0.95)


_T = "CASE WHEN n <= 31 THEN [" + ", ".join(map(str, st.T95)) + "][CAST(greatest(n - 1, 1) AS INT)] ELSE 1.96 END"


@query(f"SELECT user_id, n, round(m, 6) AS mean, round({_T} * sd / sqrt(n), 6) AS half FROM (SELECT user_id, count(*) AS n, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY user_id)")
def a_mean_interval(spark, d):
    return st.mean_interval(table(spark, d, "events"), "user_id", "value")


@query(f"WITH x AS (SELECT p_type || p_size % 8 AS p_type, CASE WHEN p_size > 1 THEN ln((p_size + p_size % 8 * 4) / (p_retailprice / 50)) END AS l FROM part), s AS (SELECT p_type, count(*) AS n, avg(l) AS m, stddev_samp(l) AS sd FROM x GROUP BY p_type HAVING count(*) = count(l) AND count(*) > 1), r AS (SELECT p_type, exp(m) AS r, exp(m - {_T} * sd / sqrt(n)) AS lo, exp(m + {_T} * sd / sqrt(n)) AS hi FROM s) SELECT p_type, round(r, 6) AS ratio, round(lo, 6) AS lo, round(hi, 6) AS hi, CASE WHEN hi <= 0.75 THEN 'better' WHEN lo > 0.75 THEN 'not_better' ELSE 'open' END AS verdict FROM r")
def a_log_ratio(spark, d):
    """Groups with a pair that isn't positive have no verdict."""
    size = F.col("p_size")
    pairs = table(spark, d, "part").select(F.concat("p_type", (size % 8).cast("string")).alias("p_type"), (F.col("p_retailprice") / 50).alias("a"), F.when(size > 1, size + size % 8 * 4.0).otherwise(0.0).alias("b"))
    return st.log_ratio(pairs, "p_type", "a", "b")


@query(f"WITH s AS (SELECT user_id, count(*) AS n, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY user_id) SELECT user_id, n, round(m, 6) AS mean, CASE WHEN m > 0 THEN round({_T} * sd / sqrt(n) / m, 6) END AS rel_half, CASE WHEN m > 0 THEN round(sd / m, 6) END AS cv, n < 30 AS underpowered, coalesce(m > 0 AND {_T} * sd / sqrt(n) / m <= 0.075 AND sd / m <= 0.1, FALSE) AS passes FROM s")
def a_stable_cells(spark, d):
    """Whether each cell's mean is known well enough."""
    return st.stable_cells(table(spark, d, "events"), "user_id", "value")


@query("WITH u AS (SELECT user_id, count(*) AS d, bool_or(event_type = 'purchase') AS p FROM events GROUP BY user_id), r AS (SELECT *, row_number() OVER (ORDER BY d) - 1 AS k, count(*) OVER () AS n FROM u) SELECT round(avg(d), 6) AS mean, max(CASE WHEN k = floor((n - 1) * 0.5 + 0.5) THEN d END) AS median, max(CASE WHEN k = floor((n - 1) * 0.95 + 0.5) THEN d END) AS p95, max(d) AS most, round(1 - avg(p::INT), 6) AS abstained FROM r")
def a_depths(spark, d):
    """How many events users took, and the share that never bought."""
    u = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("d"), F.bool_or(F.col("event_type") == "purchase").alias("p"))
    return st.depths(u, "d", "p")


@query("SELECT event_type, round(avg(value) FILTER (user_id % 2 = 0) - avg(value) FILTER (user_id % 2 = 1), 6) AS difference, TRUE AS inside FROM events GROUP BY event_type")
def a_bootstrap_difference(spark, d):
    """The point is SQL's; the interval comes from this engine's hash and must hold the point."""
    e = table(spark, d, "events").withColumn("side", F.col("user_id") % 2 == 0)
    out = st.bootstrap_difference(e, "event_type", "value", "side", "event_id")
    return out.select("event_type", "difference", ((F.col("lo") < F.col("difference")) & (F.col("difference") < F.col("hi"))).alias("inside"))


@query("SELECT event_type, round(avg(value) - avg(value * 0.9 + 1), 6) AS degradation, TRUE AS inside FROM events GROUP BY event_type")
def a_degradation(spark, d):
    """What a policy loses against its baseline over the same keys."""
    e = table(spark, d, "events").select("event_type", "event_id", F.col("value").alias("base"), (F.col("value") * 0.9 + 1).alias("policy"))
    out = st.degradation(e, "event_type", "policy", "base", "event_id")
    return out.select("event_type", "degradation", ((F.col("lo") <= F.col("degradation")) & (F.col("degradation") <= F.col("hi"))).alias("inside"))


@query()
def a_bootstrap(spark, d):
    """Without SQL: the draws come from this engine's hash."""
    return st.bootstrap(table(spark, d, "events"), "event_type", "value", "event_id")


@query("SELECT user_id, round(stddev_pop(value) / avg(value), 6) AS cv, round(median(value), 6) AS median, CASE WHEN median(value) / 40 <= 0.75 THEN 'material' WHEN median(value) / 40 <= 1.25 THEN 'parity' ELSE 'worse' END AS ratio_class FROM events GROUP BY user_id")
def a_stability(spark, d):
    m = F.median("value")
    cls = F.when(m / 40 <= 0.75, "material").when(m / 40 <= 1.25, "parity").otherwise("worse")
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.stddev_pop("value") / F.avg("value"), 6).alias("cv"), F.round(m, 6).alias("median"), cls.alias("ratio_class"))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem GROUP BY l_returnflag")
def a_regression(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("intercept"))


@query("SELECT user_id, CASE WHEN m = n THEN 'unanimous' WHEN 2 * m > n THEN 'majority' ELSE 'ambiguous' END AS verdict, top FROM (SELECT user_id, max(c) AS m, CAST(sum(c) AS BIGINT) AS n, arg_max(event_type, (c, event_type)) AS top FROM (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL) GROUP BY user_id)")
def a_vote(spark, d):
    """Unanimous, majority or ambiguous; of equal counts the last name wins."""
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("c"))
    m = c.groupBy("user_id").agg(F.max("c").alias("m"), F.sum("c").alias("n"), F.max_by("event_type", F.struct("c", "event_type")).alias("top"))
    return m.select("user_id", F.when(F.col("m") == F.col("n"), "unanimous").when(2 * F.col("m") > F.col("n"), "majority").otherwise("ambiguous").alias("verdict"), "top")


@query(f"{SQL} SELECT CAST(product_id AS BIGINT) AS product_id, count(*) AS n, CAST(sum(price_cents) AS BIGINT) AS total FROM variant GROUP BY product_id")
def a_variants_per_product(spark, d):
    return variants(spark, d).groupBy("product_id").agg(F.count("*").alias("n"), F.sum("price_cents").alias("total"))


@query("WITH f AS (SELECT cap, avg((n <= cap)::INT) AS admitted, avg(CASE WHEN n <= cap THEN v END) AS mean_value FROM (SELECT user_id, count(*) AS n, avg(value) AS v FROM events GROUP BY user_id), (SELECT unnest([40, 60, 70, 80, 100]) AS cap) GROUP BY cap) SELECT cap, round(admitted, 6) AS admitted, round(mean_value, 6) AS mean_value FROM f")
def a_frontier(spark, d):
    """Coverage and value over five caps: each group goes to each cap, and is summed before the shuffle."""
    u = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("v"))
    x = u.withColumn("cap", F.explode(F.array(*map(F.lit, (40, 60, 70, 80, 100)))))
    return x.groupBy("cap").agg(F.round(F.avg((F.col("n") <= F.col("cap")).cast("int")), 6).alias("admitted"), F.round(F.avg(F.when(F.col("n") <= F.col("cap"), F.col("v"))), 6).alias("mean_value"))
