"""Scalar text functions, postings, lexical ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import SQL, catalog, categories, table
from ..functions import text as tx
from ..operators import lexical as lex
from ..registry import query



@query("SELECT c_custkey, list_filter(regexp_split_to_array(lower(c_name || '  ' || c_mktsegment), '[^a-z0-9]+'), lambda x: x <> '') AS words FROM customer")
def x_tokens(spark, d):
    return table(spark, d, "customer").select("c_custkey", tx.tokens(F.concat("c_name", F.lit("  "), "c_mktsegment")).alias("words"))


@query("SELECT c_custkey, list_filter(regexp_split_to_array(lower(' ' || c_name || '  ' || c_mktsegment), '\\s+'), lambda x: x <> '') AS words FROM customer")
def x_space_tokens(spark, d):
    return table(spark, d, "customer").select("c_custkey", tx.space_tokens(F.concat(F.lit(" "), "c_name", F.lit("  "), "c_mktsegment")).alias("words"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) WHEN 1 THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS cents FROM orders")
def x_money(spark, d):
    """With a dollar sign, without one, and not a number."""
    s = F.format_string("%.2f", "o_totalprice")
    t = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("$"), s)).when(F.col("o_orderkey") % 3 == 1, s).otherwise(F.concat(s, F.lit("d")))
    return table(spark, d, "orders").select("o_orderkey", tx.cents(t).alias("cents"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'supplier ' || s_suppkey WHEN 1 THEN 'supplier ' || s_suppkey WHEN 2 THEN 'group' ELSE 'co supplier' END AS key FROM supplier")
def x_alias_key(spark, d):
    k = F.col("s_suppkey") % 4
    name = F.when(k == 0, F.concat(F.lit("Supplier-"), "s_suppkey", F.lit(", Inc."))).when(k == 1, F.concat(F.lit("SUPPLIER "), "s_suppkey", F.lit(" Co. Ltd"))).when(k == 2, "Group LLC").otherwise("Co Supplier")
    return table(spark, d, "supplier").select("s_suppkey", tx.alias_key(name).alias("key"))


@query("SELECT c_custkey, lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) AS norm, regexp_replace(regexp_replace(c_name, '[A-Za-z]', 'A', 'g'), '[0-9]', '9', 'g') AS sig, levenshtein(c_name, c_mktsegment) AS distance FROM customer")
def x_identifier_shape(spark, d):
    return table(spark, d, "customer").select("c_custkey", tx.identifier("c_name").alias("norm"), tx.signature("c_name").alias("sig"), F.levenshtein("c_name", "c_mktsegment").cast("long").alias("distance"))


@query(f"{SQL} SELECT supplier_id, string_split(path, ' / ')[2] AS leaf, region AS top, CAST(NULL AS VARCHAR) AS third FROM category")
def x_path(spark, d):
    return categories(spark, d).select("supplier_id", tx.leaf("path").alias("leaf"), tx.prefix("path", 1).alias("top"), tx.prefix("path", 3).alias("third"))


@query("SELECT p_partkey, list_sort([w[1], w[2], w[1] || ' ' || w[2]]) AS grams FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)")
def x_ngrams(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_sort(tx.ngrams(F.split("p_name", " "), 1, 3)).alias("grams"))


@query("SELECT doc_id, CASE quality + toxic WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS gain FROM labels")
def x_gain(spark, d):
    label = F.element_at(F.array(F.lit("Irrelevant"), F.lit("Partial"), F.lit("Exact")), (F.col("quality") + F.col("toxic") + 1).cast("int"))
    return table(spark, d, "labels").select("doc_id", tx.gain(label, "three").alias("gain"))


@query("SELECT c_name, round(length(regexp_replace(c_name, '[^A-Za-z0-9 ]', '', 'g')) / length(c_name), 6) AS clean, round(length(regexp_replace(c_name, '[^A-Za-z ]', '', 'g')) / length(c_name), 6) AS like_a_name FROM customer")
def x_clean_share(spark, d):
    return table(spark, d, "customer").select("c_name", F.round(tx.clean_share("c_name"), 6).alias("clean"), F.round(tx.name_share("c_name"), 6).alias("like_a_name"))


_POST = "SELECT p_partkey AS product_id, w AS token, count(*) AS tf FROM (SELECT p_partkey, unnest(string_split(p_name || ' ' || p_type, ' ')) AS w FROM part) GROUP BY ALL"


def _posts(spark, d):
    return lex.postings(table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.concat_ws(" ", "p_name", "p_type").alias("t")), "product_id", text="t")


@query(_POST.replace("w AS token", "lower(w) AS token").replace("GROUP BY ALL", "GROUP BY 1, 2"))
def p_postings(spark, d):
    return _posts(spark, d)


@query("SELECT p_partkey AS product_id FROM part WHERE list_has_all(string_split(lower(p_name || ' ' || p_type), ' '), ['red', 'economy'])")
def p_postings_and(spark, d):
    return lex.having_all(_posts(spark, d), ["red", "economy"], "product_id")


@query("SELECT p_partkey AS product_id FROM part WHERE list_has_any(string_split(lower(p_name || ' ' || p_type), ' '), ['red', 'economy'])")
def p_postings_or(spark, d):
    return lex.having_any(_posts(spark, d), ["red", "economy"], "product_id")


@query("SELECT p_partkey AS product_id FROM part WHERE FALSE")
def p_postings_and_none(spark, d):
    """No words: nothing."""
    return lex.having_all(_posts(spark, d), [], "product_id")


@query(r"""WITH q AS (SELECT DISTINCT p_brand AS query_id, unnest(string_split(p_name || ' ' || lower(p_type), ' ')) AS token FROM part WHERE p_partkey % 100 = 0),
doc AS (SELECT p_partkey AS product_id, string_split(p_name || ' ' || lower(p_type), ' ') AS t FROM part), s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM doc),
post AS (SELECT product_id, len, token, count(*) AS tf FROM (SELECT product_id, len(t) AS len, unnest(t) AS token FROM doc) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
w AS (SELECT token, product_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a)) AS w FROM post JOIN df USING (token), s),
h AS (SELECT query_id, product_id, round(sum(w), 6) AS score FROM w JOIN q USING (token) GROUP BY ALL)
SELECT query_id, product_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS place FROM h) WHERE place <= 10""")
def p_bm25(spark, d):
    """The stated query set, parts whose id is divisible by 100, against all parts."""
    part = table(spark, d, "part")
    docs = part.select(F.col("p_partkey").alias("product_id"), F.concat_ws(" ", "p_name", "p_type").alias("t"))
    asked = part.where("p_partkey % 100 = 0").groupBy(F.col("p_brand").alias("query_id")).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "p_name", "p_type"))), " ").alias("q"))
    return lex.bm25(docs, asked, 10, doc_id="product_id", doc_text="t", query_id="query_id", query_text="q")


@query(f"{SQL} SELECT product_type, token, count(DISTINCT brand) AS brands FROM (SELECT product_type, brand, unnest(words) AS token FROM catalog) GROUP BY ALL")
def p_token_brands(spark, d):
    return catalog(spark, d).select("product_type", "brand", F.explode("words").alias("token")).groupBy("product_type", "token").agg(F.countDistinct("brand").alias("brands"))


@query("SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END WHEN 3 THEN CAST(p_size AS VARCHAR) END AS value FROM part")
def x_attribute_string(spark, d):
    """Attribute values of every kind as text; many-valued ones have none."""
    k = F.col("p_size") % 5
    kind = F.element_at(F.array(*map(F.lit, ("text", "enum", "boolean", "number", "multi"))), (k + 1).cast("int"))
    text = F.when(k == 0, F.col("p_name")).otherwise(F.col("p_brand"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), tx.attribute_string(kind, text, F.col("p_size").cast("double"), F.col("p_size") > 25).alias("value"))


@query("SELECT p_partkey AS id, p_name || ' & ' || p_brand AS decoded, replace(replace(replace(p_name || ' & ' || p_brand, ' ', '%20'), '&', '%26'), '#', '%23') AS encoded, CAST(NULL AS VARCHAR) AS broken FROM part")
def x_url_text(spark, d):
    """Texts into query strings and back; a broken escape gives nothing."""
    text = F.concat("p_name", F.lit(" & "), "p_brand")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), tx.encoded(text).alias("encoded"))
    return rows.select("id", tx.decoded(F.regexp_replace("encoded", "%20", "+")).alias("decoded"), "encoded", tx.decoded(F.concat("encoded", F.lit("%4"))).alias("broken"))


@query("SELECT p_partkey AS id, string_split(p_name, ' ') || [lower(string_split(p_brand, '#')[1]), string_split(p_brand, '#')[2]] AS tokens FROM part")
def x_residual_tokens(spark, d):
    """Leftover phrases as one list of letters-and-digits tokens."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), tx.residual_tokens(F.array("p_name", "p_brand")).alias("tokens"))


@query("WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part), v AS (SELECT w FROM w UNION SELECT w || 's' FROM w UNION SELECT w || 'es' FROM w) SELECT w.w AS one, v.w AS other, v.w = w.w OR v.w = w.w || 's' OR w.w = v.w || 's' AS same FROM w, v WHERE substr(w.w, 1, 3) = substr(v.w, 1, 3)")
def x_plurals(spark, d):
    """Words that are the same but for one s at the end."""
    w = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("one")).distinct()
    v = w.select(F.explode(F.array("one", F.concat("one", F.lit("s")), F.concat("one", F.lit("es")))).alias("other")).distinct()
    return w.join(v, F.substring("one", 1, 3) == F.substring("other", 1, 3)).select("one", "other", tx.plural_equivalent("one", "other").alias("same"))


@query(f"{SQL} SELECT variant_id, list_sort(list_distinct(string_split(lower(title), ' '))) AS tokens FROM catalog")
def r_title_tokens(spark, d):
    """The titles' tokens, as the index holds them."""
    return catalog(spark, d).select("variant_id", F.array_sort("title_tokens").alias("tokens"))
