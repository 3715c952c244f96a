"""Compiling text, coverage, implications, hyponyms and other offline learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import SQL, catalog, table
from ..plans import compile as cp
from ..plans import lexicon as lx
from ..registry import query


#: Words of titles' beginnings are another attribute, so a word that is a value of both has two readings.
_TONE = "enum:tone"
#: Driver rows of a lexicon; a larger one is joined to the texts (`compile_with`).
_DRIVER_PHRASES = 1_000_000


def _profile(spark, d):
    tone = table(spark, d, "part").select(F.lit(_TONE).alias("kind"), F.split("p_name", " ")[0].alias("value"))
    return lx.profile(catalog(spark, d)).union(tone.groupBy("kind", "value").agg(F.count("*").alias("occurrences")))


def compiled(texts, readings, key: str = "text"):
    """The corpus under a lexicon of any size: broadcast while it is small, else joined to the texts."""
    if readings.count() <= _DRIVER_PHRASES:
        return cp.compile_corpus(texts, cp.lexicon_of_readings(readings.collect()))
    return cp.compile_with(texts, readings, key)


def _corpus(spark, d):
    """Texts of five forms over all words and types."""
    two = lx.shopper_queries(_profile(spark, d)).select(F.split("text", " ").alias("w"))
    w, t = F.col("w")[0], F.col("w")[1]
    forms = F.array(F.concat_ws(" ", w, t), F.concat_ws(" ", F.lit("not"), w, t), F.concat(t, F.lit(" size 9 under $150")), F.concat_ws(" ", t, F.lit("with shiny"), w), w)
    return two.select(F.explode(forms).alias("text")).distinct()


def _shown(c):
    """Constraints as texts, for rows that SQL can make as well."""
    return F.array_join(F.transform(c, lambda x: F.concat(x["attr"], F.lit("="), F.coalesce(F.array_join(x["values"], "|"), x["number"].cast("string")))), ";")


def _ir(rows, *more):
    return rows.select("text", *more, _shown(F.col("constraints")).alias("constraints"), _shown(F.col("preferences")).alias("preferences"), F.array_join(F.transform("ambiguous", lambda a: a["text"]), ";").alias("ambiguous"), F.array_join("residual", ";").alias("residual"))


def _with_profile() -> str:
    from .aggregates import _PROFILE

    return _PROFILE


_WORDS = f"""{_with_profile()}, all_ AS (SELECT * FROM profile UNION ALL SELECT '{_TONE}', string_split(p_name, ' ')[1], count(*) FROM part GROUP BY ALL),
ranked AS (SELECT lower(value) AS p, kind, value, list_position(['brand', 'product_type', 'category', 'boolean', 'enum'], string_split(kind, ':')[1]) AS r FROM all_),
lex AS (SELECT p, count(*) AS n, bool_or(kind IN ('brand', 'product_type', 'category')) AS ent,
  min(CASE WHEN kind = 'boolean:large' THEN 'large=1.0' ELSE (CASE WHEN contains(kind, ':') THEN string_split(kind, ':')[2] ELSE kind END) || '=' || value END) AS s FROM (SELECT *, max(r) OVER (PARTITION BY p) AS top FROM ranked) WHERE r = top GROUP BY p)"""
#: The compiled form of texts of known spans: x and y are the phrases in it (y may be null), bounds come after them.
_EXPECT = """SELECT text, concat_ws(';', CASE WHEN x.n = 1 AND anchored THEN x.s END, CASE WHEN y.n = 1 AND anchored THEN y.s END, bounds) AS constraints,
  concat_ws(';', CASE WHEN x.n = 1 AND NOT anchored THEN x.s END, CASE WHEN y.n = 1 AND NOT anchored THEN y.s END) AS preferences,
  concat_ws(';', CASE WHEN x.n > 1 THEN x.p END, CASE WHEN y.n > 1 THEN y.p END) AS ambiguous,
  concat_ws(';', early, CASE WHEN x.n = 1 AND NOT anchored AND x.p IS DISTINCT FROM early THEN x.p END, CASE WHEN y.n = 1 AND NOT anchored AND y.p IS DISTINCT FROM early AND (x.n IS DISTINCT FROM 1 OR y.p <> x.p) THEN y.p END) AS residual"""
_FORMS = f"""{_WORDS}, wt AS (SELECT DISTINCT lower(a.value) AS w, lower(b.value) AS t FROM all_ a, all_ b WHERE a.kind <> 'product_type' AND b.kind = 'product_type'),
forms AS (SELECT w || ' ' || t AS text, w AS px, t AS py, NULL AS early, NULL AS bounds FROM wt UNION SELECT 'not ' || w || ' ' || t, t, NULL, w, NULL FROM wt UNION SELECT t || ' size 9 under $150', t, NULL, NULL, 'size=9.0;price=15000.0' FROM wt
  UNION SELECT t || ' with shiny ' || w, t, w, 'shiny', NULL FROM wt UNION SELECT w, w, NULL, NULL, NULL FROM wt),
expected AS ({_EXPECT} FROM (SELECT forms.*, x, y, coalesce(x.n = 1 AND x.ent, FALSE) OR coalesce(y.n = 1 AND y.ent, FALSE) AS anchored FROM forms JOIN lex x ON x.p = px LEFT JOIN lex y ON y.p = py))"""


@query(f"{_FORMS} SELECT * FROM expected")
def q_compile(spark, d):
    """Texts of known spans, so SQL can say what the scan must make of them."""
    return _ir(compiled(_corpus(spark, d), lx.readings(_profile(spark, d), 1)))


@query(f"{_FORMS} SELECT * FROM expected")
def q_compile_joined(spark, d):
    """The same with the lexicon joined to the texts, as a lexicon of any size is."""
    return _ir(cp.compile_with(_corpus(spark, d), lx.readings(_profile(spark, d), 1), "text"))


_SHOP = "w AS (SELECT lower(value) AS w FROM profile WHERE kind <> 'product_type'), t AS (SELECT lower(value) AS t FROM profile WHERE kind = 'product_type')"


@query(f"{_with_profile()}, {_SHOP} SELECT w || ' ' || t AS text FROM w, t")
def q_shopper_queries(spark, d):
    return lx.shopper_queries(lx.profile(catalog(spark, d)))


@query("SELECT DISTINCT lower(p_type) || ' size ' || p_size AS text FROM part CROSS JOIN (SELECT 1) UNION SELECT DISTINCT lower(p_type) || ' under $' || CAST(floor(p_retailprice / 100) * 100 AS BIGINT) FROM part")
def q_number_queries(spark, d):
    """Types with the sizes and price bounds that occur with them."""
    part = table(spark, d, "part")
    t = F.lower("p_type")
    sized = part.select(F.concat_ws(" ", t, F.lit("size"), F.col("p_size").cast("string")).alias("text"))
    return sized.union(part.select(F.concat(t, F.lit(" under $"), (F.floor(F.col("p_retailprice") / 100) * 100).cast("string")))).distinct()


@query(f"{_FORMS} SELECT count(*) AS total, count(*) FILTER (ambiguous = '' AND residual = '') AS resolved, count(*) FILTER (ambiguous <> '') AS ambiguous, count(*) FILTER (residual <> '') AS residual FROM expected")
def q_coverage(spark, d):
    """Totals of resolved, ambiguous and residual queries."""
    return cp.coverage(compiled(_corpus(spark, d), lx.readings(_profile(spark, d), 1)))


@query(f"{_FORMS} SELECT text FROM expected WHERE ambiguous <> '' OR residual <> ''")
def q_coverage_holes(spark, d):
    return cp.holes(compiled(_corpus(spark, d), lx.readings(_profile(spark, d), 1))).select("text")


@query(f"{_FORMS} SELECT term, count(*) AS n FROM (SELECT unnest(string_split(residual, ';')) AS term FROM expected WHERE residual <> '') GROUP BY term")
def q_residual_terms(spark, d):
    return lx.residual_terms(compiled(_corpus(spark, d), lx.readings(_profile(spark, d), 1)))


@query(f"{_WORDS} SELECT p AS phrase, CAST(n AS INT) AS readings, s AS first FROM lex")
def q_lexicon_readings(spark, d):
    """The whole lexicon; a value of several attributes keeps all its readings."""
    r = lx.readings(_profile(spark, d), 1)
    shown = F.transform("readings", lambda x: F.when(x["kind"] == "boolean:large", "large=1.0").otherwise(F.concat(F.element_at(F.split(x["kind"], ":"), -1), F.lit("="), x["values"][0])))
    return r.select("phrase", F.size("readings").alias("readings"), F.array_min(shown).alias("first"))


_PAIRS = "pairs AS (SELECT DISTINCT n.name AS narrow, w.name AS wide FROM (SELECT DISTINCT p_name AS name FROM part) n, (SELECT DISTINCT string_split(p_name, ' ')[2] AS name FROM part) w WHERE list_contains(string_split(n.name, ' '), w.name)), promoted AS (SELECT * FROM pairs WHERE length(narrow) % 2 = 0)"


def _types(spark, d):
    """Title words as product types, narrow ones under wide ones."""
    part = table(spark, d, "part")
    names = part.select(F.col("p_name").alias("value")).union(part.select(F.split("p_name", " ")[1])).groupBy("value").agg(F.count("*").alias("occurrences"))
    return names.select(F.lit("product_type").alias("kind"), "value", "occurrences")


def _promoted(spark, d):
    """Every other candidate pair, after its stages."""
    from ..plans.control import promoted

    pairs = lx.hyponyms(_types(spark, d).select(F.col("value").alias("name")))
    first = pairs.select("narrow", "wide", F.lit("proposed").alias("stage"), F.lit(1).alias("version"))
    then = pairs.select("narrow", "wide", F.when(F.length("narrow") % 2 == 0, "promoted").otherwise("rejected"), F.lit(2))
    return promoted(first.union(then))


@query(f"WITH {_PAIRS} SELECT * FROM promoted")
def c_promoted_hyponyms(spark, d):
    """Pairs whose latest stage is promoted."""
    return _promoted(spark, d)


@query(f"WITH {_PAIRS}, names AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT string_split(p_name, ' ')[2] FROM part) SELECT name AS phrase, concat_ws('|', name, list_aggregate(list_sort(list(narrow)), 'string_agg', '|')) AS stands_for FROM names LEFT JOIN promoted ON wide = name GROUP BY name")
def q_lexicon_hyponyms(spark, d):
    """A wide type's phrase stands for its promoted narrower types as well."""
    r = lx.readings(_types(spark, d), 1, promoted=_promoted(spark, d))
    return r.select("phrase", F.array_join(F.col("readings")[0]["values"], "|").alias("stands_for"))


_EVIDENCE = "b AS (SELECT p_brand AS brand, count(*) AS c, bool_or(starts_with(lower(p_name), lower(split_part(p_brand, '#', 1)))) AS t FROM part GROUP BY p_brand)"


def _shop_brands(spark, d):
    """Brands of several shapes from the brand and the title's noun, with their titles."""
    part = table(spark, d, "part")
    noun = F.split("p_name", " ")[1]
    name = F.when(F.col("p_size") % 3 == 0, F.concat(F.split("p_name", " ")[0], F.lit(" "), noun)).when(F.col("p_size") % 3 == 1, F.concat(noun, F.lit(" gift shop"))).otherwise(F.col("p_brand"))
    return part.select(name.alias("brand"), F.col("p_name").alias("title"))


_SHOPS = "s AS (SELECT CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN string_split(p_name, ' ')[2] || ' gift shop' ELSE p_brand END AS brand, p_name AS title FROM part)"
_CLASS = """e AS (SELECT brand, count(*) AS c, bool_or(starts_with(lower(title), lower(brand))) AS t, len(string_split(brand, ' ')) AS n, length(regexp_replace(brand, '[^A-Za-z ]', '', 'g')) / length(brand) AS clean, contains(brand, 'gift') AS sales FROM s GROUP BY brand),
k AS (SELECT brand, c, (CASE WHEN t THEN 3 ELSE 0 END) + (CASE WHEN n <= 3 THEN 1 WHEN n >= 5 THEN -2 ELSE 0 END) + (CASE WHEN c >= 30 THEN 2 WHEN c >= 7 THEN 1 ELSE 0 END) + (CASE WHEN sales THEN -3 ELSE 0 END) AS score, clean, sales, t, n FROM e),
class AS (SELECT brand, c, CASE WHEN clean < 0.6 THEN 'junk' WHEN NOT t AND (sales OR n > 4) THEN 'lexical_only' WHEN score >= 3 THEN 'trusted' WHEN score <= -3 THEN 'junk' ELSE 'ambiguous' END AS class FROM k)"""


@query(f"WITH {_SHOPS}, {_CLASS} SELECT brand, class, CASE WHEN c >= 30 THEN 'trusted' ELSE 'junk' END AS by_frequency FROM class")
def q_brand_class(spark, d):
    """Brands judged by shape, words, titles and frequency, and by frequency alone."""
    s = _shop_brands(spark, d)
    e = lx.brand_evidence(s.groupBy("brand").agg(F.count("*").alias("count")), s)
    return e.select("brand", lx.brand_class("brand", "count", "in_titles", 30).alias("class"), lx.brand_class_by_frequency("count", 30).alias("by_frequency"))


@query(f"WITH {_SHOPS}, {_CLASS} SELECT DISTINCT lower(brand) AS phrase, 'brand' AS kind FROM class WHERE class = 'trusted' UNION SELECT DISTINCT lower(p_type), 'product_type' FROM part WHERE lower(p_type) NOT IN (SELECT lower(brand) FROM class WHERE class = 'trusted')")
def q_lexicon_trusted(spark, d):
    """A lexicon whose brands are those that the canonicaliser trusts."""
    s = _shop_brands(spark, d)
    part = table(spark, d, "part")
    brands = s.groupBy(F.lit("brand").alias("kind"), F.col("brand").alias("value")).agg(F.count("*").alias("occurrences"))
    profile = brands.union(part.groupBy(F.lit("product_type"), "p_type").agg(F.count("*")))
    r = lx.readings(profile, 1, brands=lx.trusted_brands(profile, s, 30))
    return r.select("phrase", F.col("readings")[0]["kind"].alias("kind"))


_ALIASED = "n AS (SELECT CASE WHEN p_size % 2 = 0 THEN p_name || ' Inc.' ELSE p_name END AS brand FROM part), f AS (SELECT brand FROM n GROUP BY brand HAVING count(*) >= 2), g AS (SELECT regexp_replace(regexp_replace(lower(brand), '[^a-z]+', ' ', 'g'), ' inc ?$', '') AS key, list_sort(list(brand)) AS brands FROM f GROUP BY 1)"


def _aliased(spark, d):
    part = table(spark, d, "part")
    name = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" Inc."))).otherwise(F.col("p_name"))
    return part.groupBy(F.lit("brand").alias("kind"), name.alias("value")).agg(F.count("*").alias("occurrences"))


@query(f"WITH {_ALIASED}, first AS (SELECT lower(brand) AS phrase, list_aggregate(brands, 'string_agg', '|') AS brands, CAST(NULL AS DOUBLE) AS weight FROM f JOIN g ON key = regexp_replace(regexp_replace(lower(brand), '[^a-z]+', ' ', 'g'), ' inc ?$', '')), other AS (SELECT DISTINCT p_name || 'x' AS name FROM part), near AS (SELECT name, key, brands, levenshtein(name, key) AS dist FROM other, g WHERE levenshtein(name, key) <= 2), pick AS (SELECT name, list_aggregate(brands, 'string_agg', '|') AS brands FROM near QUALIFY row_number() OVER (PARTITION BY name ORDER BY dist, key) = 1) SELECT * FROM first UNION ALL SELECT name, brands, 1.0 FROM pick WHERE name NOT IN (SELECT phrase FROM first)")
def q_lexicon_aliases(spark, d):
    """A frequent brand stands for its alias group; misspelt names prefer the nearest group."""
    misspelt = table(spark, d, "part").select(F.concat("p_name", F.lit("x")).alias("name")).distinct()
    profile = _aliased(spark, d)
    r = lx.readings(profile, 2, brands=lx.enforced_brands(profile, 2, misspelt, 2))
    return r.select("phrase", F.array_join(F.col("readings")[0]["values"], "|").alias("brands"), F.col("readings")[0]["weight"].alias("weight"))


_GRAMS = "SELECT DISTINCT p_partkey, p_brand AS brand, unnest([w[1], w[2], w[1] || ' ' || w[2]]) AS phrase FROM (SELECT p_partkey, p_brand, string_split(p_name, ' ') AS w FROM part)"
_PURE = f"g AS ({_GRAMS}), c AS (SELECT phrase, brand, count(*) AS c FROM g GROUP BY ALL), pure AS (SELECT phrase, brand, CAST(n AS BIGINT) AS occurrences, round(c / n, 6) AS purity FROM (SELECT *, sum(c) OVER (PARTITION BY phrase) AS n, row_number() OVER (PARTITION BY phrase ORDER BY c DESC, brand) AS k FROM c) WHERE k = 1)"


def _titles(spark, d):
    return table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_name").alias("title"))


@query(f"WITH {_PURE} SELECT * FROM pure")
def a_phrase_purity(spark, d):
    return lx.purity(_titles(spark, d))


#: Brands by the title's noun, so that phrases imply them: one in nine of a title's parts is of another brand.
_OWNED = "o AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 9 = 0 THEN '' WHEN p_partkey % 10 = 0 THEN p_brand ELSE 'House of ' || string_split(p_name, ' ')[2] END AS brand FROM part), g AS (SELECT p_name AS phrase, brand, count(*) AS c FROM o GROUP BY ALL), rules AS (SELECT phrase AS trigger, min(brand) AS brand FROM (SELECT *, sum(c) OVER (PARTITION BY phrase) AS n FROM g) WHERE brand <> '' AND n >= 10 AND c >= 0.8 * n GROUP BY phrase HAVING count(*) = 1)"


def _owned(spark, d):
    part, k = table(spark, d, "part"), F.col("p_partkey")
    brand = F.when(k % 9 == 0, "").when(k % 10 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("House of "), F.split("p_name", " ")[1]))
    return part.select(brand.alias("brand"), F.col("p_name").alias("title"))


@query(f"WITH {_OWNED} SELECT * FROM rules")
def c_implications(spark, d):
    """Phrases of two words that imply a brand at the production bars; the empty brand is the sentinel for none."""
    return lx.implications(lx.phrase_counts(_owned(spark, d), 2, 3))


@query(f"WITH {_OWNED}, low AS (SELECT phrase, brand FROM (SELECT *, sum(c) OVER (PARTITION BY phrase) AS n FROM g) WHERE brand <> '' AND n >= 2 AND c >= 0.05 * n) SELECT phrase AS trigger, min(brand) AS brand FROM low GROUP BY phrase HAVING count(*) = 1")
def c_implication_conflicts(spark, d):
    """At a low bar several brands pass for one trigger; such triggers are dropped."""
    return lx.implications(lx.phrase_counts(_owned(spark, d), 2, 3), 0.05, 2)


@query(f"WITH {_OWNED} SELECT p_partkey AS query_id, rules.brand FROM part JOIN rules ON p_name = trigger WHERE p_size % 4 > 0")
def c_apply_implications(spark, d):
    """Queries that name a brand themselves are left alone."""
    asked = table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", F.lit("new"), "p_name").alias("text"), (F.col("p_size") % 4 == 0).alias("has_brand"))
    rules = lx.implications(lx.phrase_counts(_owned(spark, d), 2, 3))
    return lx.apply_implications(asked.withColumn("text", F.regexp_replace("text", "^new ", "")), rules)


@query(f"{SQL} SELECT token, count(DISTINCT product_type) AS n_types FROM (SELECT product_type, unnest(words || [lower(returnflag), lower(linestatus)] || CASE WHEN large THEN ['large'] ELSE [] END) AS token FROM catalog) GROUP BY token")
def a_breadth(spark, d):
    """Words of titles, attribute values and names of true booleans by the product types they occur in."""
    return lx.breadth(catalog(spark, d))


@query(f"{SQL} SELECT token, CASE WHEN count(DISTINCT product_type) >= 2 THEN 'preferred' ELSE 'required' END AS class FROM (SELECT product_type, unnest(words || [lower(returnflag), lower(linestatus)] || CASE WHEN large THEN ['large'] ELSE [] END || ['only ' || lower(product_type)]) AS token FROM catalog) GROUP BY token")
def p_residual_class(spark, d):
    """A word that occurs in two product types or more only prefers; any other is required."""
    c = catalog(spark, d)
    own = c.select(F.concat(F.lit("only "), F.lower("product_type")).alias("token")).distinct().withColumn("n_types", F.lit(1).cast("long"))
    return lx.breadth(c).union(own).select("token", F.when(F.col("n_types") >= 2, "preferred").otherwise("required").alias("class"))


@query("WITH n AS (SELECT p_type AS span, p_brand AS reading, count(*) AS n FROM part GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY span ORDER BY n DESC, reading) AS k, lead(n) OVER (PARTITION BY span ORDER BY n DESC, reading) AS s FROM n) SELECT span, reading, round(n / greatest(s, 1), 6) AS ratio FROM x WHERE k = 1 AND s IS NOT NULL AND n / greatest(s, 1) >= 1.05")
def r_frequency_ratio(spark, d):
    n = table(spark, d, "part").groupBy(F.col("p_type").alias("span"), F.col("p_brand").alias("reading")).agg(F.count("*").alias("n"))
    return lx.spans_by_frequency(n, 1.05)


@query("SELECT DISTINCT p_brand AS brand, lower(replace(p_brand, '#', ' ')) AS key FROM part")
def q_alias_groups(spark, d):
    g = lx.alias_groups(table(spark, d, "part").select(F.col("p_brand").alias("brand")))
    return g.select(F.explode("brands").alias("brand"), "key")


@query(f"WITH {_PURE}, q AS (SELECT c_custkey AS query_id, [w[1], w[2], w[1] || ' ' || w[2]] AS g, p_brand FROM customer JOIN part ON p_partkey = c_custkey % (SELECT count(*) FROM part), LATERAL (SELECT string_split(p_name, ' ') AS w) WHERE c_custkey % 3 > 0), h AS (SELECT query_id, pure.* FROM (SELECT DISTINCT query_id, unnest(g) AS phrase FROM q) JOIN pure USING (phrase) WHERE occurrences >= 5 AND purity >= 0.06 AND phrase <> lower(brand)) SELECT query_id, brand, CASE WHEN purity >= 0.15 THEN 'filter' ELSE 'prefer' END AS tier FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY purity DESC, occurrences DESC, phrase) = 1")
def q_prefill(spark, d):
    from ..plans.control import prefill

    part = table(spark, d, "part")
    n = part.agg(F.count("*").alias("n"))
    asked = table(spark, d, "customer").crossJoin(n).join(part, F.col("p_partkey") == F.col("c_custkey") % F.col("n")).select(F.col("c_custkey").alias("query_id"), F.col("p_name").alias("text"), (F.col("c_custkey") % 3 == 0).alias("has_brand"))
    return prefill(asked, lx.purity(_titles(spark, d)), 0.15, 0.06, 5)


@query(f"{SQL}, l AS (SELECT variant_id, row_number() OVER (ORDER BY price_cents DESC, variant_id) AS place FROM catalog WHERE list_contains(words, 'red') ORDER BY place LIMIT 15), s AS (SELECT variant_id, row_number() OVER (ORDER BY price_cents DESC, variant_id) AS place FROM catalog WHERE brand = 'Brand#17' ORDER BY place LIMIT 15) SELECT variant_id, tier, place FROM (SELECT variant_id, 0 AS tier, place FROM l UNION ALL SELECT variant_id, 1, place FROM s) QUALIFY row_number() OVER (PARTITION BY variant_id ORDER BY tier, place) = 1 ORDER BY tier, place, variant_id LIMIT 20")
def p_lexical_first(spark, d):
    from pyspark.sql import Window

    from ..plans.control import lexical_first

    def top(rows):
        order = [F.desc("price_cents"), F.col("variant_id")]
        few = rows.select("variant_id", "price_cents").orderBy(*order).limit(15)
        return few.select("variant_id", F.row_number().over(Window.orderBy(*order)).alias("place"))

    c = catalog(spark, d)
    return lexical_first(top(c.where(F.array_contains("words", "red"))), top(c.where("brand = 'Brand#17'")), 20)
