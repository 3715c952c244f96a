"""Query classes, promotion verdicts, field proposals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import SQL, catalog, table
from ..functions import judge as jd
from ..functions.text import NUMBER, space_tokens
from ..plans import lexicon as lx
from ..registry import query
from .learning import _FORMS, _corpus, _profile, compiled
from .quality import _FIELDS


def _classified(spark, d):
    """The corpus with a gift form and literal ids, compiled, with what the taxonomies ask."""
    two = lx.shopper_queries(_profile(spark, d)).select(F.split("text", " ").alias("w"))
    gift = two.select(F.concat(F.col("w")[0], F.lit(" gift "), F.col("w")[1]).alias("text")).distinct()
    ids = table(spark, d, "part").select(F.concat(F.lit(" "), F.col("p_partkey").cast("string"), F.lit(" ")).alias("text"))
    texts = _corpus(spark, d).union(gift).union(ids)
    kind = lambda *names: F.size(F.filter("constraints", lambda c: c["kind"].isin(*names)))
    c = compiled(texts, lx.readings(_profile(spark, d), 1))
    known = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id")).distinct().withColumn("is_id", F.lit(True))
    c = c.join(known, F.trim("text") == F.col("id"), "left").withColumn("is_id", F.coalesce("is_id", F.lit(False)))
    entities, ranges = kind("Brand", "BrandAny", "ProductType", "ProductTypeAny", "Category"), kind("PriceUnder", "PriceOver")
    return c.select("text", "is_id", space_tokens("text").alias("words"), F.size("residual").alias("residual"), F.size("ambiguous").alias("ambiguous"), F.size("preferences").alias("preferences"), F.size("constraints").alias("constraints"), entities.alias("entities"), ranges.alias("ranges"), (F.size("constraints") - entities - ranges).alias("attributes"))


_TAXONOMY = _FORMS.replace("expected AS (", "forms2 AS (SELECT * FROM forms UNION SELECT w || ' gift ' || t, w, t, 'gift', NULL FROM wt), expected AS (").replace("FROM forms JOIN", "FROM forms2 AS forms JOIN") + """,
parts AS (SELECT text, FALSE AS is_id, CASE WHEN constraints = '' THEN [] ELSE string_split(constraints, ';') END AS c, CASE WHEN preferences = '' THEN 0 ELSE len(string_split(preferences, ';')) END AS p, CASE WHEN ambiguous = '' THEN 0 ELSE len(string_split(ambiguous, ';')) END AS a, CASE WHEN residual = '' THEN 0 ELSE len(string_split(residual, ';')) END AS r FROM expected
  UNION ALL SELECT ' ' || p_partkey || ' ', TRUE, [], 0, 0, 1 FROM part),
facts AS (SELECT *, len(string_split(trim(text), ' ')) AS n, contains(text, ' gift ') AS occasion, len(list_filter(c, lambda x: regexp_matches(x, '^(brand|product_type|category)='))) AS e, len(list_filter(c, lambda x: starts_with(x, 'price='))) AS g FROM parts)"""


@query(f"""{_TAXONOMY} SELECT text, CASE WHEN a > 0 OR (len(c) = 0 AND p = 0 AND r = 0) THEN 'ambiguous' WHEN r > 0 AND n >= 4 AND r / n >= 0.75 THEN 'long_tail' WHEN len(c) > 0 AND r > 0 AND occasion THEN 'semantic' WHEN len(c) > 0 AND r > 0 THEN 'structural_lexical'
  WHEN g > 0 THEN 'range' WHEN len(c) > e THEN 'attribute' WHEN e >= 2 THEN 'entities' WHEN e = 1 THEN 'entity' WHEN r > 0 THEN 'lexical_first' ELSE 'ambiguous' END AS class FROM facts""")
def q_query_class(spark, d):
    """Nine classes of compiled queries."""
    return _classified(spark, d).select("text", jd.query_class("words", "residual", "ambiguous", "entities", "attributes", "ranges", "preferences").alias("class"))


@query(f"{_TAXONOMY} SELECT text, CASE WHEN is_id THEN 'id_lookup' WHEN a > 0 THEN 'ambiguous' WHEN len(c) > 0 AND r > 0 THEN 'structural_lexical' WHEN len(c) > 0 THEN 'structural' WHEN occasion THEN 'occasion' WHEN r >= 2 THEN 'lexical' ELSE 'punt' END AS class FROM facts")
def q_query_class_7(spark, d):
    """Seven classes; a literal product id comes first."""
    return _classified(spark, d).select("text", jd.query_class_7("is_id", "words", "residual", "ambiguous", "constraints").alias("class"))


@query(f"{_TAXONOMY} SELECT text FROM facts WHERE is_id")
def q_literal_ids(spark, d):
    return _classified(spark, d).where("is_id").select("text")


@query(f"{_TAXONOMY} SELECT text, CASE WHEN a > 0 THEN 'ambiguous_span' WHEN e > 0 THEN CASE WHEN r = 0 THEN 'entity_structural' ELSE 'entity_punted' END WHEN len(c) > 0 THEN CASE WHEN r = 0 THEN 'constraint_structural' ELSE 'constraint_punted' END WHEN p = 0 THEN 'no_signal' ELSE 'demoted' END AS failure FROM facts")
def q_failure_class(spark, d):
    """What becomes of each query under a policy that sends every leftover word to the delegate."""
    from ..plans.control import failure

    c = _classified(spark, d)
    outcome = F.when(F.col("residual") == 0, "FastPath").otherwise("Punt")
    return c.select("text", failure(F.col("ambiguous"), F.col("entities"), F.col("constraints"), F.col("preferences"), outcome).alias("failure"))


_LEVELS = f"{SQL}, tp AS (SELECT DISTINCT title AS name, region, path FROM catalog UNION SELECT DISTINCT string_split(title, ' ')[2], region, path FROM catalog WHERE quantity > 49.5), pairs AS (SELECT n.name AS narrow, w.name AS wide FROM (SELECT DISTINCT p_name AS name FROM part) n, (SELECT DISTINCT string_split(p_name, ' ')[2] AS name FROM part) w WHERE string_split(n.name, ' ')[2] = w.name)"


@query(f"{_LEVELS}, o AS (SELECT narrow, wide, bool_or(a.region = b.region) AS l1, bool_or(a.path = b.path) AS l2, count(a.name) > 0 AND count(b.name) > 0 AS reachable FROM pairs LEFT JOIN tp a ON a.name = narrow LEFT JOIN tp b ON b.name = wide GROUP BY ALL) SELECT narrow, wide, CASE WHEN narrow LIKE 'hot%' THEN 'reject' WHEN narrow LIKE 'cold%' OR NOT reachable THEN 'unresolved' WHEN l1 AND l2 THEN 'promote' ELSE 'unresolved' END AS verdict FROM o")
def c_hyponym_verdicts(spark, d):
    """Pairs of narrow and wide types, judged by where their products lie at two levels of the hierarchy."""
    c = catalog(spark, d).select("title", "quantity", "region", "path")
    noun = F.split("title", " ")[1]
    lies = c.select(F.col("title").alias("name"), "region", "path").union(c.where("quantity > 49.5").select(noun, "region", "path")).distinct()
    part = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    pairs = lx.hyponyms(part.union(part.select(F.split("name", " ")[1])).distinct())
    sets = lies.groupBy("name").agg(F.collect_set("region").alias("r"), F.collect_set("path").alias("p"))
    side = lambda x: sets.select(F.col("name").alias(x), F.col("r").alias("r_" + x), F.col("p").alias("p_" + x))
    both = pairs.join(side("narrow"), "narrow", "left").join(side("wide"), "wide", "left")
    x = both.select("narrow", "wide", F.col("narrow").startswith("hot").alias("bad"), F.col("narrow").startswith("cold").alias("edge"), (F.col("r_narrow").isNotNull() & F.col("r_wide").isNotNull()).alias("reach"), F.arrays_overlap("r_narrow", "r_wide").alias("l1"), F.arrays_overlap("p_narrow", "p_wide").alias("l2"))
    return x.select("narrow", "wide", jd.hyponym_verdict("bad", "edge", "reach", "l1", "l2").alias("verdict"))


_BRANDLESS, _PLACELESS = "kind <> 'brand'", "kind <> 'category'"
_RESOLVED = f"{_FORMS}, res AS (SELECT text FROM expected WHERE ambiguous = '' AND residual = ''), used AS (SELECT text, bool_or(kind = 'brand') AS b, bool_or(kind = 'category') AS g FROM (SELECT text, px AS p FROM forms UNION ALL SELECT text, py FROM forms) JOIN ranked USING (p) GROUP BY text)"


@query(f"{_RESOLVED} SELECT (SELECT count(*) FROM forms) AS total, count(*) FILTER (g AND NOT b) AS newly, count(*) FILTER (b AND NOT g) AS regressions, CASE WHEN count_if(b AND NOT g) > 0 THEN 'regression' WHEN count_if(g AND NOT b) = 0 THEN 'no_improvement' ELSE 'promoted' END AS verdict FROM res JOIN used USING (text)")
def c_replay(spark, d):
    """A lexicon without categories is to be replaced by one without brands: what is resolved anew, and what is lost."""
    from ..plans.control import replayed, verdict

    texts, p = _corpus(spark, d), _profile(spark, d)
    base, new = (compiled(texts, lx.readings(p.where(x), 1)) for x in (_PLACELESS, _BRANDLESS))
    return verdict(replayed(base, new, "text"))


@query(f"{_RESOLVED} SELECT (SELECT count(*) FROM forms) AS total, count(*) FILTER (b) AS newly, CAST(0 AS BIGINT) AS regressions, CASE WHEN count_if(b) = 0 THEN 'no_improvement' ELSE 'promoted' END AS verdict FROM res JOIN used USING (text)")
def c_promote(spark, d):
    """A lexicon gains its brands: nothing is lost, so it is promoted."""
    from ..plans.control import replayed, verdict

    texts, p = _corpus(spark, d), _profile(spark, d)
    return verdict(replayed(compiled(texts, lx.readings(p.where(_BRANDLESS), 1)), compiled(texts, lx.readings(p, 1)), "text"))


@query("SELECT user_id AS query_id, count(*) AS shown, CAST(sum((event_type = 'purchase')::INT) AS BIGINT) AS relevant_shown, 1 AS relevant FROM events GROUP BY user_id HAVING sum((event_type = 'purchase')::INT) / count(*) < 0.2 OR sum((event_type = 'purchase')::INT) = 0")
def c_precision_failures(spark, d):
    x = table(spark, d, "events").groupBy(F.col("user_id").alias("query_id")).agg(F.count("*").alias("shown"), F.count_if(F.col("event_type") == "purchase").alias("relevant_shown")).withColumn("relevant", F.lit(1))
    return jd.precision_gate(x, 0.2)


#: Proposed fields: name, role, value type, scope, relationship, operators, aliases.
_PROPOSALS = (
    ("c_name", "identifier", "text", "variant", None, ("equals",), ("customer",)),
    ("c_mktsegment", "enum", "text", "product", None, ("equals", "near"), ()),
    ("p_size", "numeric", "number", "variant", None, ("less", "greater"), ("small",)),
    ("l_linestatus", "identifier", "text", "variant", None, ("equals",), ()),
    ("text", "enum", "number", "product", None, ("contains",), ("gizmo", "nowhere")),
    ("r_name", "relationship", "text", "relationship", None, (), ()),
    ("p_name", "enum", "text", "product", "made with", ("equals",), ()),
    ("c_name", "enum", "text", "variant", None, ("equals",), ("nowhere",)),
)


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


_PROPOSED = " UNION ALL ".join(f"SELECT {i} AS proposal, '{f}' AS field, '{r}' AS role, '{t}' AS value_type, '{s}' AS scope, {'NULL' if m is None else repr(m)} AS relationship, {_list(o)} AS operators, {_list(a)} AS aliases" for i, (f, r, t, s, m, o, a) in enumerate(_PROPOSALS))


@query(f"""WITH p AS ({_PROPOSED}), f AS ({_FIELDS} UNION ALL SELECT 'p_name', p_name, FALSE FROM part), s AS (SELECT field, count(*) AS n, count(DISTINCT v) AS k, count_if(try_cast(v AS DOUBLE) IS NULL) AS words FROM f GROUP BY field),
used AS (SELECT proposal, bool_or(contains(p_name, alias)) AS used FROM (SELECT proposal, unnest(aliases) AS alias FROM p), part GROUP BY proposal)
SELECT proposal, list_filter([CASE WHEN value_type = 'number' AND words > 0 THEN 'reject: not a number' END, CASE WHEN role = 'enum' AND k > 6000 THEN 'downgrade: too many values' END, CASE WHEN role = 'identifier' AND (k / n < 0.95 OR n < 100) THEN 'reject: not an identifier' END,
  CASE WHEN scope = 'relationship' AND relationship IS NULL THEN 'reject: relationship without a meaning' WHEN scope <> 'relationship' AND relationship IS NOT NULL THEN 'reject: meaning without a relationship' END,
  CASE WHEN list_contains(operators, 'near') THEN 'downgrade: operator is not served' END, CASE WHEN len(aliases) > 0 AND NOT coalesce(used, FALSE) THEN 'downgrade: aliases are not used' END], lambda x: x IS NOT NULL) AS findings FROM p JOIN s USING (field) LEFT JOIN used USING (proposal)""")
def d_findings(spark, d):
    """Proposed fields held against the statistics of all their values and against the texts that shoppers use."""
    from .quality import fields

    p = spark.createDataFrame([(i, *x[:5], list(x[5]), list(x[6])) for i, x in enumerate(_PROPOSALS)], "proposal int, field string, role string, value_type string, scope string, relationship string, operators array<string>, aliases array<string>")
    rows = fields(spark, d).unionAll(table(spark, d, "part").select(F.lit("p_name"), "p_name", F.lit(False)))
    number = F.col("v").rlike(NUMBER)
    s = rows.groupBy("field").agg(F.count("*").alias("n"), F.countDistinct("v").alias("k"), F.count_if(~number).alias("not_numbers")).withColumn("uniqueness", F.col("k") / F.col("n"))
    named = p.select("proposal", F.explode("aliases").alias("alias"))
    used = table(spark, d, "part").select(F.explode(F.array_distinct(space_tokens("p_name"))).alias("alias")).distinct().join(named, "alias").select("proposal").distinct().withColumn("used", F.lit(True))
    x = p.join(s, "field").join(used, "proposal", "left").withColumns({"used": F.coalesce("used", F.lit(False)), "n_aliases": F.size("aliases")})
    return x.select("proposal", jd.findings("role", "value_type", "scope", "relationship", "operators", "n_aliases", "used", "not_numbers", "k", "uniqueness", "n").alias("findings"))


_ROLE_RUNS = "r AS (SELECT p_type AS field, p_brand AS run, CASE WHEN avg(p_size) > 27 THEN 'numeric' WHEN avg(p_size) < 23 THEN 'enum' WHEN avg(p_size) < 24 THEN NULL ELSE 'free_text' END AS role FROM part GROUP BY ALL)"


def _runs(spark, d):
    m = F.avg("p_size")
    role = F.when(m > 27, "numeric").when(m < 23, "enum").when(m < 24, None).otherwise("free_text")
    return table(spark, d, "part").groupBy(F.col("p_type").alias("field"), F.col("p_brand").alias("run")).agg(role.alias("role"))


@query(f"WITH {_ROLE_RUNS} SELECT field, coalesce(bool_or(role IN ('enum', 'boolean')), FALSE) AND coalesce(bool_or(role = 'numeric'), FALSE) AS conflict FROM r GROUP BY field")
def d_type_conflict(spark, d):
    """Whether two runs call a field categorical and numeric."""
    return jd.type_conflict(_runs(spark, d))


_TRUTH = "t AS (SELECT p_brand AS field, CASE count(*) % 4 WHEN 0 THEN 'identifier' WHEN 1 THEN 'relationship' WHEN 2 THEN 'enum' ELSE 'numeric' END AS role, count(*) % 3 > 0 AS significant FROM part GROUP BY p_brand), p AS (SELECT p_brand AS field, CASE WHEN avg(p_size) > 25 THEN 'enum' ELSE 'identifier' END AS role FROM part GROUP BY p_brand HAVING count(*) % 5 > 0)"


def _truth(spark, d):
    part, n = table(spark, d, "part"), F.count("*")
    truth = part.groupBy(F.col("p_brand").alias("field")).agg(F.element_at(F.array(*map(F.lit, ("identifier", "relationship", "enum", "numeric"))), (n % 4 + 1).cast("int")).alias("role"), (n % 3 > 0).alias("significant"))
    promoted = part.groupBy(F.col("p_brand").alias("field")).agg(F.when(F.avg("p_size") > 25, "enum").otherwise("identifier").alias("role"), n.alias("n")).where("n % 5 > 0").drop("n")
    return promoted, truth


@query(f"WITH {_TRUTH} SELECT field FROM p JOIN t USING (field) WHERE t.role IN ('identifier', 'relationship') AND p.role <> t.role")
def a_unsafe_accepted(spark, d):
    """Fields promoted under another role although they are identifiers or relationships."""
    return jd.unsafe_accepted(*_truth(spark, d))


@query(f"WITH {_TRUTH} SELECT round(count(p.field) / count(*), 6) AS recall FROM t LEFT JOIN p USING (field) WHERE significant")
def a_significant_recall(spark, d):
    return jd.significant_recall(*_truth(spark, d))


@query("SELECT config, key, real_key, count(*) AS proposals FROM (SELECT CASE WHEN p_size % 2 = 0 THEN 'disguised' ELSE 'plain' END AS config, CASE WHEN p_size % 2 = 0 THEN lower(replace(p_brand, '#', '_')) ELSE p_brand END AS key, p_brand AS real_key FROM part) GROUP BY ALL")
def j_real_keys(spark, d):
    """Proposals of two configurations under their real keys; only one configuration disguises them."""
    part = table(spark, d, "part")
    even, hidden = F.col("p_size") % 2 == 0, F.lower(F.replace("p_brand", F.lit("#"), F.lit("_")))
    proposals = part.select(F.when(even, "disguised").otherwise("plain").alias("config"), F.when(even, hidden).otherwise(F.col("p_brand")).alias("key"))
    shown = part.select(F.lit("disguised").alias("config"), hidden.alias("shown_key"), F.col("p_brand").alias("real_key")).distinct()
    return jd.by_real_key(proposals, shown).groupBy("config", "key", "real_key").agg(F.count("*").alias("proposals"))


@query("WITH o AS (SELECT user_id AS x, avg(value) AS below, count(*) * 0.6 AS above FROM events GROUP BY user_id), cuts AS (SELECT 0.0 AS cut UNION ALL SELECT CASE WHEN n IS NULL THEN 'Infinity'::DOUBLE WHEN x > 0 THEN sqrt(x * n) ELSE n / 2 END FROM (SELECT x, lead(x) OVER (ORDER BY x) AS n FROM o)), c AS (SELECT cut, sum(CASE WHEN x < cut THEN below ELSE above END) AS cost FROM cuts, o GROUP BY cut), best AS (SELECT cut, cost FROM c ORDER BY round(cost, 9), cut LIMIT 1) SELECT CASE WHEN crossover THEN round(cut, 6) END AS cut, round(cost, 6) AS cost, crossover FROM best, (SELECT bool_or(below <= 0.8 * above) AND bool_or(above <= 0.8 * below) AS crossover FROM o)")
def a_threshold_fit(spark, d):
    """The cut between two ways of answering that costs least over all observations."""
    e = table(spark, d, "events").groupBy(F.col("user_id").cast("double").alias("x")).agg(F.avg("value").alias("below"), (F.count("*") * 0.6).alias("above"))
    return jd.threshold_fit(e).withColumn("cut", F.round("cut", 6))


def _field_votes(spark, d):
    """A field for each brand and type, with the votes and facts of all its parts."""
    part = table(spark, d, "part")
    field = F.concat_ws(" ", "p_brand", "p_type").alias("field")
    votes = part.select(field, F.col("p_partkey").alias("run"), F.element_at(F.array(*map(F.lit, jd.ROLES)), (F.col("p_size") % 7 + 1).cast("int")).alias("role"))
    n = F.count("*")
    facts = part.groupBy(field).agg((F.avg("p_size") / 50).alias("parsed"), F.countDistinct("p_size").alias("distinct"), (F.countDistinct("p_name") / n).alias("uniqueness"), n.alias("n"), (2 * F.count_if(F.col("p_size") % 2 == 0) >= n).alias("variant_scoped"))
    return votes, facts


_VOTES = f"v AS (SELECT p_brand || ' ' || p_type AS field, p_partkey AS run, list_extract({_list(jd.ROLES)}, p_size % 7 + 1) AS role, p_size % 7 AS place FROM part)"


@query(f"WITH {_VOTES}, c AS (SELECT field, role, place, count(*) AS c FROM v GROUP BY ALL) SELECT field, arg_max(role, 100 * c - place) AS role FROM c GROUP BY field")
def a_plurality(spark, d):
    """The role with most votes of each field, the earliest listed among equals."""
    return jd.plurality_of(_field_votes(spark, d)[0])


@query(f"WITH {_VOTES}, c AS (SELECT field, role, count(*) AS c, min(run) AS first FROM v GROUP BY ALL) SELECT field, role FROM c QUALIFY row_number() OVER (PARTITION BY field ORDER BY c DESC, first) = 1")
def a_first_wins(spark, d):
    """The role with most votes of each field, of equal ones the one voted for first."""
    return jd.first_wins(_field_votes(spark, d)[0], "run")


#: Roles by SQL: the plurality, held to the facts in the order of the rules.
_CANON = f"""WITH {_VOTES}, c AS (SELECT field, role, place, count(*) AS c FROM v GROUP BY ALL), p AS (SELECT field, arg_max(role, 100 * c - place) AS role, bool_or(role = 'enum') AND bool_or(role = 'numeric') AS contested FROM c GROUP BY field),
f AS (SELECT p_brand || ' ' || p_type AS field, avg(p_size) / 50 AS parsed, count(DISTINCT p_size) AS k, count(DISTINCT p_name) / count(*) AS u, count(*) AS n, 2 * count_if(p_size % 2 = 0) >= count(*) AS scoped FROM part GROUP BY 1),
a AS (SELECT *, CASE WHEN contested THEN CASE WHEN parsed < 0.5 AND k <= 50 THEN 'enum' WHEN parsed >= 0.9 THEN 'numeric' END ELSE role END AS r1 FROM p JOIN f USING (field)),
b AS (SELECT *, CASE WHEN r1 = 'identifier' AND NOT (u >= 0.95 AND n >= 100 AND scoped) THEN CASE WHEN k <= 50 THEN 'enum' END WHEN r1 = 'relationship' THEN NULL ELSE r1 END AS r2 FROM a)
SELECT field, CASE WHEN r2 IN ('enum', 'numeric', 'boolean') AND k <= 1 THEN NULL ELSE r2 END AS role FROM b"""


@query(_CANON)
def d_canonical_roles(spark, d):
    """The role that all votes of a field give, held to what its values show."""
    return jd.canonical_roles(*_field_votes(spark, d))


@query()
def d_agreed_roles(spark, d):
    """Without SQL: draws are added until no continuation changes the role; unit cases test it."""
    from pyspark.sql import Window

    votes, facts = _field_votes(spark, d)
    numbered = votes.withColumn("run", F.row_number().over(Window.partitionBy("field").orderBy("run")) - 1)
    return jd.agreed_roles(numbered, facts, 9)
