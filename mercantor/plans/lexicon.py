"""Profiles of a catalog, the phrase lexicon, aliases and hyponyms, learned offline as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alias_key, leaf, name_share, ngrams, space_tokens, strictly_within, tokens

#: Kinds in the order in which they are inserted: a later kind replaces an earlier one's phrase.
ORDER = ("brand", "product_type", "category", "boolean", "enum")


def profile(catalog: DataFrame) -> DataFrame:
    """(kind, value, occurrences): every value that can become a phrase, with how often it occurs.

    One pass over the variants for their own values, and one over the distinct products for brands and types; both
    are summed before they are shuffled.
    """
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    single = [pair("category", F.col("category")), *(pair("enum:" + a, F.col(a)) for a in ("returnflag", "linestatus")), pair("boolean:large", F.when(F.col("large"), F.lit("large")))]
    own = F.concat(F.array(*single), F.transform("words", lambda w: pair("enum:words", w)))
    products = catalog.select("product_id", "brand", "product_type").distinct()
    of_products = products.select(F.explode(F.array(pair("brand", F.col("brand")), pair("product_type", F.col("product_type")))).alias("p"))
    count = lambda rows: rows.select("p.kind", "p.value").where("value is not null").groupBy("kind", "value").agg(F.count("*").alias("occurrences"))
    return count(catalog.select(F.explode(own).alias("p"))).union(count(of_products))


def phrases(profiled: DataFrame, min_freq: int) -> DataFrame:
    """(phrase, kind, value): one reading a phrase; brands and enum values need ``min_freq`` occurrences."""
    best = F.max_by(F.struct("kind", "value"), F.struct("rank", "kind", "value"))
    return _ranked(_gated(profiled, min_freq)).groupBy("phrase").agg(best.alias("b")).select("phrase", "b.kind", "b.value")


def _gated(profiled: DataFrame, min_freq: int, *, brands: bool = True) -> DataFrame:
    rows = profiled.where(~F.col("kind").rlike("^(brand|enum)") | (F.col("occurrences") >= min_freq))
    return rows if brands else rows.where("kind <> 'brand'")


def _ranked(rows: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.substring_index("kind", ":", 1))
    return rows.select(F.lower("value").alias("phrase"), "kind", "value", rank.alias("rank"))


#: A reading of a phrase: what it constrains (any of ``values``) or, with a weight, prefers.
READING = "struct<kind:string,values:array<string>,weight:double>"


def _reading(kind: Column, values: Column, weight: float | None = None) -> Column:
    return F.struct(kind.cast("string").alias("kind"), values.cast("array<string>").alias("values"), F.lit(weight).cast("double").alias("weight"))


def _settled(rows: DataFrame) -> DataFrame:
    """(phrase, readings) of rows (phrase, rank, reading): readings of the latest kind; more than one is ambiguous."""
    sets = rows.groupBy("phrase", "rank").agg(F.array_sort(F.collect_set("reading")).alias("readings"))
    return sets.groupBy("phrase").agg(F.max_by("readings", "rank").alias("readings"))


def readings(profiled: DataFrame, min_freq: int, *, brands: DataFrame | None = None, promoted: DataFrame | None = None) -> DataFrame:
    """(phrase, readings) of a whole lexicon.

    A later kind replaces an earlier one's phrase; an enum value of several attributes has a reading for each.
    brands: (phrase, reading) in place of the brands that occur ``min_freq`` times.  promoted: (wide, narrow) types;
    a wide type's phrase then stands for its narrower types as well.
    """
    rows = _ranked(_gated(profiled, min_freq, brands=brands is None))
    plain = rows.where("kind <> 'product_type'").select("phrase", "rank", _reading(F.col("kind"), F.array("value")).alias("reading"))
    types = rows.where("kind = 'product_type'").select("phrase", "rank", "value")
    if promoted is None:
        types = types.select("phrase", "rank", _reading(F.lit("product_type"), F.array("value")).alias("reading"))
    else:
        wider = promoted.groupBy(F.col("wide").alias("value")).agg(F.array_sort(F.collect_set("narrow")).alias("narrower"))
        all_ = F.concat(F.array("value"), F.coalesce("narrower", F.array().cast("array<string>")))
        types = types.join(wider, "value", "left").select("phrase", "rank", _reading(F.lit("product_type"), all_).alias("reading"))
    out = plain.union(types)
    if brands is not None:
        out = out.union(brands.select("phrase", F.lit(1).cast(out.schema["rank"].dataType).alias("rank"), "reading"))
    return _settled(out)


def trusted_brands(profiled: DataFrame, titles: DataFrame, trusted_count: int) -> DataFrame:
    """(phrase, reading) of the brands that shape, words, titles and frequency make structural."""
    seen = brand_evidence(profiled.where("kind = 'brand'").select(F.col("value").alias("brand"), F.col("occurrences").alias("count")), titles)
    good = seen.where(structural(brand_class("brand", "count", "in_titles", trusted_count)))
    return good.select(F.lower("brand").alias("phrase"), _reading(F.lit("brand"), F.array("brand")).alias("reading"))


def enforced_brands(profiled: DataFrame, min_freq: int, names: DataFrame | None = None, most: int = 0) -> DataFrame:
    """(phrase, reading): a frequent brand stands for all frequent brands of its alias group; other ``names`` within
    ``most`` edits of a group prefer that group's brands."""
    frequent = profiled.where((F.col("kind") == "brand") & (F.col("occurrences") >= min_freq)).select(F.col("value").alias("brand"))
    groups = alias_groups(frequent)
    first = frequent.withColumn("key", alias_key("brand")).join(groups, "key").select(F.lower("brand").alias("phrase"), _reading(F.lit("brand"), F.col("brands")).alias("reading"))
    if names is None or not most:
        return first
    others = names.select(F.lower("name").alias("name")).distinct().join(frequent.select(F.lower("brand").alias("name")), "name", "left_anti")
    near = fuzzy_aliases(others, groups, most).join(groups, "key")
    return first.union(near.select(F.col("name").alias("phrase"), _reading(F.lit("brand"), F.col("brands"), 1.0).alias("reading")))


def alias_groups(brands: DataFrame) -> DataFrame:
    """(key, brands): brand names that differ in case, marks or company endings only."""
    return brands.select(alias_key("brand").alias("key"), "brand").where("key <> ''").distinct().groupBy("key").agg(F.array_sort(F.collect_set("brand")).alias("brands"))


def _pieces(text: Column, length: Column, n: int) -> Column:
    """(number, piece) of a text cut into n pieces whose lengths follow from ``length`` alone."""
    at = lambda i: F.floor(length * i / n)
    return F.array(*[F.struct(F.lit(i).alias("i"), F.substring(text, (at(i) + 1).cast("int"), (at(i + 1) - at(i)).cast("int")).alias("piece")) for i in range(n)])


def fuzzy_aliases(names: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    """(name, key, distance): the nearest group within ``most`` edits, the smallest key among equals.

    A key is cut into most + 1 pieces; ``most`` edits leave one unharmed, and it stands in the name at its place, at
    most ``most`` characters off.  So name and key meet on (key's length, piece, number), and only pairs that share
    a piece are measured.  Keys too short for pieces meet on their length.
    """
    n = most + 1
    n_ = names.select("name", alias_key("name").alias("own")).where("own <> ''")
    keys = groups.select("key", F.length("key").cast("long").alias("len"))
    long_ = keys.where(F.col("len") >= n).select("key", "len", F.explode(_pieces(F.col("key"), F.col("len"), n)).alias("p")).select("key", "len", "p.i", "p.piece")
    lens = n_.withColumn("len", F.explode(F.sequence(F.length("own").cast("long") - most, F.length("own").cast("long") + most)))
    starts = F.array(*[F.struct(F.lit(i).alias("i"), (F.floor(F.col("len") * i / n) + 1 + s).cast("int").alias("at"), (F.floor(F.col("len") * (i + 1) / n) - F.floor(F.col("len") * i / n)).cast("int").alias("size")) for i in range(n) for s in range(-most, most + 1)])
    cut = lens.where(F.col("len") >= n).withColumn("s", F.explode(starts)).where("s.at >= 1 and s.size >= 1")
    cut = cut.select("name", "own", "len", "s.i", F.expr("substring(own, s.at, s.size)").alias("piece")).distinct()
    cand = cut.join(long_, ["len", "i", "piece"]).select("name", "own", "key").distinct()
    cand = cand.union(lens.join(keys.where(F.col("len") < n), "len").select("name", "own", "key"))
    d = F.levenshtein(F.col("own"), F.col("key"), most)
    return cand.withColumn("distance", d).where("distance >= 0").groupBy("name").agg(F.min(F.struct("distance", "key")).alias("m")).select("name", "m.key", "m.distance")


def hyponyms(names: DataFrame) -> DataFrame:
    """(narrow, wide): types whose leaf words contain all leaf words of a wider type and more.

    A wider type's words are all among the narrower one's, so the pair meets on the wider one's rarest word; a word
    that many names share is then met only by names that have no rarer one.
    """
    t = names.select(F.col("name"), F.array_sort(F.array_distinct(space_tokens(leaf("name")))).alias("w")).where("size(w) > 0")
    words = t.select("name", "w", F.explode("w").alias("word"))
    rare = words.groupBy("word").agg(F.count("*").alias("n"))
    wide = words.join(rare, "word").groupBy(F.col("name").alias("wide")).agg(F.min_by("word", F.struct("n", "word")).alias("word"), F.first("w").alias("ww"))
    narrow = words.select(F.col("name").alias("narrow"), F.col("w").alias("nw"), "word")
    return wide.join(narrow, "word").where(strictly_within(F.col("ww"), F.col("nw"))).select("narrow", "wide").distinct()


def paths_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, overlap): whether two groups' sets of paths (key, path) meet; null if either has none."""
    left, right = (x.groupBy("key").agg(F.collect_set("path").alias(n)) for x, n in ((a, "p"), (b, "q")))
    return left.join(right, "key", "full").select("key", F.arrays_overlap("p", "q").alias("overlap"))


def purity(titles: DataFrame, low: int = 1, high: int = 3) -> DataFrame:
    """(phrase, brand, occurrences, purity): for each phrase of titles its most frequent brand, the smallest name among equals."""
    rows = titles.select("brand", F.explode(F.array_distinct(ngrams(space_tokens("title"), low, high))).alias("phrase"))
    counts = rows.groupBy("phrase", "brand").agg(F.count("*").alias("c"))
    best = F.min_by(F.struct("brand", "c"), F.struct((-F.col("c")).alias("m"), "brand"))
    out = counts.groupBy("phrase").agg(best.alias("b"), F.sum("c").alias("occurrences"))
    return out.select("phrase", "b.brand", "occurrences", F.round(F.col("b.c") / F.col("occurrences"), 6).alias("purity"))


def implications(counts: DataFrame, min_purity: float = 0.8, min_occurrences: int = 10, sentinel: str = "") -> DataFrame:
    """(trigger, brand): phrases of two words or more whose occurrences are of one brand by ``min_purity`` or more.

    counts: (phrase, brand, c).  The sentinel that stands for no brand neither implies nor is implied.  Below a bar of one half several brands
    may pass it; such a trigger is in conflict and dropped.
    """
    c = counts.where(F.size(F.split("phrase", " ")) >= 2)
    whole = c.groupBy("phrase").agg(F.sum("c").alias("n"))
    good = c.where(F.col("brand") != sentinel).join(whole, "phrase").where((F.col("n") >= min_occurrences) & (F.col("c") >= min_purity * F.col("n")))
    return good.groupBy(F.col("phrase").alias("trigger")).agg(F.count("*").alias("brands"), F.min("brand").alias("brand")).where("brands = 1").drop("brands")


def phrase_counts(titles: DataFrame, low: int = 1, high: int = 3) -> DataFrame:
    """(phrase, brand, c): in how many titles of a brand a phrase occurs."""
    rows = titles.select("brand", F.explode(F.array_distinct(ngrams(space_tokens("title"), low, high))).alias("phrase"))
    return rows.groupBy("phrase", "brand").agg(F.count("*").alias("c"))


def apply_implications(queries: DataFrame, rules: DataFrame, most_words: int = 3) -> DataFrame:
    """(query_id, brand): the implied brand of a query (query_id, text, has_brand) without one, if all triggers agree."""
    asked = queries.where("not has_brand") if "has_brand" in queries.columns else queries
    hit = asked.select("query_id", F.explode(F.array_distinct(ngrams(space_tokens("text"), 2, most_words))).alias("trigger")).join(rules, "trigger")
    return hit.groupBy("query_id").agg(F.countDistinct("brand").alias("n"), F.min("brand").alias("brand")).where("n = 1").drop("n")


# Words of shop names and gifts that a trusted brand name doesn't hold.
MARKETING = (
    "gift", "gifts", "tee", "tees", "shirt", "shirts", "funny", "birthday", "anniversary", "co", "shop", "store", "apparel", "design", "designs", "custom", "print", "style", "wear",
    "lover", "lovers", "mom", "dad", "mother", "father", "hoodie", "sweatshirt", "novelty", "gag", "quote", "quotes", "saying", "sayings", "cute", "vintage", "retro", "graphic",
)


def brand_evidence(brands: DataFrame, titles: DataFrame) -> DataFrame:
    """(brand, count, in_titles): brands (brand, count) and whether a title (brand, title) of theirs begins with their name."""
    begins = titles.groupBy("brand").agg(F.bool_or(F.startswith(F.lower("title"), F.lower("brand"))).alias("in_titles"))
    return brands.join(begins, "brand", "left").select("brand", "count", F.coalesce("in_titles", F.lit(False)).alias("in_titles"))


def brand_class_by_frequency(count: str, least: int) -> Column:
    """The plain rule: trusted if frequent, else junk."""
    return F.when(F.col(count) >= least, "trusted").otherwise("junk")


def brand_class(name: str, count: str, in_titles: str, trusted_count: int) -> Column:
    """junk, lexical_only, ambiguous or trusted, by shape, words, titles and frequency."""
    n, title = F.size(space_tokens(name)), F.col(in_titles)
    sales = F.arrays_overlap(tokens(name), F.array(*map(F.lit, MARKETING)))
    score = F.when(title, 3).otherwise(0) + F.when(n.between(1, 3), 1).when(n >= 5, -2).otherwise(0) + F.when(F.col(count) >= trusted_count, 2).when(F.col(count) >= trusted_count // 4, 1).otherwise(0) + F.when(sales, -3).otherwise(0)
    return F.when(name_share(name) < 0.6, "junk").when(~title & (sales | (n > 4)), "lexical_only").when(score >= 3, "trusted").when(score <= -3, "junk").otherwise("ambiguous")


def structural(cls: Column) -> Column:
    """Whether a brand of this class may filter."""
    return cls == "trusted"


def shopper_queries(profiled: DataFrame) -> DataFrame:
    """(text): each product type with each brand, category, attribute value and boolean, in the words' order of a shopper.

    This is the generator of a corpus: every word is meant to meet every type, so its output is the product of both by
    definition.  Spark picks the side to send by its size.
    """
    types = profiled.where("kind = 'product_type'").select(F.lower("value").alias("t"))
    words = profiled.where("kind <> 'product_type'").select(F.lower("value").alias("w"))
    return words.crossJoin(types).select(F.concat_ws(" ", "w", "t").alias("text"))


def number_queries(types: DataFrame, sizes: DataFrame, prices: DataFrame) -> DataFrame:
    """(text): types (t) with sizes (size) and price bounds in dollars (dollars), by the keywords of the compiler."""
    sized = types.crossJoin(sizes).select(F.concat_ws(" ", "t", F.lit("size"), F.col("size").cast("string")).alias("text"))
    return sized.union(types.crossJoin(prices).select(F.concat(F.col("t"), F.lit(" under $"), F.col("dollars").cast("string"))))


def residual_terms(compiled: DataFrame) -> DataFrame:
    """(term, n) by falling frequency."""
    return compiled.select(F.explode("residual").alias("term")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term")


def breadth(catalog: DataFrame) -> DataFrame:
    """(token, n_types): in how many product types a word occurs; two or more make it a preferred word.

    Sources: title words without their marks, values of single- and many-valued attributes, names of true booleans.
    """
    from ..catalog import ATTRIBUTES

    own = [F.transform(F.split("title", r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]", "")))]
    for name, (col, kind) in ATTRIBUTES.items():
        if kind == "multi":
            own.append(F.transform(F.col(col), lambda v: F.lower(v)))
        elif kind == "enum" and name not in ("brand", "product_type", "category", "region"):
            own.append(F.array(F.lower(F.col(col))))
        elif kind == "boolean":
            own.append(F.when(F.col(col), F.array(F.lit(name.lower()))).otherwise(F.array().cast("array<string>")))
    words = F.array_distinct(F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<string>")) for x in own])))
    rows = catalog.select("product_type", F.explode(words).alias("token")).where("token <> ''").distinct()
    return rows.groupBy("token").agg(F.count("*").alias("n_types"))


def spans_by_frequency(readings: DataFrame, ratio: float) -> DataFrame:
    """(span, reading, ratio): the most frequent reading where it is ``ratio`` times the second or more."""
    order = Window.partitionBy("span").orderBy(F.desc("n"), "reading")
    x = readings.withColumns({"k": F.row_number().over(order), "second": F.lead("n").over(order)})
    return x.where("k = 1 and n > 0 and second is not null").withColumn("ratio", F.round(F.col("n") / F.greatest("second", F.lit(1)), 6)).where(F.col("ratio") >= ratio).select("span", "reading", "ratio")
