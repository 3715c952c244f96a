"""Facet counts and the browse request: filters, alternatives, ranges, self-excluding facets, sort and page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import ATTRIBUTES
from ..model import Category, Constraint, Enum, EnumAny, Multi, Num, Request
from .predicates import all_match, where_all
from .search import page


def facet(rows: DataFrame, attr: str) -> DataFrame:
    """(facet, value, n): values of single- and many-valued attributes; a value counts once a row."""
    name, kind = ATTRIBUTES[attr]
    value = F.explode(F.array_distinct(name)) if kind == "multi" else F.col(name).cast("string")
    return rows.select(value.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n")).select(F.lit(attr).alias("facet"), "value", "n")


def whole_facet(counts: DataFrame, attr: str) -> DataFrame:
    """A facet of the whole catalog, from the counts that the index holds."""
    return counts.where(F.col("facet") == attr)


def single_valued(attr: str) -> bool:
    return ATTRIBUTES[attr][1] != "multi"


def listed(attr: str) -> bool:
    """Whether an attribute's values can be listed, as facets and filters need."""
    return ATTRIBUTES[attr][1] in ("enum", "multi")


def present(name: str) -> Column:
    """Whether a sort column has a value: neither missing nor NaN."""
    x = F.col(name).cast("double")
    return x.isNotNull() & ~F.isnan(x)


def rotations(items: DataFrame, name: str) -> DataFrame:
    """(rotation, name, place): all rotations of a list of items in their order; a schedule of n runs of n items."""
    from ..catalog import with_ordinal

    rows = with_ordinal(items.select(name), name, name="i").crossJoin(items.agg(F.count("*").alias("n")))  # one row
    starts = rows.withColumn("rotation", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return starts.select("rotation", name, F.pmod(F.col("i") - F.col("rotation"), F.col("n")).alias("place"))


def single_facet(rows: DataFrame, attr: str) -> DataFrame:
    """Facet counts of single-valued attributes; many-valued ones have none."""
    out = facet(rows, attr)
    return out.where(F.lit(False)) if ATTRIBUTES[attr][1] == "multi" else out


def filter_of(attr: str, value: str) -> Constraint:
    return Multi(attr, value) if ATTRIBUTES[attr][1] == "multi" else Enum(attr, value)


def conditions(r: Request) -> dict[str | None, list[Constraint]]:
    """Constraints by the attribute whose facet leaves them out; None: always kept (the category, extra ones)."""
    out: dict[str | None, list[Constraint]] = {None: list(r.extra)}
    if r.category is not None:
        out[None].append(Category(r.category))
    for a, v in r.filters:
        out.setdefault(a, []).append(filter_of(a, v))
    for a, vs in r.any_filters:
        out.setdefault(a, []).append(EnumAny(a, vs))
    for a, op, v in r.ranges:
        out.setdefault(a, []).append(Num(a, op, v))
    return out


def scope(r: Request, without: str | None = None) -> Column:
    return all_match([c for a, cs in conditions(r).items() if a is None or a != without for c in cs])


def in_scope(catalog: DataFrame, r: Request) -> DataFrame:
    """The rows of a request, by filters that the scan can push."""
    return where_all(catalog, [c for cs in conditions(r).values() for c in cs])


def check(catalog: DataFrame, r: Request) -> None:
    """An unknown category is an error, not an empty result."""
    if r.category is not None and catalog.where(F.col("category") == r.category).isEmpty():
        raise ValueError(f"unknown category: {r.category}")


def _entries(attrs: tuple[str, ...], counts_for) -> Column:
    """One struct (facet, values, for) for each attribute; ``counts_for`` says for whom the row's values count."""
    out = []
    for a in attrs:
        name, kind = ATTRIBUTES[a]
        values = F.array_distinct(name) if kind == "multi" else F.array(F.col(name).cast("string"))
        out.append(F.struct(F.lit(a).alias("facet"), values.alias("values"), counts_for(a).alias("for")))
    return F.array(*out)


def facets(catalog: DataFrame, r: Request) -> DataFrame:
    """All facets of a request in one pass; each is counted without its own filter.

    A row that fails the filters of one attribute only still counts for that attribute's facet, so each row bears a
    bit for each attribute it fails, and rows with two bits or more go at once.
    """
    own = conditions(r)
    groups = [a for a in own if a is not None]
    failed = reduce(lambda x, y: x.bitwiseOR(y), [F.when(all_match(own[a]), F.lit(0)).otherwise(F.lit(1 << i)).cast("long") for i, a in enumerate(groups)], F.lit(0).cast("long"))
    rows = where_all(catalog, own[None]).withColumn("_failed", failed).where(F.bit_count("_failed") <= 1)
    counts = lambda a: F.col("_failed").isin(0, 1 << groups.index(a)) if a in groups else F.col("_failed") == 0
    entries = rows.select(F.explode(F.filter(_entries(r.facets, counts), lambda e: e["for"])).alias("e"))
    return entries.select("e.facet", F.explode("e.values").alias("value")).where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))


#: Requests whose bits one number holds.
_BITS = 62


def facets_of_many(catalog: DataFrame, requests: dict[str, Request]) -> DataFrame:
    """(request, facet, value, n) of many requests in one pass over the catalog.

    For each attribute a row has a bitmask of the requests whose filters on it the row meets, so a condition is tested
    once; a facet counts for the requests in all masks but its own attribute's.  Rows are summed by facet, value and
    mask; only the few sums are then dealt out to the requests.
    """
    names = list(requests)
    attrs = tuple(sorted({a for r in requests.values() for a in r.facets}))
    chunks = [names[k : k + _BITS] for k in range(0, len(names), _BITS)]
    own = {k: conditions(r) for k, r in requests.items()}
    groups = [None, *sorted({a for c in own.values() for a in c if a is not None})]
    zero = F.lit(0).cast("long")

    def met(c: int, g: int) -> Column:
        """The chunk's requests whose conditions of the group the row meets; those without any are met."""
        free = sum(1 << i for i, k in enumerate(chunks[c]) if not own[k].get(groups[g]))
        asked = [F.when(all_match(own[k][groups[g]]), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, k in enumerate(chunks[c]) if own[k].get(groups[g])]
        return reduce(lambda x, y: x.bitwiseOR(y), asked, F.lit(free).cast("long"))

    def mask(a: str) -> Column:
        out = []
        for c, some in enumerate(chunks):
            wanted = sum(1 << i for i, k in enumerate(some) if a in requests[k].facets)
            out.append(reduce(lambda x, y: x.bitwiseAND(y), [F.col(f"_m{c}_{g}") for g, name in enumerate(groups) if name != a], F.lit(wanted).cast("long")))
        return F.array(*out)

    marked = catalog.withColumns({f"_m{c}_{g}": met(c, g) for c in range(len(chunks)) for g in range(len(groups))})
    # Rows outside every request's scope go first: categories are met by few requests.
    within = reduce(lambda x, y: x | y, [F.col(f"_m{c}_0") != zero for c in range(len(chunks))])
    rows = marked.where(within).select(F.explode(F.filter(_entries(attrs, mask), lambda e: F.exists(e["for"], lambda m: m != 0))).alias("e"))
    sums = rows.select("e.facet", F.explode("e.values").alias("value"), F.col("e.for").alias("for")).where("value is not null").groupBy("facet", "value", "for").agg(F.count("*").alias("c"))
    who = F.array(*[F.struct(F.lit(n).alias("request"), F.lit(k // _BITS).alias("at"), F.lit(1 << k % _BITS).cast("long").alias("bit")) for k, n in enumerate(names)])
    asked = F.filter(who, lambda w: F.get(F.col("for"), w["at"]).bitwiseAND(w["bit"]) != 0)
    return sums.select(F.explode(asked).alias("w"), "facet", "value", "c").groupBy(F.col("w.request").alias("request"), "facet", "value").agg(F.sum("c").alias("n"))


def browse(catalog: DataFrame, r: Request) -> dict[str, DataFrame]:
    """The count, the page of ids and the facets of a request."""
    check(catalog, r)
    rows = in_scope(catalog, r)
    return {"num_found": rows.agg(F.count("*").alias("num_found")), "docs": page(rows, r), "facets": facets(catalog, r)}


def top_values(counts: DataFrame, n: int) -> DataFrame:
    """The n most frequent values of each facet, ties by value."""
    from pyspark.sql import Window

    order = Window.partitionBy("facet").orderBy(F.desc("n"), "value")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
