"""Judging queries, proposals and promotions: taxonomies, gates, canonical descriptors."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that name an occasion.
OCCASIONS = ("gift", "gifts", "birthday", "wedding", "anniversary", "christmas", "valentine", "valentines", "mother's", "mothers", "father's", "fathers", "graduation", "baby", "shower", "halloween", "thanksgiving", "easter", "housewarming", "retirement")


def occasion(words: str) -> Column:
    """Whether one of a text's lower-cased words names an occasion."""
    return F.coalesce(F.arrays_overlap(words, F.array(*map(F.lit, OCCASIONS))), F.lit(False))


def query_class(words: str, n_residual: str, n_ambiguous: str, n_entities: str, n_attributes: str, n_ranges: str, n_preferences: str) -> Column:
    """One of nine classes of a compiled query, the first that fits; without constraints and leftovers, ambiguous."""
    c = F.col
    tokens = F.greatest(F.size(words), F.lit(1))
    structural = (c(n_entities) + c(n_attributes) + c(n_ranges)) > 0
    nothing = ~structural & (c(n_preferences) == 0) & (c(n_residual) == 0)
    return (
        F.when((c(n_ambiguous) > 0) | nothing, "ambiguous")
        .when((c(n_residual) > 0) & (tokens >= 4) & (4 * c(n_residual) >= 3 * tokens), "long_tail")
        .when(structural & (c(n_residual) > 0), F.when(occasion(words), "semantic").otherwise("structural_lexical"))
        .when(c(n_ranges) > 0, "range")
        .when(c(n_attributes) > 0, "attribute")
        .when(c(n_entities) >= 2, "entities")
        .when(c(n_entities) == 1, "entity")
        .when(c(n_residual) > 0, "lexical_first")
        .otherwise("ambiguous")
    )


def query_class_7(is_id: str, words: str, n_residual: str, n_ambiguous: str, n_constraints: str) -> Column:
    """One of seven classes: a literal id, ambiguity, structure without and with leftovers, occasion, words, nothing."""
    c = F.col
    return (
        F.when(c(is_id), "id_lookup")
        .when(c(n_ambiguous) > 0, "ambiguous")
        .when(c(n_constraints) > 0, F.when(c(n_residual) > 0, "structural_lexical").otherwise("structural"))
        .when(occasion(words), "occasion")
        .when(c(n_residual) >= 2, "lexical")
        .otherwise("punt")
    )


@dataclass(frozen=True)
class Coverage:
    resolved: frozenset[str]
    total: int


def coverage_gate(base: Coverage, candidate: Coverage) -> bool:
    """No query is lost and more are resolved."""
    return base.resolved <= candidate.resolved and len(candidate.resolved) > len(base.resolved)


def precision_gate(judged: DataFrame, least: float) -> DataFrame:
    """Judged queries (query_id, shown, relevant_shown, relevant) that fail: too imprecise, or nothing found."""
    precision = F.when(F.col("shown") > 0, F.col("relevant_shown") / F.col("shown"))
    return judged.where((precision < least) | ((F.col("relevant") > 0) & (F.col("relevant_shown") == 0)))


def hyponym_verdict(known_bad: str, edge_case: str, reachable: str, overlap_1: str, overlap_2: str) -> Column:
    """Reject what is known to be bad; promote what overlaps at both levels; leave the rest open."""
    both = F.coalesce(F.col(overlap_1) & F.col(overlap_2), F.lit(False))
    return F.when(F.col(known_bad), "reject").when(F.col(edge_case) | ~F.col(reachable), "unresolved").when(both, "promote").otherwise("unresolved")


# Roles of a field, in the order that decides between equal votes.
ROLES = ("ignore", "free_text", "enum", "numeric", "boolean", "identifier", "relationship")


def plurality(votes: list[str]) -> str | None:
    """The most frequent role, the earliest listed among equals; None of no votes."""
    counts = Counter(v for v in votes if v)
    return min(counts, key=lambda r: (-counts[r], ROLES.index(r))) if counts else None


def plurality_of(votes: DataFrame) -> DataFrame:
    """(field, role) of votes (field, role), null abstains: the most frequent role, the earliest listed among equals."""
    place = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))
    counts = votes.where("role is not null").groupBy("field", "role").agg(F.count("*").alias("c"))
    return counts.groupBy("field").agg(F.max_by("role", F.struct("c", (-place).alias("p"))).alias("role"))


def first_wins(votes: DataFrame, order: str) -> DataFrame:
    """(field, role): the role with most votes, of equal ones that which was voted for first."""
    counts = votes.where("role is not null").groupBy("field", "role").agg(F.count("*").alias("c"), F.min(order).alias("first"))
    return counts.groupBy("field").agg(F.max_by("role", F.struct("c", (-F.col("first")).alias("f"))).alias("role"))


@dataclass(frozen=True)
class FieldFacts:
    parsed: float
    distinct: int
    uniqueness: float
    n: int
    variant_scoped: bool


def canonical_role(votes: list[str | None], facts: FieldFacts, conservative: bool = False) -> str | None:
    """The role that several proposals agree on, held to what the values show; None abstains."""
    given = [v for v in votes if v]
    if not given:
        return None
    role = plurality(given)
    counts = Counter(given)
    if conservative and 2 * counts[role] <= len(votes):
        return None
    if counts["enum"] and counts["numeric"]:
        role = "enum" if facts.parsed < 0.5 and facts.distinct <= 50 else "numeric" if facts.parsed >= 0.9 else None
    if role == "identifier" and not (facts.uniqueness >= 0.95 and facts.n >= 100 and facts.variant_scoped):
        role = "enum" if facts.distinct <= 50 else None
    if role == "relationship":
        role = None
    if role in ("enum", "numeric", "boolean") and facts.distinct <= 1:
        return None
    return role


def consensus(draws: list[str | None], facts: FieldFacts, budget: int) -> tuple[str | None, int]:
    """(role, draws used): more draws are taken until no unanimous continuation within the budget changes the role."""
    for k in range(1, min(len(draws), budget) + 1):
        now = canonical_role(draws[:k], facts)
        left = budget - k
        if all(canonical_role([*draws[:k], *[r] * left], facts) == now for r in (*ROLES, None)):
            return now, k
    k = min(len(draws), budget)
    return canonical_role(draws[:k], facts), k


def agreed_roles(draws: DataFrame, facts: DataFrame, budget: int) -> DataFrame:
    """(field, role, used) of draws (field, run, role): each field's draws are taken in order until they are agreed.

    A field has at most ``budget`` draws that count, so only those are gathered.
    """
    few = draws.where(F.col("run") < budget).groupBy("field").agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "role"))), lambda x: x.role).alias("votes"))

    def judge(batches):
        for pdf in batches:
            got = [consensus(list(v), FieldFacts(*map(_plain, f)), budget) for v, *f in pdf[["votes", "parsed", "distinct", "uniqueness", "n", "variant_scoped"]].itertuples(index=False)]
            yield pdf.assign(role=[r for r, _ in got], used=[k for _, k in got])[["field", "role", "used"]]

    return few.join(facts, "field").mapInPandas(judge, "field string, role string, used int")


def canonical_roles(proposals: DataFrame, facts: DataFrame) -> DataFrame:
    """(field, role) of proposals (field, run, role) and facts (field, parsed, distinct, uniqueness, n, variant_scoped).

    A field has as many proposals as there were runs, so its votes are gathered in one row.
    """
    votes = proposals.groupBy("field").agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "role"))), lambda x: x.role).alias("votes"))

    def judge(batches):
        for pdf in batches:
            yield pdf.assign(role=[canonical_role(list(v), FieldFacts(*map(_plain, f))) for v, *f in pdf[["votes", "parsed", "distinct", "uniqueness", "n", "variant_scoped"]].itertuples(index=False)])[["field", "role"]]

    return votes.join(facts, "field").mapInPandas(judge, "field string, role string")


def _plain(x):
    return x.item() if hasattr(x, "item") else x


def field_role(n: str, distinct: str, uniqueness: str, parsed: str, length: str, variant_scoped: str) -> Column:
    """A field's role by statistics alone; few values abstain."""
    c = F.col
    unique = (c(uniqueness) >= 0.95) & (c(n) >= 100) & c(variant_scoped)
    return F.when(c(n) < 30, "abstain").when(unique, "identifier").when((c(parsed) >= 0.9) & (c(distinct) > 3), "numeric").when(c(distinct) == 2, "boolean").when((c(uniqueness) < 0.3) & (c(length) <= 20), "enum").otherwise("free_text")


# Distinct values that an enum may have, and the bar of an identifier.
ENUM_VALUES, IDENTIFIER_UNIQUENESS, IDENTIFIER_VALUES = 6000, 0.95, 100
#: Operators that the engine can serve.
SERVED = ("equals", "contains", "less", "greater", "range")


def findings(role: str, value_type: str, scope: str, relationship: str, operators: str, n_aliases: str, alias_used: str, n_not_numbers: str, distinct: str, uniqueness: str, n: str) -> Column:
    """What is wrong with a proposed field; empty if nothing is.  A proposal stands unless something rejects it."""
    c = F.col
    related = c(scope) == "relationship"
    return F.array_compact(
        F.array(
            F.when((c(value_type) == "number") & (c(n_not_numbers) > 0), "reject: not a number"),
            F.when((c(role) == "enum") & (c(distinct) > ENUM_VALUES), "downgrade: too many values"),
            F.when((c(role) == "identifier") & ((c(uniqueness) < IDENTIFIER_UNIQUENESS) | (c(n) < IDENTIFIER_VALUES)), "reject: not an identifier"),
            F.when(related & c(relationship).isNull(), "reject: relationship without a meaning").when(~related & c(relationship).isNotNull(), "reject: meaning without a relationship"),
            F.when(F.size(F.array_except(operators, F.array(*map(F.lit, SERVED)))) > 0, "downgrade: operator is not served"),
            F.when((c(n_aliases) > 0) & ~c(alias_used), "downgrade: aliases are not used"),
        )
    )


def accepted(found: Column) -> Column:
    return ~F.exists(found, lambda f: f.startswith("reject"))


def type_conflict(runs: DataFrame) -> DataFrame:
    """(field, conflict): whether one run calls a field categorical and another numeric; runs (field, role), null abstains."""
    return runs.groupBy("field").agg((F.coalesce(F.bool_or(F.col("role").isin("enum", "boolean")), F.lit(False)) & F.coalesce(F.bool_or(F.col("role") == "numeric"), F.lit(False))).alias("conflict"))


def unsafe_accepted(promoted: DataFrame, truth: DataFrame) -> DataFrame:
    """The fields (field, role) promoted under another role although they are identifiers or relationships."""
    return promoted.alias("p").join(truth.alias("t"), "field").where("t.role in ('identifier', 'relationship') and not (p.role <=> t.role)").select("field")


def significant_recall(promoted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: the share of truth's significant fields (field, significant) that are promoted; 1 if there are none."""
    hit = truth.where("significant").join(promoted.select("field").distinct().withColumn("got", F.lit(1)), "field", "left")
    return hit.agg(F.round(F.coalesce(F.try_divide(F.count("got"), F.count("*")), F.lit(1.0)), 6).alias("recall"))


def by_real_key(proposals: DataFrame, shown: DataFrame) -> DataFrame:
    """Proposals (config, key, ...) under their real key: shown (config, shown_key, real_key) maps disguised ones."""
    return proposals.join(shown.withColumnRenamed("shown_key", "key"), ["config", "key"], "left").withColumn("real_key", F.coalesce("real_key", "key"))


def threshold_costs(observed: DataFrame) -> DataFrame:
    """(cut, cost): for each cut the summed cost of observations (x, below, above): below where x < cut, else above.

    Cuts are 0, infinity and the geometric middle of neighbouring x (half the upper one beside 0).  Costs are
    running sums over the distinct x, of which there are far fewer than observations; those are summed first.
    """
    bars = observed.groupBy("x").agg(F.sum("below").alias("below"), F.sum("above").alias("above"))
    order = Window.orderBy("x")
    ends = order.rowsBetween(Window.unboundedPreceding, 0)
    b = bars.withColumns({"next": F.lead("x").over(order), "b": F.sum("below").over(ends), "a": F.sum("above").over(Window.partitionBy()) - F.sum("above").over(ends)})
    middle = F.when(F.col("next").isNull(), float("inf")).when(F.col("x") > 0, F.sqrt(F.col("x") * F.col("next"))).otherwise(F.col("next") / 2)
    cuts = b.select(middle.alias("cut"), (F.col("b") + F.col("a")).alias("cost"))
    return bars.agg(F.lit(0.0).alias("cut"), F.sum("above").alias("cost")).where("cost is not null").union(cuts)


def threshold_fit(observed: DataFrame, margin: float = 0.8) -> DataFrame:
    """One row (cut, cost, crossover): the cheapest cut, the smallest among equals, or null without a crossover.

    There is one if each way is somewhere at most ``margin`` times as dear as the other.  No observations, no row.
    """
    best = threshold_costs(observed).agg(F.min(F.struct("cost", "cut")).alias("best"))
    cross = observed.agg((F.bool_or(F.col("below") <= margin * F.col("above")) & F.bool_or(F.col("above") <= margin * F.col("below"))).alias("crossover"))
    return best.crossJoin(cross).where("crossover is not null").select(F.when(F.col("crossover"), F.col("best.cut")).alias("cut"), F.round("best.cost", 6).alias("cost"), "crossover")  # one row each


# Constants of the cost model of facets and of sorting.
TAU, RHO = 919.497, 0.0834


def facet_paths(candidates, values, many_valued) -> Column:
    """`facet_path` for rows."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.when(col(many_valued) | (col(candidates) >= TAU * col(values)), "bitmap").otherwise("ordinal")


def sort_paths(candidates, window, total) -> Column:
    """`sort_path` for rows."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.when(col(candidates).cast("double") * col(candidates) >= RHO * col(window) * col(total), "presorted").otherwise("scan")


def facet_path(candidates: int, values: int, many_valued: bool, tau: float = TAU) -> str:
    """How an index would count a facet."""
    return "bitmap" if many_valued or candidates >= tau * values else "ordinal"


def sort_path(candidates: int, window: int, total: int, rho: float = RHO) -> str:
    """How an index would sort."""
    return "presorted" if candidates * candidates >= rho * window * total else "scan"
