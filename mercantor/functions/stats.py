"""Statistics of measurements: distributions, intervals, ratios, relevance metrics."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Two-sided 95 % points of Student's t by degrees of freedom, 1 to 30; beyond, the normal value.
T95 = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042)
Z95 = 1.960
POINTS = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def distribution(rows: DataFrame, group: str, value: str) -> DataFrame:
    """n, mean, sample deviation, minimum, interpolated percentiles and maximum of each group."""
    points = F.percentile(value, list(POINTS))
    out = rows.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"), points.alias("p"))
    named = {f"p{round(p * 100)}": F.round(F.col("p")[k], 6) for k, p in enumerate(POINTS)}
    return out.select(group, "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round("least", 6).alias("least"), F.round("most", 6).alias("most"), *[c.alias(n) for n, c in named.items()])


def nearest_rank(rows: DataFrame, group: str, value: str, p: float) -> DataFrame:
    """The value at place round((n - 1) p) of each group, halves up.

    Equal values are summed before anything is ordered, and a group's places are counted in two levels (ranges of
    values, then values inside the one range that holds the place), so no task orders a whole group.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    edges = counts.groupBy(group).agg(F.sum("c").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    near = counts.join(edges, group)
    width = (F.col("most") - F.col("least")) / 1024.0
    near = near.withColumn("bar", F.when(width > 0, F.least(F.floor((F.col("v") - F.col("least")) / width), F.lit(1023))).otherwise(0))
    bars = near.groupBy(group, "bar").agg(F.sum("c").alias("bc"), F.first("n").alias("n"))
    by_bar = Window.partitionBy(group).orderBy("bar").rowsBetween(Window.unboundedPreceding, -1)
    place = F.floor((F.col("n") - 1) * p + 0.5)
    bars = bars.withColumn("before", F.coalesce(F.sum("bc").over(by_bar), F.lit(0))).where((F.col("before") <= place) & (place < F.col("before") + F.col("bc")))
    inside = near.join(bars.select(group, "bar", "before"), [group, "bar"])
    by_value = Window.partitionBy(group).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ends = inside.withColumn("end", F.col("before") + F.sum("c").over(by_value)).where(F.col("end") > place)
    return ends.groupBy(group).agg(F.round(F.min("v"), 6).alias("value"))


def t_point(n: Column) -> Column:
    return F.when(n <= len(T95) + 1, F.element_at(F.array(*map(F.lit, T95)), F.greatest(n - 1, F.lit(1)).cast("int"))).otherwise(Z95)


def mean_interval(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, mean, half): mean and half width of its 95 % interval."""
    out = rows.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return out.select(group, "n", F.round("mean", 6).alias("mean"), F.round(t_point(F.col("n")) * F.col("sd") / F.sqrt("n"), 6).alias("half"))


#: Bits of a row's number in a round.
_DRAW_BITS = 30


def _draws(h: Column) -> Column:
    """How often a row counts in a round: a Poisson(1) number for a number of ``_DRAW_BITS`` random bits.

    The likeliest numbers are tested first, so few tests are made.
    """
    out, total = None, 0.0
    for k in range(8):
        total += math.exp(-1) / math.factorial(k)
        below, n = h < F.lit(int(total * (1 << _DRAW_BITS))), F.lit(k).cast("long")
        out = F.when(below, n) if out is None else out.when(below, n)
    return out.otherwise(F.lit(8).cast("long"))


#: Rounds that one copy of a row serves: with their sums fewer columns than generated code may have.
_AT_ONCE = 10


def resampled(rows: DataFrame, group: str, sums: dict[str, Column], id_col: str, rounds: int, seed: int) -> DataFrame:
    """(group, round, n, one sum for each of ``sums``): Poisson resampling, which needs no group in one place.

    ``_AT_ONCE`` rounds are columns of one partial aggregate; only the few columns that the sums need are copied for
    the other rounds, and only sums are shuffled.
    """
    own = rows.select(F.col(group), F.col(id_col).alias("_id"), *[c.cast("double").alias(f"_v_{n}") for n, c in sums.items()])
    blocks = own.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(-(-rounds // _AT_ONCE) - 1))))
    drawn = lambda j: F.shiftrightunsigned(F.xxhash64("_id", F.col("_b") * _AT_ONCE + j, F.lit(seed)), 64 - _DRAW_BITS)
    t = blocks.withColumns({f"_h{j}": drawn(j) for j in range(_AT_ONCE)}).withColumns({f"_t{j}": _draws(F.col(f"_h{j}")) for j in range(_AT_ONCE)})
    made = [F.sum(f"_t{j}").alias(f"n_{j}") for j in range(_AT_ONCE)]
    made += [F.sum(F.col(f"_t{j}") * F.col(f"_v_{n}")).alias(f"{n}_{j}") for n in sums for j in range(_AT_ONCE)]
    wide = t.groupBy(group, "_b").agg(*made)
    parts = [F.struct((F.col("_b") * _AT_ONCE + j + 1).alias("round"), F.col(f"n_{j}").alias("n"), *[F.col(f"{n}_{j}").alias(n) for n in sums]) for j in range(_AT_ONCE)]
    return wide.select(group, F.explode(F.array(*parts)).alias("x")).select(group, "x.*").where(F.col("round") <= rounds)


def _interval(group: str, rounds: DataFrame, value: Column, alpha: float = 0.05) -> DataFrame:
    """The nearest-rank interval of a resampled quantity; a group has one row a round."""
    ordered = rounds.withColumn("m", value).where("m is not null").groupBy(group).agg(F.array_sort(F.collect_list("m")).alias("m"))
    at = lambda p: F.element_at("m", (F.floor((F.size("m") - 1) * p + 0.5) + 1).cast("int"))
    return ordered.select(group, F.round(at(alpha / 2), 6).alias("lo"), F.round(at(1 - alpha / 2), 6).alias("hi"))


def bootstrap(rows: DataFrame, group: str, value: str, id_col: str, rounds: int = 200, seed: int = 42) -> DataFrame:
    """(group, lo, hi): a 95 % interval of the mean."""
    r = resampled(rows, group, {"s": F.col(value)}, id_col, rounds, seed)
    return _interval(group, r, F.try_divide("s", "n"))


def bootstrap_difference(rows: DataFrame, group: str, value: str, side: str, id_col: str, rounds: int = 200, seed: int = 42) -> DataFrame:
    """(group, difference, lo, hi): mean of the side that is TRUE less the mean of the other, resampled together."""
    yes = F.col(side).cast("long")
    sums = {"a": yes * F.col(value), "na": yes, "b": (1 - yes) * F.col(value), "nb": 1 - yes}
    r = resampled(rows, group, sums, id_col, rounds, seed)
    point = rows.groupBy(group).agg(F.round(F.avg(F.when(F.col(side), F.col(value))) - F.avg(F.when(~F.col(side), F.col(value))), 6).alias("difference"))
    return point.join(_interval(group, r, F.try_divide("a", "na") - F.try_divide("b", "nb")), group)


def degradation(pairs: DataFrame, group: str, policy: str, baseline: str, id_col: str, rounds: int = 200, seed: int = 42) -> DataFrame:
    """(group, degradation, lo, hi): mean of the baseline less the policy's over the same pairs, resampled in pairs."""
    lost = F.col(baseline) - F.col(policy)
    r = resampled(pairs, group, {"s": lost}, id_col, rounds, seed)
    return pairs.groupBy(group).agg(F.round(F.avg(lost), 6).alias("degradation")).join(_interval(group, r, F.try_divide("s", "n")), group)


# Fixed value: a ratio up to this is materially better.
MATERIAL = 0.75


def log_ratio(pairs: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """(group, ratio, lo, hi, verdict): geometric mean of b / a with its interval.

    better: the interval ends at ``MATERIAL`` or below; not_better: it begins above; open: neither.  A group with a
    pair that isn't positive, or with fewer than two pairs, has no interval and no row.
    """
    good = (F.col(a) > 0) & (F.col(b) > 0)
    x = pairs.withColumn("l", F.when(good, F.ln(F.col(b) / F.col(a))))
    s = x.groupBy(group).agg(F.count("*").alias("n"), F.count("l").alias("k"), F.avg("l").alias("m"), F.stddev_samp("l").alias("sd")).where("n = k and n > 1")
    half = t_point(F.col("n")) * F.col("sd") / F.sqrt("n")
    out = s.select(group, F.exp("m").alias("ratio"), F.exp(F.col("m") - half).alias("lo"), F.exp(F.col("m") + half).alias("hi"))
    verdict = F.when(F.col("hi") <= MATERIAL, "better").when(F.col("lo") > MATERIAL, "not_better").otherwise("open")
    return out.select(group, *[F.round(c, 6).alias(c) for c in ("ratio", "lo", "hi")], verdict.alias("verdict"))


# The largest relative half width by kind of measurement, the largest variation, and the blocks wanted.
HALF_WIDTH = {"cpu": 0.075, "footprint": 0.02}
MOST_VARIATION, BLOCKS = 0.10, 30


def stable_cells(rows: DataFrame, cell: str, value: str, kind: str = "cpu") -> DataFrame:
    """(cell, n, mean, rel_half, cv, underpowered, passes): whether a cell's mean is known well enough.

    A cell whose mean isn't positive, or with one sample, has no relative width and fails.
    """
    s = rows.groupBy(cell).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    known = (F.col("mean") > 0) & F.col("sd").isNotNull()
    half = F.when(known, t_point(F.col("n")) * F.col("sd") / F.sqrt("n") / F.col("mean"))
    cv = F.when(known, F.col("sd") / F.col("mean"))
    passes = F.coalesce((half <= HALF_WIDTH[kind]) & (cv <= MOST_VARIATION), F.lit(False))
    return s.select(cell, "n", F.round("mean", 6).alias("mean"), F.round(half, 6).alias("rel_half"), F.round(cv, 6).alias("cv"), (F.col("n") < BLOCKS).alias("underpowered"), passes.alias("passes"))


def depths(rows: DataFrame, depth: str, promoted: str) -> DataFrame:
    """One row: mean, nearest-rank median and 95th point of how many draws keys took, the most, and the share abstained.

    Depths are few numbers, so their histogram is summed first and only its bars are ordered.
    """
    bars = rows.groupBy(F.col(depth).alias("d")).agg(F.count("*").alias("c"), F.count_if(F.col(promoted)).alias("p"))
    up_to = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy()
    b = bars.withColumns({"end": F.sum("c").over(up_to), "n": F.sum("c").over(total)})
    at = lambda q: F.min(F.when(F.col("end") > F.floor((F.col("n") - 1) * q + 0.5), F.col("d")))
    return b.agg(F.round(F.sum(F.col("d") * F.col("c")) / F.sum("c"), 6).alias("mean"), at(0.5).alias("median"), at(0.95).alias("p95"), F.max("d").alias("most"), F.round(1 - F.sum("p") / F.sum("c"), 6).alias("abstained"))


def relevance(hits: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """(query_id, ndcg, recall, mrr): hits (query_id, doc_id, place from 1), judged (query_id, doc_id, gain).

    The ideal order and recall's denominator take all judgments; a query without a relevant one has zeros.
    """
    rel = judged.where("gain > 0")
    best = Window.partitionBy("query_id").orderBy(F.desc("gain"), "doc_id")
    ideal = rel.withColumn("r", F.row_number().over(best)).groupBy("query_id").agg(F.sum(F.when(F.col("r") <= k, F.col("gain") / F.log2(F.col("r") + 1))).alias("ideal"), F.count("*").alias("relevant"))
    got = hits.where(F.col("place") <= k).join(rel, ["query_id", "doc_id"]).groupBy("query_id").agg(F.sum(F.col("gain") / F.log2(F.col("place") + 1)).alias("dcg"), F.count("*").alias("found"), F.min("place").alias("first"))
    every = judged.select("query_id").distinct().join(ideal, "query_id", "left").join(got, "query_id", "left")
    z = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return every.select("query_id", z(F.col("dcg") / F.col("ideal")).alias("ndcg"), z(F.col("found") / F.col("relevant")).alias("recall"), z(1.0 / F.col("first")).alias("mrr"))


def precision(judged: DataFrame, group: str) -> DataFrame:
    """(group, queries, shown, precision, filter_recall, exact_recall) of judged rows (query_id, passes, relevant, exact)."""
    yes = lambda *cols: F.count_if(reduce(lambda a, b: a & b, map(F.col, cols)))
    counts = judged.groupBy(group).agg(F.countDistinct("query_id").alias("queries"), yes("passes").alias("shown"), yes("passes", "relevant").alias("hits"), yes("relevant").alias("relevant"), yes("passes", "exact").alias("exact_hits"), yes("exact").alias("exact"))
    return rates(counts, group)


def rates(counts: DataFrame, group: str) -> DataFrame:
    """The columns of `precision` from counts: shown, relevant and exact rows, and those of the latter that are shown (hits, exact_hits)."""
    share = lambda a, b: F.round(F.try_divide(a, b), 6)
    return counts.select(group, "queries", "shown", share("hits", "shown").alias("precision"), share("hits", "relevant").alias("filter_recall"), share("exact_hits", "exact").alias("exact_recall"))


def macro_f1(pairs: DataFrame) -> DataFrame:
    """One row: the mean F1 over classes that truth has; pairs (truth, guess)."""
    rows = pairs.select(F.explode(F.array(F.struct(F.col("truth").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("g"), F.when(F.col("truth") == F.col("guess"), 1).otherwise(0).alias("both")), F.struct(F.col("guess").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("g"), F.lit(0).alias("both")))).alias("x")).select("x.*")
    per = rows.where("c is not null").groupBy("c").agg(F.sum("t").alias("t"), F.sum("g").alias("g"), F.sum("both").alias("both")).where("t > 0")
    return per.agg(F.round(F.avg(2 * F.col("both") / (F.col("t") + F.col("g"))), 6).alias("macro_f1"))
