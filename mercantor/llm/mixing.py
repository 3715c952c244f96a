"""Mixing sources to target weights with nested hash thresholds, without sorting documents.

A document's place is a 60-bit hash of its id and text.  Word sums by source and hash bucket show in which
bucket a source's budget ends; only that bucket's rows are summed again, by the next 15 bits, until it holds
one row.  What remains is one threshold for each source: a larger budget takes a superset of a smaller one,
and taking documents is a comparison.  Everything is built-in column functions.

Defined results: a null or wordless text has size 0; null is a source of its own, the last; repeated rows have
equal hashes and are taken together; an empty table mixes to an empty one; with no words at all every target
and every taken count is 0; columns of the documents pass through `mix` untouched (it adds two, ``__mx_``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import OWN, keep

LEVEL_BITS, LEVELS = 15, 4
BITS = LEVEL_BITS * LEVELS
#: Per-source tables of up to so many rows are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 100_000
SPACE = " \t\n\x0b\f\r"


def n_words(text: Column) -> Column:
    """Runs of characters that are not ASCII white space; 0 for null."""
    folded = F.translate(text, SPACE, " " * len(SPACE))
    runs = F.split(folded, " ")
    return F.coalesce(F.size(F.array_remove(runs, "")), F.lit(0)).cast("long")


def place(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 64 - BITS)


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size) to targets: weights by code point order of sources, nulls last, repeating.

    Each target stops at ``most`` times its source's size and the rest is shared again by weight: sources fill
    up in the order of size by weight, so running sums in that order give the final level in one pass.  The
    windows see one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    total = Window.partitionBy()
    x = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    x = x.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), F.col("rank") % len(weights) + 1))
    x = x.withColumns({"budget": share * F.sum("source_size").over(total), "cap": most * F.col("source_size"), "fills_at": most * F.col("source_size") / F.col("weight")})
    order = Window.orderBy("fills_at", "rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    x = x.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    first = F.when(F.col("fills_at") > F.col("level"), F.struct("fills_at", "rank"))
    x = x.withColumn("level", F.min_by("level", first).over(total))
    return x.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), "cap").alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame, near) -> DataFrame:
    """goals (source, budget) to (source, limit): rows (source, size, at) with at < limit come to about the budget."""
    state = goals.select("source", "budget", F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("base"))
    done = None
    for level in range(1, LEVELS + 1):
        shift = BITS - LEVEL_BITS * level
        inside = rows.alias("r").join(near(state.where("budget > 0").alias("s")), F.expr("r.source <=> s.source and shiftrightunsigned(r.at, %d) = s.path" % (shift + LEVEL_BITS)))
        bars = inside.groupBy(F.col("r.source").alias("source"), F.shiftrightunsigned("r.at", shift).alias("path")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.first("budget").alias("budget"), F.first("base").alias("base"))
        up_to = Window.partitionBy("source").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
        bars = bars.withColumn("end", F.col("base") + F.sum("size").over(up_to)).where(F.col("end") >= F.col("budget"))
        edge = bars.groupBy("source").agg(F.min_by(F.struct("path", "size", "n", "budget", "end"), "path").alias("e"))
        state = keep(edge.select("source", "e.path", "e.size", "e.n", "e.budget", (F.col("e.end") - F.col("e.size")).alias("base")))
        last = level == LEVELS
        ready = state if last else state.where("n <= 1")
        # The bucket that crosses the budget comes in when that is nearer than to stop before it.
        into = F.when(F.col("size") <= 2 * (F.col("budget") - F.col("base")), 1).otherwise(0)
        ready = ready.select("source", F.shiftleft(F.col("path") + into, shift).alias("limit"))
        done = ready if done is None else done.union(ready)
        state = state.where("n > 1").select("source", "budget", "path", "base")
        if last or state.isEmpty():
            return done
    return done


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: int = 2, with_text: bool = True) -> DataFrame:
    """The documents with their size, their source's size and target, and how often the mix takes them.

    The four columns' names start with ``__mx_``: size, source_size, target, times.
    """
    own = {k: OWN + k for k in ("source", "size", "at")}
    text, source = F.col(f"`{text_col}`"), F.col(f"`{source_col}`").cast("string")
    # Ids, hashes and sizes are written once; later passes read these narrow rows and no text.
    full = docs.withColumns({own["source"]: source, own["size"]: n_words(text), own["at"]: place(F.col(f"`{id_col}`"), text)})
    narrow = keep(full.select(*[F.col(f"`{c}`") for c in full.columns if c != text_col]) if not with_text else full.select(*own.values()))
    rows = narrow.select(*[F.col(v).alias(k) for k, v in own.items()])
    goals = keep(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    near = F.broadcast if goals.count() <= BROADCAST_SOURCES else (lambda df: df)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most - 1))).otherwise(0)
    goals = goals.withColumn("whole", whole.cast("long"))
    limits = thresholds(rows, goals.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget")), near)
    plan = goals.alias("g").join(limits.alias("l"), F.expr("g.source <=> l.source"), "left").select(F.col("g.source").alias(OWN + "key"), F.col("source_size").alias(OWN + "source_size"), F.col("target").alias(OWN + "target"), "whole", F.coalesce("limit", F.lit(0)).alias("limit"))
    plan = keep(plan)
    plan = plan.withColumnsRenamed({"whole": OWN + "whole", "limit": OWN + "limit"})
    base = full if with_text else narrow
    out = base.join(near(plan), F.expr(f"{own['source']} <=> {OWN}key"))
    times = F.col(OWN + "whole") + F.when(F.col(own["at"]) < F.col(OWN + "limit"), 1).otherwise(0)
    return out.withColumn(OWN + "times", times.cast("long")).drop(own["source"], own["at"], OWN + "key", OWN + "whole", OWN + "limit")


def take(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns only."""
    out = mix(docs, **how)
    times = F.expr(f"if({OWN}times > 0, sequence(1L, {OWN}times), array())")
    return out.withColumn(OWN + "k", F.explode(times)).select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    out = mix(docs.select("doc_id", "text", "source"), with_text=False)
    c = {k: F.col(OWN + k) for k in ("size", "source_size", "target", "times")}
    return out.select("doc_id", c["size"].alias("size"), "source", c["source_size"].alias("source_size"), c["target"].alias("target"), (c["times"] * c["size"]).alias("taken"))
