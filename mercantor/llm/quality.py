"""Quality rules: a ledger of rule bits and measurements, written once; policies are applied to it afterwards.

`ledger` measures every text once and sets bit k of ``failed`` when rule k fails; `stored` writes that as a table
without texts.  A policy is a name, a version and a mask of rules; applying it, or computing what each rule removes
alone (`ablation`), needs the stored ledger only and bitwise functions.  Everything is built-in column functions: no Python runs on executors.

Repeated three-word windows are found inside the row, without a shuffle: window hashes are sorted together
with their places, neighbours with equal hashes are repeats, and the places' coverage is summed.  (Two of a
text's windows meet in a 64-bit hash with a chance of about 1e-11 for 20,000 words.)

Defined results: a null, empty or white-space-only text has zero in every measurement and fails ``few_words``;
repeated rows are measured one by one; an empty table gives an empty ledger; columns of the documents pass
through, but for those that the ledger names itself, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import OWN, keep

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rules() -> list[tuple[str, Column]]:
    """(name, does it fail) of each rule, by number.  New rules are added at the end: bits never change meaning."""
    m = {k: F.col(k) for k in MEASURES}
    return [
        ("few_words", m["n_words"] < 50),
        ("repeated_windows", 100 * m["n_repeat_words"] > 50 * m["n_words"]),
        ("short_words", m["word_chars"] < 2 * m["n_words"]),
        ("long_words", m["word_chars"] > 14 * m["n_words"]),
        ("symbols", 10 * m["n_symbols"] > 3 * m["n_words"]),
        ("repeated_lines", (m["n_dup_lines"] > 3) & (F.col(OWN + "n_lines") < 2 * m["n_dup_lines"])),
        ("too_many_words", m["n_words"] > 1_000_000),
    ]


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        numbers = {name: k for k, name in enumerate(RULES)}
        return sum(1 << numbers[x] for x in self.rules)


RULES = ("few_words", "repeated_windows", "short_words", "long_words", "symbols", "repeated_lines", "too_many_words")
BASE = Policy("base", 1, ("few_words", "repeated_windows"))
PRODUCTION = Policy("production", 1, RULES[:6])
POLICIES = (BASE, Policy("lenient", 1, ("few_words",)), PRODUCTION)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with the five measurements (long), without any Python."""
    c = {k: OWN + k for k in ("text", "words", "lines", "seen", "twice", "n_lines")}
    spaces = " " * len(SPACE)
    out = docs.withColumn(c["text"], F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    # Separate steps: the optimizer keeps a column that is used more than once from being computed again.
    out = out.withColumns(
        {
            c["words"]: F.array_remove(F.split(F.translate(c["text"], SPACE, spaces), " "), ""),
            c["lines"]: F.filter(F.split(c["text"], "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0),
            "word_chars": F.length(F.translate(c["text"], SPACE, "")).cast("long"),
            "n_symbols": (F.length(c["text"]) - F.length(F.translate(c["text"], SYMBOLS, ""))).cast("long"),
        }
    )
    window = f"named_struct('h', xxhash64(x, {c['words']}[i + 1], {c['words']}[i + 2]), 'i', i)"
    out = out.withColumns(
        {
            "n_words": F.size(c["words"]).cast("long"),
            c["n_lines"]: F.size(c["lines"]).cast("long"),
            "n_dup_lines": (F.size(c["lines"]) - F.size(F.array_distinct(c["lines"]))).cast("long"),
            c["seen"]: F.expr(f"if(size({c['words']}) < 4, null, array_sort(transform(slice({c['words']}, 1, size({c['words']}) - 2), (x, i) -> {window})))"),
        }
    )
    # The places of windows whose hash a neighbour in the sorted array shares.
    s = c["seen"]
    near = f"filter({s}, (x, k) -> (k > 0 and {s}[k - 1].h = x.h) or (k + 1 < size({s}) and {s}[k + 1].h = x.h))"
    out = out.withColumn(c["twice"], F.expr(f"sort_array(transform({near}, x -> x.i))"))
    t = c["twice"]
    covered = f"aggregate({t}, named_struct('n', 0L, 'to', -1), (a, i) -> named_struct('n', a.n + i + 3 - greatest(a.to, i), 'to', i + 3), a -> a.n)"
    out = out.withColumn("n_repeat_words", F.expr(f"coalesce({covered}, 0L)"))
    return out.drop(*(v for k, v in c.items() if k != "n_lines"))


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with their measurements and ``failed`` (long): one bit for each rule."""
    out = measured(docs, text_col)
    bits = [F.when(fails, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, fails) in enumerate(rules())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    # The condition always holds; as it isn't deterministic, a filter on the bits isn't pushed below it, where every
    # use of a measurement, inside lambdas too, would be computed again from the text.
    return out.withColumn("failed", F.when(F.monotonically_increasing_id() >= 0, total)).drop(OWN + "n_lines")


def stored(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The ledger as a table of its own, without texts: written once, read by any number of policies and ablations."""
    return keep(ledger(docs, text_col).drop(text_col))


def passes(policy: Policy) -> Column:
    return F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0


def apply_policy(book: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with the policy's name, version and verdict."""
    return book.withColumns({"policy": F.lit(policy.name), "policy_version": F.lit(policy.version), "kept": passes(policy)})


def ablation(book: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: rows that fail it, that fail it alone, and rows and words kept without it.

    One pass: the ledger is first grouped by its bits (at most 2**rules groups), then tested bitwise.
    """
    groups = book.groupBy("failed").agg(F.count("*").alias("rows"), F.sum("n_words").alias("words"))
    every = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(Policy("", 0, (name,)).mask).cast("long").alias("bit")) for name in policy.rules])
    x = groups.withColumn("r", F.explode(every)).withColumn("own", F.col("failed").bitwiseAND(F.lit(policy.mask)))
    bit, own, rest = F.col("r.bit"), F.col("own"), F.col("own").bitwiseAND(F.bitwise_not(F.col("r.bit")))
    count = lambda when, what: F.sum(F.when(when, F.col(what)).otherwise(0)).alias
    return x.groupBy(F.col("r.rule").alias("rule")).agg(
        count(own.bitwiseAND(bit) != 0, "rows")("n_failed"), count(own == bit, "rows")("n_failed_alone"), count(rest == 0, "rows")("n_kept_without"), count(rest == 0, "words")("words_kept_without"), count(own == 0, "rows")("n_kept")
    )


def keep_good(docs: DataFrame, policy: Policy = PRODUCTION, text_col: str = "text") -> DataFrame:
    """The documents that the policy keeps, with their own columns only."""
    clash = {c: OWN + "in_" + c for c in docs.columns if c in (*MEASURES, "failed")}
    inner = docs.withColumnsRenamed(clash)
    return ledger(inner, clash.get(text_col, text_col)).where(passes(policy)).select(*[F.col(f"`{clash.get(c, c)}`").alias(c) for c in docs.columns])


def verdicts(docs: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """The contract's columns, read off the stored ledger: a base failure is never kept."""
    book = stored(docs.select("doc_id", "text"))
    base = F.col("failed").bitwiseAND(F.lit(BASE.mask)) != 0
    return book.select("doc_id", *MEASURES, base.alias("base_failed"), (~base & passes(policy)).alias("kept"), "failed")
