"""Scalar text functions as Columns: tokens, money, keys, identifiers, shapes, hierarchies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: A plain decimal number, without what a cast would also take (signs of type, spaces, hexadecimals).
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(_col(text)), r"[^\p{L}\p{N}]+"), "")


def space_tokens(text) -> Column:
    """Lower-cased runs between white space."""
    return F.array_remove(F.split(F.lower(_col(text)), r"\s+"), "")


def cents(text) -> Column:
    """``$12.34`` or ``12.34`` in cents, half a cent away from zero; null for anything else."""
    s = F.regexp_replace(_col(text), r"^\$", "")
    return F.when(s.rlike(NUMBER), F.round(s.try_cast("double") * 100).cast("long"))


# Endings of company names that don't tell brands apart.
COMPANY_ENDINGS = ("inc", "incorporated", "llc", "ltd", "limited", "co", "company", "corp", "corporation", "group", "intl", "international")


def alias_key(name) -> Column:
    """Words in lower case without company endings at the end, but for the first word."""
    flat = F.trim(F.regexp_replace(F.lower(_col(name)), r"[^\p{L}\p{N}]+", " "))
    return F.regexp_replace(flat, r"(?<=\S)( (" + "|".join(COMPANY_ENDINGS) + r"))+$", "")


def identifier(text) -> Column:
    """Letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(_col(text), r"[^\p{L}\p{N}]", ""))


def signature(text) -> Column:
    """Letters as A and digits as 9."""
    return F.regexp_replace(F.regexp_replace(_col(text), r"[A-Za-z]", "A"), r"[0-9]", "9")


def entropy(text) -> Column:
    """Shannon entropy of a text's characters in bits; 0 for an empty one."""
    chars = F.array_remove(F.split(_col(text), ""), "")
    n = F.size(chars).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.when(n <= 0, 0.0).otherwise(-F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + share(c) * F.log2(share(c))))


def leaf(path) -> Column:
    return F.substring_index(_col(path), " / ", -1)


def prefix(path, depth: int) -> Column:
    """The first ``depth`` levels of a path; null if it has fewer."""
    parts = F.split(_col(path), " / ")
    return F.when(F.size(parts) >= depth, F.array_join(F.slice(parts, 1, depth), " / "))


def ngrams(words: Column, low: int, high: int) -> Column:
    """All windows of low to high words, as phrases."""
    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
        return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in range(low, high + 1)])


def clean_share(text) -> Column:
    """The share of letters, digits and spaces."""
    t = _col(text)
    return F.when(F.length(t) > 0, F.length(F.regexp_replace(t, r"[^\p{L}\p{N} ]", "")) / F.length(t)).otherwise(0.0)


def name_share(text) -> Column:
    """The share of ASCII letters and white space: how much a text looks like a name."""
    t = _col(text)
    return F.when(F.length(t) > 0, F.length(F.regexp_replace(t, r"[^A-Za-z\s]", "")) / F.length(t)).otherwise(0.0)


def decoded(text) -> Column:
    """A query string's value: plus is a space, %XX a byte; null if an escape is broken or the bytes aren't UTF-8."""
    t = _col(text)
    out = F.try_url_decode(t)
    broken = out.contains("\ufffd") & ~t.contains("\ufffd") & ~F.upper(t).contains("%EF%BF%BD")
    return F.when(~t.rlike("%(?![0-9A-Fa-f]{2})") & ~broken, out)


def encoded(text) -> Column:
    """A value for a query string; a space is %20."""
    return F.replace(F.url_encode(_col(text)), F.lit("+"), F.lit("%20"))


def attribute_string(kind, s, n, b) -> Column:
    """An attribute value as text by its kind; whole numbers without a point; many-valued ones have none."""
    num = _col(n)
    whole = (num == F.floor(num)) & (F.abs(num) < 1e15)
    return F.when(_col(kind).isin("text", "enum"), _col(s)).when(_col(kind) == "boolean", _col(b).cast("string")).when(_col(kind) == "number", F.when(whole, num.cast("long").cast("string")).otherwise(num.cast("string")))


def residual_tokens(phrases) -> Column:
    """The letters-and-digits tokens of several phrases in a row."""
    return F.flatten(F.transform(_col(phrases), tokens))


def plural_equivalent(a, b) -> Column:
    """Whether two words are the same but for one s at the end."""
    x, y = _col(a), _col(b)
    return (x == y) | (x == F.concat(y, F.lit("s"))) | (y == F.concat(x, F.lit("s")))


def is_known_id(text, ids) -> Column:
    """Whether a trimmed text is one of an array of ids; large sets of ids are a semi-join instead."""
    return F.array_contains(ids, F.trim(_col(text)))


def strictly_within(a: Column, b: Column) -> Column:
    """Whether the words of a are some but not all of the words of b."""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_distinct(a)) < F.size(F.array_distinct(b)))


def gain(label, scale: str) -> Column:
    """Relevance gains of a judgment by scale."""
    # Gains of the three label scales.
    table = {"four": {"E": 3.0, "S": 2.0, "C": 1.0, "I": 0.0}, "three": {"Exact": 2.0, "Partial": 1.0, "Irrelevant": 0.0}, "steep": {"E": 1.0, "S": 0.1, "C": 0.01, "I": 0.0}}[scale]
    out = F.lit(None).cast("double")
    for k, v in table.items():
        out = F.when(_col(label) == k, v).otherwise(out)
    return out
