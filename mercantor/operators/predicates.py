"""Constraints to Columns.  In `matches` every leaf is TRUE or FALSE: a missing value, another kind or NaN is FALSE.

`kept` says the same for use in a filter, where NULL drops a row as FALSE does: plain comparisons of a column with a
literal, which a scan can push down.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import ATTRIBUTES
from ..model import Bool, Brand, BrandAny, Category, Constraint, Enum, EnumAny, Multi, Num, Preference, PriceOver, PriceUnder, ProductType, ProductTypeAny, Query, Text

_COMPARE = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def _column(attr: str, *kinds: str) -> Column | None:
    """The attribute's column if it has one of the kinds."""
    name, kind = ATTRIBUTES.get(attr, (None, None))
    return F.col(name) if kind in kinds else None


def number_matches(value: Column, op: str, bound: float) -> Column:
    """Spark takes NaN for equal to NaN and above all numbers; here it compares with nothing."""
    x = value.cast("double")
    return F.coalesce(_COMPARE[op](x, F.lit(float(bound))) & ~F.isnan(x), F.lit(False))


def matches(c: Constraint) -> Column:
    no = F.lit(False)
    true = lambda col, test: no if col is None else F.coalesce(test(col), no)
    match c:
        case Enum(attr, value):
            return true(_column(attr, "enum"), lambda x: x == F.lit(value))
        case EnumAny(attr, values):
            if (many := _column(attr, "multi")) is not None:
                return F.coalesce(F.arrays_overlap(many, F.array(*map(F.lit, values))), no) if values else no
            return true(_column(attr, "enum"), lambda x: x.isin(*values)) if values else no
        case Multi(attr, value):
            return true(_column(attr, "multi"), lambda x: F.array_contains(x, value))
        case Bool(attr, value):
            return true(_column(attr, "boolean"), lambda x: x == F.lit(value))
        case Num(attr, op, value):
            col = _column(attr, "number")
            return no if col is None else number_matches(col, op, value)
        case Text(attr, needle):
            return true(_column(attr, "text"), lambda x: x.contains(needle))
        case Brand(brand):
            return F.coalesce(F.col("brand") == brand, no)
        case BrandAny(brands):
            return F.coalesce(F.col("brand").isin(*brands), no) if brands else no
        case ProductType(name):
            return F.coalesce(F.col("product_type") == name, no)
        case ProductTypeAny(names):
            return F.coalesce(F.col("product_type").isin(*names), no) if names else no
        case Category(name):
            return F.coalesce(F.col("category") == name, no)
        case PriceUnder(cents):
            return F.coalesce(F.col("price_cents") < cents, no)
        case PriceOver(cents):
            return F.coalesce(F.col("price_cents") > cents, no)
    raise TypeError(f"not a constraint: {c!r}")


#: Number columns that hold whole numbers.
_WHOLE = frozenset(("price_cents",))


def _compared(name: str, op: str, bound: float) -> Column:
    """A comparison without casts or functions around the column, but for NaN, which is above all numbers in Spark."""
    x = F.col(name)
    if math.isnan(bound):
        return F.lit(False)
    if name in _WHOLE and math.isfinite(bound):
        if op == "=" and not float(bound).is_integer():
            return F.lit(False)
        whole = math.ceil(bound) if op in ("<", ">=") else math.floor(bound)
        return _COMPARE[op](x, F.lit(whole))
    test = _COMPARE[op](x, F.lit(float(bound)))
    return test & ~F.isnan(x) if op in (">", ">=") and name not in _WHOLE else test


def kept(c: Constraint) -> Column:
    """The constraint as a filter condition: NULL or FALSE where `matches` is FALSE."""
    match c:
        case Enum(attr, value):
            col = _column(attr, "enum")
            return F.lit(False) if col is None else col == F.lit(value)
        case EnumAny(attr, values) if values and (col := _column(attr, "enum")) is not None:
            return col.isin(*values)
        case Multi(attr, value) if (col := _column(attr, "multi")) is not None:
            return F.array_contains(col, value)
        case Bool(attr, value) if (col := _column(attr, "boolean")) is not None:
            return col == F.lit(value)
        case Num(attr, op, value) if ATTRIBUTES.get(attr, (None, None))[1] == "number":
            return _compared(ATTRIBUTES[attr][0], op, value)
        case Text(attr, needle) if (col := _column(attr, "text")) is not None:
            return col.contains(needle)
        case Brand(brand):
            return F.col("brand") == brand
        case BrandAny(brands) if brands:
            return F.col("brand").isin(*brands)
        case ProductType(name):
            return F.col("product_type") == name
        case ProductTypeAny(names) if names:
            return F.col("product_type").isin(*names)
        case Category(name):
            return F.col("category") == name
        case PriceUnder(cents):
            return F.col("price_cents") < F.lit(cents)
        case PriceOver(cents):
            return F.col("price_cents") > F.lit(cents)
    return matches(c)


def where_all(rows, constraints):
    """The rows that meet all constraints: those that a scan can prune by first, substring tests last."""
    for c in sorted(constraints, key=lambda c: not indexable(c)):
        rows = rows.where(kept(c))
    return rows


def all_match(constraints) -> Column:
    """The conjunction; of none, TRUE."""
    return reduce(lambda a, b: a & b, map(matches, constraints), F.lit(True))


def indexable(c: Constraint) -> bool:
    """Whether a scan can prune by it: all but substring tests, which are checked row by row."""
    return not isinstance(c, Text)


def query_matches(q: Query) -> Column:
    return all_match(q.constraints)


def preference_score(preferences: tuple[Preference, ...]) -> Column:
    """The sum of the weights of matching preferences.  Booleans and numbers never score."""
    parts = [F.when(matches(p.constraint), F.lit(p.weight)).otherwise(0.0) for p in preferences if not isinstance(p.constraint, Bool | Num)]
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))
