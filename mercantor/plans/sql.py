"""Constraints to SQL text, apart from the Column builder, so that one can check the other."""

from __future__ import annotations

from ..catalog import ATTRIBUTES
from ..model import Bool, Brand, BrandAny, Category, Constraint, Enum, EnumAny, Multi, Num, PriceOver, PriceUnder, ProductType, ProductTypeAny, Text


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"


def where(c: Constraint) -> str:
    """A SQL condition that is never NULL."""
    if hasattr(c, "attr"):
        name, kind = ATTRIBUTES.get(c.attr, (None, None))
        wanted = {Enum: ("enum",), EnumAny: ("enum", "multi"), Multi: ("multi",), Bool: ("boolean",), Num: ("number",), Text: ("text",)}[type(c)]
        if kind not in wanted:
            return "FALSE"
    if isinstance(c, EnumAny):
        if not c.values:
            return "FALSE"
        body = f"{name} IN {_list(c.values)}" if kind == "enum" else f"list_has_any({name}, [{', '.join(map(quoted, c.values))}])"
    elif isinstance(c, Enum):
        body = f"{name} = {quoted(c.value)}"
    elif isinstance(c, Multi):
        body = f"list_contains({name}, {quoted(c.value)})"
    elif isinstance(c, Bool):
        body = name if c.value else f"NOT {name}"
    elif isinstance(c, Num):
        body = f"CAST({name} AS DOUBLE) {c.op} {c.value!r} AND NOT isnan(CAST({name} AS DOUBLE))"
    elif isinstance(c, Text):
        body = f"contains({name}, {quoted(c.needle)})"
    elif isinstance(c, Brand):
        body = f"brand = {quoted(c.brand)}"
    elif isinstance(c, BrandAny):
        body = f"brand IN {_list(c.brands)}" if c.brands else "FALSE"
    elif isinstance(c, ProductType):
        body = f"product_type = {quoted(c.product_type)}"
    elif isinstance(c, ProductTypeAny):
        body = f"product_type IN {_list(c.product_types)}" if c.product_types else "FALSE"
    elif isinstance(c, Category):
        body = f"category = {quoted(c.category)}"
    elif isinstance(c, PriceUnder):
        body = f"price_cents < {c.cents}"
    elif isinstance(c, PriceOver):
        body = f"price_cents > {c.cents}"
    else:
        raise TypeError(f"not a constraint: {c!r}")
    return f"coalesce({body}, FALSE)"


def where_all(constraints) -> str:
    return " AND ".join(map(where, constraints)) or "TRUE"
