"""The typed query: constraints, preferences, ambiguous spans and leftover words."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Enum:
    """A single-valued attribute equals a value, case-sensitively."""

    attr: str
    value: str


@dataclass(frozen=True)
class EnumAny:
    """A single-valued attribute equals one of several values."""

    attr: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class Multi:
    """A many-valued attribute contains a value."""

    attr: str
    value: str


@dataclass(frozen=True)
class Bool:
    attr: str
    value: bool


@dataclass(frozen=True)
class Num:
    """A number compares (= < <= > >=) with a value; a missing number or NaN never does."""

    attr: str
    op: str
    value: float


@dataclass(frozen=True)
class Text:
    """A text contains a string, case-sensitively."""

    attr: str
    needle: str


@dataclass(frozen=True)
class Brand:
    brand: str


@dataclass(frozen=True)
class BrandAny:
    brands: tuple[str, ...]


@dataclass(frozen=True)
class ProductType:
    product_type: str


@dataclass(frozen=True)
class ProductTypeAny:
    product_types: tuple[str, ...]


@dataclass(frozen=True)
class Category:
    category: str


@dataclass(frozen=True)
class PriceUnder:
    """Strictly below, in cents."""

    cents: int


@dataclass(frozen=True)
class PriceOver:
    """Strictly above, in cents."""

    cents: int


Structural = Brand | BrandAny | ProductType | ProductTypeAny | Category | PriceUnder | PriceOver
Attribute = Enum | EnumAny | Multi | Bool | Num | Text
Constraint = Structural | Attribute


@dataclass(frozen=True)
class Preference:
    """A constraint that scores ``weight`` instead of filtering."""

    constraint: Constraint
    weight: float


@dataclass(frozen=True)
class Ambiguous:
    text: str
    readings: tuple[Constraint, ...]


@dataclass(frozen=True)
class Query:
    constraints: tuple[Constraint, ...] = ()
    preferences: tuple[Preference, ...] = ()
    ambiguous: tuple[Ambiguous, ...] = ()
    residual: tuple[str, ...] = ()

    @property
    def resolved(self) -> bool:
        return not self.ambiguous and not self.residual


@dataclass(frozen=True)
class Request:
    """A browse request: one category, filters, alternatives within an attribute, ranges, facets, sort and page."""

    category: str | None = None
    filters: tuple[tuple[str, str], ...] = ()
    any_filters: tuple[tuple[str, tuple[str, ...]], ...] = ()
    ranges: tuple[tuple[str, str, float], ...] = ()
    facets: tuple[str, ...] = ()
    sort: str | None = None
    descending: bool = True
    top_k: int = 48
    offset: int = 0
    extra: tuple[Constraint, ...] = field(default=())

    @property
    def limit(self) -> int:
        return min(self.top_k, 200)
