"""Text to typed query: the text is cut into spans, each span is classified, and one fold over them makes the query."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import ATTRIBUTES
from ..functions.text import ngrams, space_tokens
from ..model import Ambiguous, Bool, Brand, BrandAny, Category, Constraint, Enum, EnumAny, Multi, Num, Preference, PriceOver, PriceUnder, ProductType, ProductTypeAny, Query

# Words without meaning for search, and words that negate what follows.
STOPWORDS = frozenset(("a", "the", "for", "with", "in", "and", "to", "of", "on"))
NEGATIONS = frozenset(("not", "no", "without", "non", "aren't", "isn't", "don't", "doesn't"))
#: What an attribute that no entity backs is worth as a preference.
DEMOTED = 0.5
#: Bytes of phrases that are broadcast; a larger lexicon meets the texts in a join.
BROADCAST_BYTES = 64 << 20
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?")
_ENTITY = (Brand, BrandAny, ProductType, ProductTypeAny, Category)
Reading = Constraint | Preference


@dataclass(frozen=True)
class Lexicon:
    """Lower-case phrases with their readings."""

    phrases: Mapping[str, tuple[Reading, ...]]
    version: int = 1

    @property
    def longest(self) -> int:
        return max((len(p.split()) for p in self.phrases), default=1)

    def with_phrase(self, phrase: str, *readings: Reading) -> Lexicon:
        return Lexicon({**self.phrases, phrase.lower(): readings}, self.version)

    def resolve(self, phrase: str) -> tuple[Reading, ...]:
        return self.phrases.get(phrase.lower(), ())


def number(word: str | None) -> float | None:
    return float(word) if word is not None and _NUMBER.fullmatch(word) else None


def money(word: str | None) -> int | None:
    dollars = number(word.removeprefix("$")) if word is not None else None
    if dollars is None or not math.isfinite(dollars):
        return None
    return int(math.copysign(math.floor(abs(dollars * 100) + 0.5), dollars))


def slot(c: Constraint) -> str | None:
    """The single value that a constraint fixes, if it does."""
    kinds = {Brand: "brand", BrandAny: "brand", ProductType: "product_type", ProductTypeAny: "product_type", Category: "category"}
    return f"attribute {c.attr}" if isinstance(c, Enum | EnumAny) else kinds.get(type(c))


def is_entity(c: Constraint) -> bool:
    return isinstance(c, _ENTITY)


#: Keywords that take the word after them as a number.
_BOUNDS = {
    "size": lambda w: None if (n := number(w)) is None else Num("size", "=", n),
    "under": lambda w: None if (c := money(w)) is None else PriceUnder(c),
    "over": lambda w: None if (c := money(w)) is None else PriceOver(c),
}


@dataclass(frozen=True)
class Span:
    """Some consecutive words of a text: a ``bound`` with its constraint, a ``phrase`` with its readings, a phrase that
    is ``denied``, a plain ``word``, or words to ``skip``."""

    kind: str
    text: str
    readings: tuple[Reading, ...] = ()


def spans(text: str, lexicon: Lexicon) -> Iterator[Span]:
    """The text from left to right: bounds come before negations, these before the longest phrase, then stopwords."""
    words = text.lower().split()
    longest, at = lexicon.longest, 0

    def known(i: int) -> tuple[str, int]:
        ends = range(min(len(words), i + longest), i, -1)
        return next(((p, j) for j in ends if (p := " ".join(words[i:j])) in lexicon.phrases), ("", i))

    while at < len(words):
        word = words[at]
        bound = _BOUNDS[word](words[at + 1] if at + 1 < len(words) else None) if word in _BOUNDS else None
        if bound is not None:
            yield Span("bound", word, (bound,))
            at += 2
            continue
        denies = word in NEGATIONS
        phrase, end = known(at + denies)
        if denies:
            yield Span("denied" if phrase else "skip", phrase)
            at = max(end, at + 1)
        elif phrase:
            yield Span("phrase", phrase, lexicon.phrases[phrase])
            at = end
        else:
            yield Span("skip" if word in STOPWORDS else "word", word)
            at += 1


def compile_text(text: str, lexicon: Lexicon) -> Query:
    """The query of a text.

    A bound filters.  A phrase with one constraint filters, unless another value already holds its slot: then it is
    left over.  One preference scores and is left over as well.  Other numbers of readings are ambiguous.  Plain words
    and denied phrases are left over.  Without brand, type or category, attributes found by phrase only score.
    """
    parts = [s for s in spans(text, lexicon) if s.kind != "skip"]
    single = [s for s in parts if len(s.readings) == 1]
    held: dict[str, Constraint] = {}
    filters: list[tuple[Constraint, Span]] = []
    for s in single:
        (r,) = s.readings
        if not isinstance(r, Preference) and (key := slot(r)) is not None:
            if held.setdefault(key, r) != r:
                continue
        if not isinstance(r, Preference):
            filters.append((r, s))
    anchored = any(is_entity(c) for c, _ in filters)
    weak = [] if anchored else [(c, s) for c, s in filters if s.kind == "phrase" and not isinstance(c, PriceUnder | PriceOver)]
    filtering = {id(s) for _, s in filters}
    left = [s.text for s in parts if s.kind in ("word", "denied") or (len(s.readings) == 1 and id(s) not in filtering)]
    left += [p for p in dict.fromkeys(s.text for _, s in weak) if p not in left]
    demoted = {id(s) for _, s in weak}
    return Query(
        tuple(c for c, s in filters if id(s) not in demoted),
        (*(s.readings[0] for s in single if isinstance(s.readings[0], Preference)), *(Preference(c, DEMOTED) for c, _ in weak)),
        tuple(Ambiguous(s.text, tuple(r.constraint if isinstance(r, Preference) else r for r in s.readings)) for s in parts if s.kind == "phrase" and len(s.readings) != 1),
        tuple(left),
    )


#: A constraint as a row: its kind, attribute, comparison, values and number.
CONSTRAINT = pa.struct([("kind", pa.string()), ("attr", pa.string()), ("op", pa.string()), ("values", pa.list_(pa.string())), ("number", pa.float64()), ("weight", pa.float64())])
_ROW = "struct<kind:string,attr:string,op:string,values:array<string>,number:double,weight:double>"
IR = f"constraints array<{_ROW}>, preferences array<{_ROW}>, ambiguous array<struct<text:string,readings:array<{_ROW}>>>, residual array<string>"
_NAMED = {Brand: "brand", ProductType: "product_type", Category: "category"}
_ANY = {BrandAny: "brand", ProductTypeAny: "product_type"}


def row_of(c: Constraint, weight: float | None = None) -> dict:
    """A constraint as a row of `CONSTRAINT`."""
    out = dict.fromkeys(("attr", "op", "values", "number"), None) | {"kind": type(c).__name__, "weight": weight}
    match c:
        case Enum(attr, value) | Multi(attr, value):
            return out | {"attr": attr, "values": [value]}
        case EnumAny(attr, values):
            return out | {"attr": attr, "values": list(values)}
        case Bool(attr, value):
            return out | {"attr": attr, "number": float(value)}
        case Num(attr, op, value):
            return out | {"attr": attr, "op": op, "number": value}
        case PriceUnder(cents) | PriceOver(cents):
            return out | {"attr": "price", "number": float(cents)}
        case BrandAny(values) | ProductTypeAny(values):
            return out | {"attr": _ANY[type(c)], "values": list(values)}
        case Brand(value) | ProductType(value) | Category(value):
            return out | {"attr": _NAMED[type(c)], "values": [value]}
    raise TypeError(f"no row for {c!r}")


def constraint_of_row(r) -> Constraint:
    """The constraint that `row_of` made the row of."""
    values = tuple(r["values"] or ())
    match r["kind"]:
        case "Enum" | "Multi" as k:
            return {"Enum": Enum, "Multi": Multi}[k](r["attr"], values[0])
        case "EnumAny":
            return EnumAny(r["attr"], values)
        case "Bool":
            return Bool(r["attr"], bool(r["number"]))
        case "Num":
            return Num(r["attr"], r["op"], r["number"])
        case "PriceUnder" | "PriceOver" as k:
            return {"PriceUnder": PriceUnder, "PriceOver": PriceOver}[k](int(r["number"]))
        case "BrandAny" | "ProductTypeAny" as k:
            return {"BrandAny": BrandAny, "ProductTypeAny": ProductTypeAny}[k](values)
        case "Brand" | "ProductType" | "Category" as k:
            return {"Brand": Brand, "ProductType": ProductType, "Category": Category}[k](values[0])
    raise TypeError(f"no constraint of kind {r['kind']}")


def query_of_row(r) -> Query:
    """A compiled row as a query."""
    preferences = tuple(Preference(constraint_of_row(p), p["weight"]) for p in r["preferences"])
    spans_ = tuple(Ambiguous(a["text"], tuple(map(constraint_of_row, a["readings"]))) for a in r["ambiguous"])
    return Query(tuple(map(constraint_of_row, r["constraints"])), preferences, spans_, tuple(r["residual"]))


def reading(kind: str, values: Iterable[str], weight: float | None = None) -> Reading:
    """A reading as `lexicon.readings` gives it."""
    values = tuple(values)
    name = kind.partition(":")[2]
    if kind in ("brand", "product_type"):
        one, several = {"brand": (Brand, BrandAny), "product_type": (ProductType, ProductTypeAny)}[kind]
        c: Constraint = one(values[0]) if len(values) == 1 else several(values)
    elif kind == "category":
        c = Category(values[0])
    elif kind.startswith("boolean:"):
        c = Bool(name, True)
    elif kind.startswith("multi:") or ATTRIBUTES.get(name, ("", ""))[1] == "multi":
        c = Multi(name, values[0])
    else:
        c = Enum(name, values[0])
    return c if weight is None else Preference(c, weight)


def lexicon_of(kinds: Iterable[tuple[str, str, str]]) -> Lexicon:
    """Rows (phrase, kind, value), as `lexicon.phrases` gives them, to a lexicon."""
    return Lexicon({phrase: (reading(kind, [value]),) for phrase, kind, value in kinds})


def lexicon_of_readings(rows: Iterable) -> Lexicon:
    """Rows (phrase, readings), as `lexicon.readings` gives them, to a lexicon."""
    return Lexicon({r["phrase"]: tuple(reading(x["kind"], x["values"], x["weight"]) for x in r["readings"]) for r in rows})


def _compiled(texts: list[str | None], lexicons: Iterable[Lexicon]) -> list[pa.Array]:
    out = [compile_text(t or "", x) for t, x in zip(texts, lexicons, strict=False)]
    spans_ = pa.list_(pa.struct([("text", pa.string()), ("readings", pa.list_(CONSTRAINT))]))
    return [
        pa.array([[row_of(c) for c in q.constraints] for q in out], pa.list_(CONSTRAINT)),
        pa.array([[row_of(p.constraint, p.weight) for p in q.preferences] for q in out], pa.list_(CONSTRAINT)),
        pa.array([[{"text": a.text, "readings": [row_of(c) for c in a.readings]} for a in q.ambiguous] for q in out], spans_),
        pa.array([list(q.residual) for q in out], pa.list_(pa.string())),
    ]


def _with_ir(names: list[str]) -> list[str]:
    return [*names, "constraints", "preferences", "ambiguous", "residual"]


def compile_corpus(queries: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """The texts with their compiled queries (`IR`), by Arrow batches: the scan has state, so it runs in Python.

    The lexicon is a versioned artifact of a checked size and broadcast; `compile_with` takes one of any size.
    """
    if sum(map(len, lexicon.phrases)) > BROADCAST_BYTES:
        raise ValueError("the lexicon is too large to broadcast: use compile_with")
    shared, names = queries.sparkSession.sparkContext.broadcast(lexicon), queries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, *_compiled(texts, [shared.value] * len(texts))], names=_with_ir(names))

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema.fields)
    return queries.mapInArrow(run, f"{kept}, {IR}")


def compile_with(queries: DataFrame, lexicon: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """As `compile_corpus`, with a lexicon (phrase, readings) of any size: each text meets the phrases among its windows.

    A text's own phrases are all that its compilation looks up, so they are joined to it and it needs no whole lexicon.
    """
    longest = lexicon.agg(F.coalesce(F.max(F.size(F.split("phrase", " "))), F.lit(1))).first()[0]
    windows = queries.select(F.col(id_col), F.explode(F.array_distinct(ngrams(space_tokens(text_col), 1, longest))).alias("phrase"))
    own = windows.join(lexicon, "phrase").groupBy(id_col).agg(F.collect_list(F.struct("phrase", "readings")).alias("_own"))
    joined, names = queries.join(own, id_col, "left").select(*queries.columns, "_own"), queries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            own = (lexicon_of_readings(x or ()) for x in batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *_compiled(texts, own)], names=_with_ir(names))

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema.fields)
    return joined.mapInArrow(run, f"{kept}, {IR}")


def coverage(compiled: DataFrame) -> DataFrame:
    """One row: queries, those fully resolved, those with an ambiguous span, those with words left over."""
    open_, left = F.size("ambiguous") > 0, F.size("residual") > 0
    return compiled.agg(F.count("*").alias("total"), F.count_if(~open_ & ~left).alias("resolved"), F.count_if(open_).alias("ambiguous"), F.count_if(left).alias("residual"))


def holes(compiled: DataFrame) -> DataFrame:
    """The queries that are ambiguous or leave words over."""
    return compiled.where((F.size("ambiguous") > 0) | (F.size("residual") > 0))
