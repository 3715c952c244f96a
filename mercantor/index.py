"""The compiled catalog: one build writes a typed, sorted table, its postings and its facet counts; queries scan these.

The table has a row for each variant with its product's attributes, its category and its ordinal, dealt into ranges
of (category, brand) and sorted inside them, so a filter on either skips files and row groups.  Attribute maps of any
kinds are pivoted to one typed column for each name and kind (`pivot`).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import folder

TABLES = ("part", "lineitem", "supplier", "nation", "region")
#: Rows of the compiled table in a file, about.
ROWS_A_FILE = 4_000_000
#: Names and kinds of attributes that become columns; beyond that a catalog's attributes are data, not schema.
MOST_COLUMNS = 10_000
_BUILT: dict[tuple[str, str], str] = {}


@dataclass(frozen=True)
class Index:
    """Paths of a built index."""

    path: str

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")

    def sizes(self, spark: SparkSession) -> DataFrame:
        """(structure, files, bytes, rows) of each table of the index, from its files and their footers."""
        jvm = spark._jvm
        rows = []
        for name in ("catalog", "postings", "facets"):
            there = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
            found = [s for s in fs.listStatus(there) if s.getPath().getName().endswith(".parquet")]
            rows.append((name, len(found), sum(s.getLen() for s in found), self.table(spark, name).count()))
        return spark.createDataFrame(rows, "structure string, files long, bytes long, rows long")


def _stamp(spark: SparkSession, sf_dir: str) -> str:
    """What the input files are: names, lengths and times."""
    seen = []
    for t in TABLES:
        there = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
        seen += [f"{t} {s.getPath().getName()} {s.getLen()} {s.getModificationTime()}" for s in (fs.globStatus(there) or [])]
    return hashlib.sha256("\n".join([sf_dir, *seen]).encode()).hexdigest()[:24]


def opened(spark: SparkSession, sf_dir: str) -> Index:
    """The index of the tables as they are now; built if this session has none."""
    key = (spark.sparkContext.applicationId, _stamp(spark, sf_dir))
    if key not in _BUILT:
        path = f"{folder(spark)}/index-{key[1]}"
        build(spark, sf_dir, path)
        _BUILT[key] = path
    return Index(_BUILT[key])


def build(spark: SparkSession, sf_dir: str, path: str) -> Index:
    """Writes the compiled catalog, the postings of its titles and the facet counts of the whole catalog."""
    from .catalog import ATTRIBUTES, flat, with_ordinal
    from .functions.text import space_tokens, tokens
    from .operators.facets import facet

    rows = flat(spark, sf_dir)
    numbers = with_ordinal(rows.select("product_id", "variant_id"), "product_id", "variant_id")
    typed = rows.join(numbers, ["product_id", "variant_id"]).withColumn("title_tokens", F.array_distinct(space_tokens("title")))
    dealt = typed.repartitionByRange("category", "brand").sortWithinPartitions("category", "brand", "product_id", "variant_id")
    dealt.write.option("maxRecordsPerFile", ROWS_A_FILE).mode("overwrite").parquet(f"{path}/catalog")
    table = spark.read.parquet(f"{path}/catalog")
    titles = table.select("product_id", "title").distinct()
    posts = titles.select("product_id", F.explode(F.array_distinct(tokens("title"))).alias("token"))
    posts.repartitionByRange("token").sortWithinPartitions("token", "product_id").write.mode("overwrite").parquet(f"{path}/postings")
    counts = None
    for attr, (_, kind) in ATTRIBUTES.items():
        if kind in ("enum", "multi"):
            one = facet(table, attr)
            counts = one if counts is None else counts.union(one)
    counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/facets")
    return Index(path)


#: A value of an attribute map, of one kind.
VALUE = "struct<kind:string,s:string,n:double,b:boolean,many:array<string>>"
_FIELD = {"enum": "s", "text": "s", "number": "n", "boolean": "b", "multi": "many"}


def value(kind: str, x: Column) -> Column:
    """A typed value of an attribute map."""
    kinds = {"s": "string", "n": "double", "b": "boolean", "many": "array<string>"}
    own = _FIELD[kind]
    return F.struct(F.lit(kind).alias("kind"), *[(x if f == own else F.lit(None)).cast(t).alias(f) for f, t in kinds.items()])


def column_name(name: str, kind: str) -> str:
    return f"{name}__{kind}"


def pivot(rows: DataFrame, attributes: str, *ids: str) -> DataFrame:
    """Attribute maps (string to VALUE) as one typed column for each name and kind, so kinds never mix.

    The names and kinds are found in one pass with partial distinct; a row that lacks one has null there.
    """
    pairs = rows.select(F.explode(attributes).alias("name", "v")).select("name", "v.kind").distinct().orderBy("name", "kind").limit(MOST_COLUMNS + 1).collect()
    if len(pairs) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} attributes: keep them as rows")
    made = []
    for p in pairs:
        v = F.col(attributes)[p["name"]]
        made.append(F.when(v["kind"] == p["kind"], v[_FIELD[p["kind"]]]).alias(column_name(p["name"], p["kind"])))
    return rows.select(*ids, *made)


def kinds(rows: DataFrame, group: str, attributes: str) -> DataFrame:
    """(group, name, kinds): the kinds in which each group's attributes come, in order."""
    pairs = rows.select(group, F.explode(attributes).alias("name", "v")).groupBy(group, "name").agg(F.array_sort(F.collect_set("v.kind")).alias("kinds"))
    return pairs
