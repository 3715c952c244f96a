"""Hand-made catalogs: variants, missing and odd values, sorting, facets, ordinals, feeds."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from mercantor.catalog import effective, with_ordinal
from mercantor.model import Bool, Brand, BrandAny, Enum, Multi, Num, Preference, Query, Request, Text
from mercantor.operators import facets as fx
from mercantor.operators.predicates import all_match, matches
from mercantor.operators.search import after, execute, legacy_sort_key, narrowed, page, ranked, sort_key
from mercantor.sources import catalogs as src

SCHEMA = "product_id long, variant_id long, brand string, product_type string, category string, region string, title string, words array<string>, returnflag string, linestatus string, quantity double, size double, large boolean, price_cents long"


def flat(spark, rows):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def shop(spark):
    return flat(
        spark,
        [
            {"product_id": 1, "variant_id": 11, "brand": "Nike", "title": "Black running shoe", "words": ["light", "light", "soft"], "returnflag": "Black", "size": 8.0, "large": True, "price_cents": 100, "category": "c"},
            {"product_id": 1, "variant_id": 12, "brand": "Nike", "title": "Red running shoe", "words": [], "returnflag": "Red", "size": 9.0, "large": False, "price_cents": 200, "category": "c"},
            {"product_id": 2, "variant_id": 21, "brand": None, "title": None, "words": None, "returnflag": None, "size": float("nan"), "price_cents": None, "category": "d"},
            {"product_id": 3, "variant_id": 31, "brand": "nike", "title": "", "words": ["soft"], "returnflag": "black", "size": -0.0, "price_cents": 150, "category": "d"},
            {"product_id": 3, "variant_id": 32, "brand": "Adi", "title": "Rue", "words": ["soft"], "returnflag": "Red", "size": 0.0, "price_cents": 150, "category": "d"},
        ],
    )


def ids(df):
    return sorted(r["variant_id"] for r in df.collect())


def test_attributes_of_two_variants_never_combine(shop):
    at = lambda color, size: ids(execute(shop, Query((Enum("returnflag", color), Num("size", "=", size)))))
    assert at("Black", 8) == [11] and at("Red", 9) == [12] and at("Black", 9) == [] and at("Red", 8) == []


@pytest.mark.parametrize(
    "constraint, want",
    [
        (Enum("returnflag", "black"), [31]),
        (Multi("words", "soft"), [11, 31, 32]),
        (Bool("large", False), [12]),
        (Num("size", "=", 0), [31, 32]),
        (Num("size", ">", 8), [12]),
        (Num("size", ">=", -1), [11, 12, 31, 32]),
        (Num("returnflag", "=", 1), []),
        (Text("title", "Run"), []),
        (Text("title", "run"), [11, 12]),
        (Text("title", ""), [11, 12, 31, 32]),
        (Brand("Nike"), [11, 12]),
        (BrandAny(()), []),
    ],
)
def test_leaves_are_two_valued(shop, constraint, want):
    assert ids(shop.where(matches(constraint))) == want
    assert ids(shop.where(~matches(constraint))) == sorted({11, 12, 21, 31, 32} - set(want))


def test_empty_conjunction_is_everything(shop):
    assert ids(shop.where(all_match([]))) == [11, 12, 21, 31, 32]


@pytest.mark.parametrize("descending", [False, True])
def test_sort_puts_missing_last_and_ties_by_id(shop, descending):
    got = [r["variant_id"] for r in shop.orderBy(*sort_key("size", descending)).collect()]
    assert got == ([12, 11, 31, 32, 21] if descending else [31, 32, 11, 12, 21])
    old = [r["variant_id"] for r in shop.orderBy(*legacy_sort_key("size", descending)).collect()]
    assert old == ([12, 11, 31, 32, 21] if descending else [21, 31, 32, 11, 12])


def test_rank_takes_preferences_or_words(shop):
    q = Query((), (Preference(Enum("returnflag", "Red"), 0.5), Preference(Bool("large", True), 9.0)), residual=("running",))
    got = [(r["variant_id"], r["score"]) for r in ranked(shop, q, 3).collect()]
    assert got == [(12, 0.5), (32, 0.5), (11, 0.0)]
    words = [(r["variant_id"], r["score"]) for r in ranked(shop, Query(residual=("running", "soft")), 4).collect()]
    assert words == [(11, 3.0), (12, 2.0), (31, 1.0), (32, 1.0)]
    assert [r["score"] for r in narrowed(shop, shop, Query((Brand("Nike"),)), 5).collect()] == [0.0, 0.0]


def test_facets_leave_out_their_own_filter(shop):
    r = Request(category="c", filters=(("returnflag", "Red"),), facets=("returnflag", "words", "brand"))
    got = {(x["facet"], x["value"], x["n"]) for x in fx.facets(shop, r).collect()}
    assert got == {("returnflag", "Black", 1), ("returnflag", "Red", 1), ("brand", "Nike", 2 - 1)}
    many = {(x["request"], x["facet"], x["value"], x["n"]) for x in fx.facets_of_many(shop, {"a": r}).collect()}
    assert many == {("a", *g) for g in got}
    assert {(x["value"], x["n"]) for x in fx.facet(shop, "words").collect()} == {("light", 1), ("soft", 3)}
    assert fx.single_facet(shop, "words").count() == 0
    with pytest.raises(ValueError):
        fx.browse(shop, Request(category="nowhere"))


def test_page_limits(shop):
    assert Request(top_k=999).limit == 200 and Request().limit == 48
    assert [r["variant_id"] for r in page(shop, Request(sort="price_cents", top_k=2, offset=1)).collect()] == [31, 32]
    assert [r["variant_id"] for r in after(shop, (1, 12), 2).collect()] == [21, 31]


def test_ordinals_are_dense(spark):
    values = list(range(1000))
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v * 3,) for v in values], "k long").repartition(5)
    assert sorted((r["k"], r["ordinal"]) for r in with_ordinal(df, "k").collect()) == [(3 * i, i) for i in range(1000)]


def test_variant_attributes_win(spark):
    row = spark.sql("select map('a', '1', 'b', '2') as p, map('b', '3', 'c', '4') as v").select(effective(F.col("p"), F.col("v")).alias("m")).first()
    assert row["m"] == {"a": "1", "b": "3", "c": "4"}


def test_feeds(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text("\n".join(json.dumps({"query_id": k, "query": "q", "product_id": "p", "label": label}) for k, label in enumerate("ESXI")))
    assert [r["label"] for r in src.read_judgments(spark, str(tmp_path / "j.jsonl")).orderBy("query_id").collect()] == ["E", "S", "I"]
    (tmp_path / "r.jsonl").write_text(json.dumps({"id": "1", "title": "t"}) + "\n")
    assert src.read_records(spark, str(tmp_path / "r.jsonl")).first().asDict() == {"id": "1", "title": "t", "description": None, "bullets": None, "brand": None, "color": None}
    (tmp_path / "f.tsv").write_text('id\tbag\n1\ta:b|c : d:e|x|a:z\n')
    feed = src.read_feed(spark, str(tmp_path / "f.tsv"))
    assert {(r["key"], r["value"]) for r in src.feature_rows(feed, "id", "bag").collect()} == {("a", "b"), ("c", "d:e")}
    ids = spark.range(50).withColumnRenamed("id", "product_id")
    shop = src.synthetic(ids)
    assert shop.collect() == src.synthetic(ids).collect() and shop.count() == 100
    src.write_jsonl(shop, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 100
    assert json.loads(src.manifest(spark, run=1))["run"] == 1 and not math.isnan(1)


def test_pages_are_checked(spark):
    from mercantor.operators.search import pages

    rows = spark.createDataFrame([(i // 3, i) for i in range(11)], "product_id long, variant_id long")
    assert [len(p) for p in pages(rows, 4)] == [4, 4, 3] and [x for p in pages(rows, 4) for x in p] == [(i // 3, i) for i in range(11)]
    assert list(pages(rows.limit(0), 4)) == []
    with pytest.raises(ValueError):
        list(pages(rows.union(rows), 4))


def test_pushed_filters(spark, tmp_path):
    """A plain condition reaches the scan, and keeps what the two-valued form keeps."""
    from mercantor.model import Brand, Enum, Num, PriceOver
    from mercantor.operators.predicates import where_all

    rows = [(f"B{i % 3}" if i % 5 else None, "R" if i % 2 else None, float("nan") if i % 7 == 0 else float(i), i * 100) for i in range(60)]
    spark.createDataFrame(rows, "brand string, returnflag string, quantity double, price_cents long").write.parquet(str(tmp_path / "c"))
    shop = spark.read.parquet(str(tmp_path / "c"))
    for cs in ([Brand("B1"), Enum("returnflag", "R")], [Num("quantity", ">", 9.0), PriceOver(1500)], [Num("price", "<=", 1550.5)], [Num("price", "=", 0.5)], [Num("quantity", "=", 8.0)]):
        plain = where_all(shop, cs)
        assert sorted(map(repr, plain.collect())) == sorted(map(repr, shop.where(all_match(cs)).collect()))
    plan = where_all(shop, [Brand("B1"), PriceOver(1500)])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(brand,B1)" in plan and "GreaterThan(price_cents,1500)" in plan


def test_many_requests_are_single_ones(spark, shop):
    """More requests than one mask holds, each compared with its own pass."""
    from mercantor.model import Request
    from mercantor.operators import facets as fx

    brands = [r["brand"] for r in shop.select("brand").distinct().orderBy("brand").collect()]
    requests = {f"r{i}": Request(filters=(("returnflag", "RA"[i % 2]),) if i % 3 else (), any_filters=(("brand", tuple(brands[: 1 + i % 2])),) if i % 4 else (), ranges=(("size", ">=", float(i % 12)),), facets=("brand", "words", "returnflag")) for i in range(70)}
    many = sorted((r["request"], r["facet"], r["value"], r["n"]) for r in fx.facets_of_many(shop, requests).collect())
    for k in ("r0", "r1", "r7", "r61", "r62", "r69"):
        single = sorted((k, r["facet"], r["value"], r["n"]) for r in fx.facets(shop, requests[k]).collect())
        assert single == [m for m in many if m[0] == k]


def test_an_index_follows_its_files(spark, sf_dir, tmp_path):
    from mercantor.index import opened

    for t in ("part", "lineitem", "supplier", "nation", "region"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    first = opened(spark, str(tmp_path))
    assert opened(spark, str(tmp_path)).path == first.path
    n = first.table(spark, "catalog").count()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_orderkey % 2 = 0").write.mode("overwrite").parquet(str(tmp_path / "lineitem.parquet"))
    second = opened(spark, str(tmp_path))
    assert second.path != first.path and 0 < second.table(spark, "catalog").count() < n
