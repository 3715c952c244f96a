"""Text to query, lexicon rules, routing and admission."""

import pytest
from pyspark.sql import functions as F

from mercantor.model import Brand, Category, Enum, Multi, Num, Preference, PriceOver, PriceUnder, ProductType, Query
from mercantor.operators import lexical as lex
from mercantor.plans import planner as pl
from mercantor.plans.compile import Lexicon, compile_corpus, compile_text, money, query_of_row
from mercantor.plans.sql import where_all

LEX = Lexicon(
    {
        "nike": (Brand("Nike"),),
        "adi": (Brand("Adi"),),
        "running shoes": (ProductType("Shoes"),),
        "shoes": (ProductType("Shoes"),),
        "boots": (ProductType("Boots"),),
        "outdoor": (Category("Outdoor"),),
        "red": (Enum("color", "Red"),),
        "black": (Enum("color", "Black"),),
        "soft": (Multi("words", "soft"),),
        "sneakers": (Preference(ProductType("Shoes"), 0.9),),
        "leather": (Enum("material", "Leather"), Enum("style", "Leather")),
        "the north": (Brand("The North"),),
    }
)


@pytest.mark.parametrize(
    "text, constraints, preferences, ambiguous, residual",
    [
        ("Black Nike running shoes size 9 under $150", (Enum("color", "Black"), Brand("Nike"), ProductType("Shoes"), Num("size", "=", 9.0), PriceUnder(15000)), 0, (), ()),
        ("running shoes", (ProductType("Shoes"),), 0, (), ()),
        ("nike not red shoes", (Brand("Nike"), ProductType("Shoes")), 0, (), ("red",)),
        ("nike without laces", (Brand("Nike"),), 0, (), ("laces",)),
        ("nike adi shoes", (Brand("Nike"), ProductType("Shoes")), 0, (), ("adi",)),
        ("nike nike", (Brand("Nike"), Brand("Nike")), 0, (), ()),
        ("shoes red black", (ProductType("Shoes"), Enum("color", "Red")), 0, (), ("black",)),
        ("red", (), 1, (), ("red",)),
        ("red size 9", (Num("size", "=", 9.0),), 1, (), ("red",)),
        ("red under 10", (PriceUnder(1000),), 1, (), ("red",)),
        ("sneakers for nike", (Brand("Nike"),), 1, (), ("sneakers",)),
        ("leather boots", (ProductType("Boots"),), 0, ("leather",), ()),
        ("size matters", (), 0, (), ("size", "matters")),
        ("over the hill", (), 0, (), ("over", "hill")),
        ("boots over 12.345", (ProductType("Boots"), PriceOver(1235)), 0, (), ()),
        ("the north boots", (Brand("The North"), ProductType("Boots")), 0, (), ()),
        ("", (), 0, (), ()),
        ("not", (), 0, (), ()),
    ],
)
def test_compile(text, constraints, preferences, ambiguous, residual):
    q = compile_text(text, LEX)
    assert q.constraints == constraints and len(q.preferences) == preferences
    assert tuple(a.text for a in q.ambiguous) == ambiguous and q.residual == residual


def test_money():
    assert money("$1.005") == 100 and money("2.5") == 250 and money("x") is None and money(None) is None and money("9d") is None


def test_corpus_is_the_same_scan(spark):
    texts = ["red nike", None, "leather boots no red"]
    got = compile_corpus(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string"), LEX).orderBy("k").collect()
    for r, t in zip(got, texts, strict=True):
        q = compile_text(t or "", LEX)
        assert query_of_row(r) == q


@pytest.fixture(scope="module")
def shop(spark):
    rows = [(p, 10 * p + v, f"B{p % 2}", "T0" if p < 6 else "T1", f"red thing{p}" if p % 3 else "blue thing", 100 * p) for p in range(10) for v in range(2)]
    return spark.createDataFrame(rows, "product_id long, variant_id long, brand string, product_type string, title string, price_cents long").withColumn("words", F.split("title", " "))


def test_routes(shop):
    p = pl.Policy(threshold=0.5)
    assert pl.route(shop, Query(), p) == "FastPath"
    assert pl.route(shop, Query(residual=("x",)), p) == "Punt"
    assert pl.route(shop, Query((PriceUnder(200),), residual=("x",)), p) == "Hybrid"
    assert pl.selectivity(shop, Query()) == (20, 2.0)
    assert pl.route(shop, Query((Brand("B0"),), residual=("x",)), p) == "Punt"


def test_admission_order_and_cap(shop):
    some = Query((PriceUnder(300),))
    assert pl.admit(shop, some, pl.Policy(cap=6)) == "admitted" and pl.admit(shop, some, pl.Policy(cap=5)) == "too_many"
    assert pl.admit(shop, Query()) == "no_constraint" and pl.admit(shop, Query(residual=("x",))) == "residual"
    posts = lex.postings(shop.select("product_id", "title").distinct(), "product_id", text="title")
    narrow = lambda words, **k: pl.admit_narrowed(shop, posts, Query((Brand("B1"),), residual=words), **k)
    assert narrow(("red",)) == "admitted" and narrow(("nowhere",)) == "ineligible" and narrow(()) == "ineligible"
    assert narrow(("red thing1",), single=True) == "not_single"
    assert pl.admit_narrowed(shop, posts, Query(residual=("red",)), anchored=True) == "no_constraint"
    assert sorted(r["product_id"] for r in lex.having_all(posts, ["red", "thing1"], "product_id").collect()) == [1]
    assert lex.having_all(posts, [], "product_id").count() == 0


class Words:
    """A delegate that scores products by how many of the words their titles hold."""

    def __init__(self, shop):
        self.posts = lex.postings(shop.select("product_id", "title").distinct(), "product_id", text="title")

    def search(self, terms, restrict, limit):
        hits = self.posts.where(F.col("token").isin(terms)).groupBy("product_id").agg(F.count("*").cast("double").alias("score"))
        if restrict is not None:
            hits = hits.join(restrict, "product_id", "left_semi")
        return hits.orderBy(F.desc("score"), "product_id").limit(limit)


def test_hits_are_verified(shop):
    q = Query((Brand("B1"),), residual=("red",))
    got = [(r["product_id"], r["variant_id"]) for r in pl.run(shop, q, 3, Words(shop)).collect()]
    assert got == [(1, 10), (5, 50), (7, 70)]
    fast = pl.run(shop, Query((PriceUnder(100),)), 5, Words(shop)).collect()
    assert [(r["product_id"], r["variant_id"]) for r in fast] == [(0, 0), (0, 1)]


def test_texts_compile_to_the_queries_of_the_plans(spark, sf_dir):
    from mercantor.queries import planning as pg

    lex_ = pg.lexicon(spark, "/root/testdata/sf0.01")
    assert {k: compile_text(t, lex_) for k, (t, _) in pg.TEXTS.items()} == pg.QUERIES


def test_many_are_answered_as_one_by_one(spark, sf_dir):
    from mercantor.catalog import catalog
    from mercantor.plans import lexicon as lx
    from mercantor.queries import planning as pg

    c = catalog(spark, sf_dir)
    by, breadth = pl.TitleRanking(c), lx.breadth(c)
    many = sorted(map(tuple, pl.run_many(c, pg.QUERIES, 7, by, pg.POLICY, breadth).collect()))
    for name in ("hybrid", "punt", "unknown", "words", "priced"):
        one = [(name, *r) for r in map(tuple, pl.run(c, pg.QUERIES[name], 7, by, pg.POLICY, breadth).collect())]
        assert sorted(one) == [m for m in many if m[0] == name]
    hits = spark.createDataFrame([("a", 1, 1000001, 2.0), ("a", 2, None, 1.0), ("b", 1, 999, 3.0)], f"query string, {pl.HITS}")
    assert {r["query"] for r in pl.verify_many(hits, c, {"a": Query(), "b": Query()}, 9).collect()} <= {"a"}


def test_named_variants_are_never_replaced(spark, shop):
    hits = spark.createDataFrame([(1, 11, 3.0), (2, 20, 2.0), (4, None, 1.0)], pl.HITS)
    q = Query((Brand("B1"),))
    assert [tuple(r) for r in pl.verify(hits, shop, q, 9).collect()] == [(1, 11, 3.0)]
    assert [r["product_id"] for r in pl.verify(hits, shop, Query((Brand("B0"),)), 9).collect()] == [2, 4]


def test_sql_text_quotes():
    assert "O''Neill" in where_all([Brand("O'Neill")])
