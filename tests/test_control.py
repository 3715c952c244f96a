from mercantor.model import Brand, Enum, Num, Preference, ProductType, Query
from mercantor.plans import control as ct
from mercantor.plans.compile import Lexicon

BASE = ct.Context(Lexicon({"nike": (Brand("Nike"),), "shoes": (ProductType("Shoes"),)}))
TEXTS = ["nike shoes", "nike trainers", "trainers", "odd words"]


class Judge:
    def __init__(self, *answer):
        self.answer = answer or None

    def judge(self, text, query):
        return self.answer


def test_promotion(spark):
    terms = spark.createDataFrame([("trainers", 9), ("nike", 8), ("odd", 1)], "term string, n int")
    provider = ct.FixedProvider({"trainers": (ProductType("Shoes"),), "nike": (Brand("Other"),)})
    new = ct.candidate(BASE, provider, terms)
    assert new.phrases["nike"] == (Brand("Nike"),) and "trainers" in new.phrases
    assert ct.replay(TEXTS, BASE.lexicon, new) == ct.Replay((), ("nike trainers", "trainers"))
    after, verdict = ct.promote(BASE, new, TEXTS)
    assert verdict == "promoted" and after.version == 2 and after.lexicon.version == 2
    assert ct.promote(BASE, BASE.lexicon, TEXTS)[1] == "no_improvement"
    assert ct.promote(BASE, Lexicon({"shoes": (ProductType("Shoes"),)}), TEXTS)[1] == "regression"
    assert ct.promote(BASE, new, TEXTS, Judge(10, 1, 5))[1] == "imprecise"
    assert ct.promote(BASE, new, TEXTS, Judge(0, 0, 5))[1] == "imprecise"
    assert ct.promote(BASE, new, TEXTS, Judge(10, 9, 9))[1] == "promoted" == ct.promote(BASE, new, TEXTS, Judge())[1]


def test_enrichment():
    assert ct.with_implied_brand(Query(), {"A"}).constraints == (Brand("A"),)
    assert ct.with_implied_brand(Query(), {"A", "B"}) == Query()
    own = Query((Brand("C"),))
    assert ct.with_implied_brand(own, {"A"}) == own


def test_size_treatments():
    lex = Lexicon({"shoes": (ProductType("Shoes"),), "9": (Enum("width", "9"),), "7": (Enum("width", "7"), Enum("fit", "7"))})
    number, width = Num("size", "=", 9.0), Enum("width", "9")
    kinds = lambda have: lambda product_type, attr: have.get((product_type, attr), set())
    assert ct.resolve("shoes size 9", lex, "a") == (Query((ProductType("Shoes"), number)),)
    assert ct.resolve("shoes size 9", lex, "b") == (Query((ProductType("Shoes"), number)), Query((ProductType("Shoes"), width)))
    (c,) = ct.resolve("shoes size 9", lex, "c")
    assert c == Query((ProductType("Shoes"),), (Preference(number, 0.5), Preference(width, 0.5)), residual=("9",))
    assert ct.resolve("shoes size 9", lex, "d", kinds({("Shoes", "width"): {"enum"}})) == (Query((ProductType("Shoes"), width)),)
    assert ct.resolve("shoes size 9", lex, "e", kinds({("Shoes", "size"): {"number"}})) == (Query((ProductType("Shoes"), number)),)
    both = {("Shoes", "size"): {"number"}, ("Shoes", "width"): {"enum"}}
    assert ct.resolve("shoes size 9", lex, "d", kinds(both)) == (c,) == ct.resolve("shoes size 9", lex, "d")
    assert ct.resolve("size 7", lex, "d") == ct.resolve("size 7", lex, "c") and len(ct.resolve("size 7", lex, "b")) == 3
    assert all(ct.resolve("shoes size 8", lex, t) == (Query((ProductType("Shoes"), Num("size", "=", 8.0))),) for t in "abcde")


def test_stages():
    import pytest

    assert ct.advance(ct.advance("proposed", "replayed"), "promoted") == "promoted"
    with pytest.raises(ValueError):
        ct.advance("rejected", "promoted")


def test_promoted_is_the_latest_stage(spark):
    rows = [("a", "b", "proposed", 1), ("a", "b", "promoted", 2), ("c", "b", "promoted", 1), ("c", "b", "retired", 2)]
    assert [tuple(r) for r in ct.promoted(spark.createDataFrame(rows, "narrow string, wide string, stage string, version int")).collect()] == [("a", "b")]
