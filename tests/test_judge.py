from mercantor.functions import judge as jd

GOOD = jd.FieldFacts(0.95, 30, 0.99, 500, True)
WEAK = jd.FieldFacts(0.2, 30, 0.1, 500, False)


def test_votes():
    assert jd.plurality(["enum", "numeric", "enum"]) == "enum" and jd.plurality(["numeric", "enum"]) == "enum" and jd.plurality([]) is None
    assert jd.canonical_role([None, None], GOOD) is None
    assert jd.canonical_role(["enum", "numeric"], WEAK) == "enum" and jd.canonical_role(["enum", "numeric"], GOOD) == "numeric"
    assert jd.canonical_role(["identifier"], GOOD) == "identifier" and jd.canonical_role(["identifier"], WEAK) == "enum"
    assert jd.canonical_role(["relationship"], GOOD) is None and jd.canonical_role(["enum", "free_text", None], WEAK, conservative=True) is None
    assert jd.canonical_role(["enum"], jd.FieldFacts(0, 1, 0, 9, False)) is None


def test_consensus_stops_when_no_continuation_changes_it():
    role, used = jd.consensus(["enum"] * 9, WEAK, 9)
    assert role == "enum" and used == 5
    assert jd.consensus(["enum", "free_text"] * 3, WEAK, 6)[1] == 6


def test_gates_and_fits():
    a = jd.Coverage(frozenset("ab"), 4)
    assert jd.coverage_gate(a, jd.Coverage(frozenset("abc"), 4)) and not jd.coverage_gate(a, a) and not jd.coverage_gate(a, jd.Coverage(frozenset("acd"), 4))
    assert jd.facet_path(10, 1, True) == "bitmap" and jd.facet_path(10, 1, False) == "ordinal" and jd.sort_path(1000, 48, 2000) == "presorted" and jd.sort_path(10, 48, 5000) == "scan"


def test_threshold_fit(spark):
    fit = lambda rows: [tuple(r) for r in jd.threshold_fit(spark.createDataFrame(rows, "x double, below double, above double")).collect()]
    assert fit([]) == []
    assert fit([(1.0, 1.0, 9.0), (4.0, 1.0, 9.0), (16.0, 9.0, 1.0), (64.0, 9.0, 1.0)]) == [(8.0, 4.0, True)]
    assert fit([(1.0, 1.0, 9.0), (4.0, 1.0, 9.0)]) == [(None, 2.0, False)]


def test_canonical_roles_of_the_whole_table(spark, sf_dir):
    from mercantor.queries.judging import d_canonical_roles

    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand", "p_type").distinct().collect()
    got = [r["field"] for r in d_canonical_roles(spark, sf_dir).collect()]
    assert sorted(got) == sorted(f"{r['p_brand']} {r['p_type']}" for r in part) and len(got) > 19
