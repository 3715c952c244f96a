import re

import pytest

from mercantor.llm import mixing as mx

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    """Brute force: shares by weight, capped and shared again until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    capped, left = {}, 1.5 * sum(sizes.values())
    free = set(order)
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sizes[s] + 1e-9}
        if not over:
            return capped | {s: left * weight[s] / total for s in free}
        for s in over:
            capped[s] = 2 * sizes[s]
        left -= sum(2 * sizes[s] for s in over)
        free -= over


def docs(spark):
    rows = [(i, "w " * (i * 13 % 40), ["hot", "b", "é", "Z", None, "tiny"][0 if i % 3 else i // 3 % 6]) for i in range(900)]
    rows += [(2000, None, "b"), (2001, "", "tiny"), (2002, "one\v\ttwo", "b"), (2003, None, "nothing"), (5, "w " * (5 * 13 % 40), "hot")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_and_taking(spark):
    rows, df = docs(spark)
    out = mx.digest(df).collect()
    assert len(out) == len(rows)
    size = lambda t: len(WORD.findall(t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 40 for s in sizes)
    again = mx.digest(df.repartition(5)).collect()
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_take_repeats_rows(spark):
    _, df = docs(spark)
    more = df.selectExpr("*", "'x' as size", "1 as target")
    taken = mx.take(more)
    assert taken.columns == more.columns
    total = sum(len(WORD.findall(r["text"] or "")) for r in taken.collect())
    assert total == sum(r["taken"] for r in mx.digest(df).collect())


def test_empty_and_wordless(spark):
    _, df = docs(spark)
    assert mx.digest(df.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r["target"], r["taken"]) for r in mx.digest(blank).collect()} == {(0.0, 0)}


def test_refinement_over_crowded_buckets(spark, monkeypatch):
    """With one bit a level and many rows in each bucket, the boundary is still found to a row."""
    monkeypatch.setattr(mx, "LEVEL_BITS", 4)
    monkeypatch.setattr(mx, "LEVELS", 6)
    monkeypatch.setattr(mx, "BITS", 24)
    df = spark.createDataFrame([(i, "w w w", "ab"[i % 2]) for i in range(2000)], "doc_id long, text string, source string")
    out = mx.digest(df).collect()
    for s in "ab":
        own = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 3


def test_no_python_in_the_plan(spark):
    _, df = docs(spark)
    assert not re.search("PythonUDF|Pandas|Arrow|MapIn", mx.mix(df)._jdf.queryExecution().toString())
