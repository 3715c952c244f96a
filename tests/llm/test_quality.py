import random
import re
from collections import Counter

from mercantor.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    cover = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


def cases():
    rng = random.Random(4)
    out = [None, "", " \n\t\v ", "one", "a b", "a b c", "a b c a b c", "x " * 50, "é ü\n" * 9, "#$ <p>\nl1\nl1\n \nl1", "a a a a", "long " * 3000 + "end"]
    out += [" ".join(rng.choice("abcd") for _ in range(rng.randrange(90))) for _ in range(40)]
    return [*out, out[6], out[6]]


def test_measurements(spark):
    df = spark.createDataFrame(list(enumerate(cases())), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[m] for m in q.MEASURES) for r in q.verdicts(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(cases())}


def test_policies_read_the_ledger(spark):
    df = spark.createDataFrame(list(enumerate(cases())), "doc_id long, text string")
    book = q.ledger(df)
    for policy in q.POLICIES:
        kept = {r["doc_id"] for r in q.apply_policy(book, policy).where("kept").collect()}
        want = set()
        for r in book.collect():
            names = {name for k, name in enumerate(q.RULES) if r["failed"] >> k & 1}
            if not names & set(policy.rules):
                want.add(r["doc_id"])
        assert kept == want
    rows = {r["rule"]: r for r in q.ablation(book, q.BASE).collect()}
    few = {i for i, t in enumerate(cases()) if brute(t)[0] < 50}
    again = {i for i, t in enumerate(cases()) if 100 * brute(t)[4] > 50 * brute(t)[0]}
    n = len(cases())
    assert rows["few_words"]["n_failed"] == len(few) and rows["few_words"]["n_failed_alone"] == len(few - again)
    assert rows["repeated_windows"]["n_kept_without"] == n - len(few) and rows["few_words"]["n_kept"] == n - len(few | again)


def test_clean_prose_is_kept_and_base_failures_are_not(spark):
    rng = random.Random(7)
    clean = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(200)).replace("a", "é", 3)
    df = spark.createDataFrame([(1, clean), (2, "a few words"), (3, "the same words again " * 40), (4, " ".join(f"w{i}&&&" for i in range(90)))], "doc_id long, text string")
    rows = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in q.verdicts(df).collect()}
    assert rows == {1: (False, True), 2: (True, False), 3: (True, False), 4: (False, False)}


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(60)), "mine", None)], "doc_id long, text string, n_words string, failed string")
    assert [tuple(r) for r in q.keep_good(df).collect()] == [tuple(r) for r in df.collect()]
    assert q.keep_good(df).columns == df.columns
    assert q.verdicts(df.limit(0)).count() == 0 and q.ablation(q.ledger(df.limit(0)), q.BASE).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for made in (q.verdicts(df), q.ledger(df), q.keep_good(df)):
        assert not re.search("Python|Pandas|Arrow", made._jdf.queryExecution().toString())
