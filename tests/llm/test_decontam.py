import random
import re

import numpy as np

from mercantor.llm import decontam as dc

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").encode().lower())


def brute(docs, items, n=13):
    out = []
    for text in docs:
        w, hit, ids = words(text), set(), set()
        for item, it in items:
            x = words(it)
            if not x:
                continue
            k = min(n, len(x))
            wins = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in wins:
                    hit |= set(range(i, i + k))
                    ids.add(item)
        out.append((len(w), len(hit), len(ids), dc.sha256_of(sorted(ids)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def tables(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(30)] + ["É", "Q-q", "x'y"]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(10, prose(30)), (9, prose(13)), (2, prose(5)), (3, "rare"), (4, ""), (5, None), (6, "..."), (7, prose(40))]
    items.append((11, items[0][1]))
    docs = [None, "", "!!!", items[0][1], prose(300) + " " + items[0][1].upper() + " " + prose(300), items[1][1] + ". " + items[1][1], prose(2000), "rare", "a rare, rare thing", " ".join(words(items[7][1])[i].decode() for i in range(12))]
    docs += [prose(50) + ", " + " ".join(items[7][1].split()[k : k + 16]) + "\n" + prose(40) for k in range(0, 20, 3)] + [docs[3]]
    return docs, items, spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_hits(spark):
    docs, items, d, b = tables(spark)
    want = brute(docs, items)
    for size in (dc.SLICE_BYTES, 120):  # one broadcast, and several smaller ones
        got = dc.digest(dc.judge(d, b, slice_bytes=size)).orderBy("doc_id").collect()
        assert [tuple(r)[1:] for r in got] == want


def test_removal(spark):
    docs, items, d, b = tables(spark)
    want = brute(docs, items)
    kept = [r["doc_id"] for r in dc.remove_documents(d, b).orderBy("doc_id").collect()]
    assert kept == [i for i, w in enumerate(want) if not w[4]]
    for r in dc.remove_spans(d, b).collect():
        n, hit = want[r["doc_id"]][:2]
        assert len(words(r["text"])) == n - hit and (hit or r["text"] == docs[r["doc_id"]])


def test_empty_and_clashing(spark):
    _, _, d, b = tables(spark)
    assert {r["n_hit"] for r in dc.judge(d, b.limit(0)).collect()} == {0}
    assert dc.judge(d.limit(0), b).count() == 0
    clash = d.selectExpr("doc_id", "text", "'mine' as items", "1 as n_hit")
    assert dc.remove_documents(clash, b).columns == clash.columns
    assert dict(dc.judge(clash, b).dtypes)["n_hit"] == "bigint"


def test_unions_of_runs():
    rng = random.Random(1)
    for _ in range(200):
        sets = [{k for k in range(20) if rng.random() < 0.4} for _ in range(2)]
        runs = []
        for s in sets:
            own = np.zeros(22, np.int8)
            own[[k + 1 for k in s]] = 1
            runs.append(np.flatnonzero(np.diff(own)))
        got = dc.union_runs(*runs)
        cover = {k for a, b in np.asarray(got).reshape(-1, 2) for k in range(a, b)}
        assert cover == sets[0] | sets[1]


def test_items_without_an_id_hit(spark):
    import duckdb

    from mercantor.llm.queries import ORACLES

    text = " ".join(f"w{k}" for k in range(20))
    docs = [(1, f"before {text} after"), (2, "nothing of it"), (3, f"{text} and also {text.upper()} v1 v2 rare")]
    bench = [(None, text), (None, "rare"), (7, "rare")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = sorted(tuple(r) for r in dc.digest(dc.judge(d, b)).collect())
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar); create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    con.executemany("insert into benchmark values (?, ?)", bench)
    assert got == sorted(con.sql(ORACLES["op2_decontamination"]).fetchall())
    assert [r[3] for r in got] == [1, 0, 2] and [r["doc_id"] for r in dc.remove_documents(d, b).collect()] == [2]
