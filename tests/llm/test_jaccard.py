import random
import re

import pytest

from mercantor.llm import jaccard as jc
from mercantor.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(rows):
    own = {}
    for i, t in rows:
        own.setdefault(i, []).append(sets(t))
    parent = {i: i for i in own}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(own)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in own[a] for y in own[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(3))
    rows, k = [], 0
    common = [word() for _ in range(30)]
    for group in range(40):
        base = [word() for _ in range(rng.choice([1, 3, 5, 6, 8, 12, 30, 60, 64, 70, 130, 200]))]
        if group % 5 == 0:
            base[len(base) // 2 : len(base) // 2] = common
        chain = base
        for _ in range(rng.choice([1, 1, 2, 4, 9])):
            text = list(chain)
            for _ in range(rng.randrange(0, 3)):
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.3:
                text = text + [word() for _ in range(len(text) // 8)]
            chain = text if rng.random() < 0.5 else chain
            k += 1
            rows.append((k * 7 % 1009, " ".join(text)))
    return rows


@pytest.mark.parametrize("seed", [3, 4])
def test_components_are_those_of_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(jc, "CELL", 4)
    monkeypatch.setattr(jc, "CELL_SHINGLES", 900)
    rows = corpus(seed)
    rows += [(2001, None), (2002, ""), (2003, " \n"), (2004, "A b"), (2005, "a B"), (2006, rows[0][1]), (2006, rows[5][1]), rows[9]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jc.digest(df).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert sorted((r["doc_id"], r["n_shingles"]) for r in got) == sorted((i, len(sets(t))) for i, t in rows)
    kept = sorted(r["doc_id"] for r in jc.keep_one(df).collect())
    assert kept == sorted(set(want.values()))


def test_hot_groups_stay_linear(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(i, " ".join(base)) for i in range(300)]
    for i in range(300, 600):
        t = list(base)
        t[rng.randrange(120)] = f"own{i}"
        rows.append((i, " ".join(t)))
    got = jc.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["component"] for r in got["rows"].collect()} == {0}
    assert got["links"].count() <= 3 * 301


def test_blocks_meet_for_every_linked_pair():
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(1))
    for n in [*range(1, 70), 95, 127, 128, 300, 1000]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            lose, add = (0, n // 3) if rng.random() < 0.5 else (n // 7, n // 7)
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[lose:]], rng.integers(0, 1 << 63, add, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 75 * (len(a) + len(b) - both):
                ta, tb = (set(jc.blocks(np.array([0, len(x)]), x)[1].tolist()) for x in (a, b))
                assert ta & tb
                far = int(np.bitwise_count(np.bitwise_xor(*jc.folded([jc.sketch(a), jc.sketch(b)]))).sum())
                assert far <= len(a) + len(b) - 2 * both


def test_empty_ids_and_clashes(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in jc.digest(df).collect()} == {(None, None), (1, 1), (2, 1)}
    assert jc.keep_one(df.selectExpr("*", "1 as id", "2 as rep")).count() == 2
    assert jc.digest(df.limit(0)).count() == 0 and jc.keep_one(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(40)] + [(500, 500)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)
