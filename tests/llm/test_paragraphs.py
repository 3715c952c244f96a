import random

from mercantor.llm import paragraphs as pg


def prose(rng, n, stop=9):
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n)]
    return " ".join(w + ("." if k % stop == stop - 1 else "") for k, w in enumerate(words))


def test_repeated_passages(spark):
    rng = random.Random(4)
    passage, line = prose(rng, 60), prose(rng, 40, 99)
    edited = line.split()
    edited[20] = "changed"
    rows = [(i, prose(rng, 120) + "\n" + prose(rng, 30)) for i in range(30)]
    rows += [(100, f"{prose(rng, 50)} {passage} {prose(rng, 40)}"), (101, f"{prose(rng, 33)} {passage} {prose(rng, 71)}")]
    rows += [(102, f"{prose(rng, 20)}\n{line}\n{prose(rng, 20)}"), (103, f"{prose(rng, 25)}\n{' '.join(edited)}")]
    twice = prose(rng, 30)
    rows += [(104, f"{twice}\n{twice}"), (105, None), (106, ""), (None, passage), (107, "Short line.\nShort line."), (108, "Short line.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = pg.repeats(df).collect()
    assert {r["doc_id"] for r in got} == {100, 101, 102, 103}
    assert {r["doc_id"] for r in got if r["removed"]} == {101, 103}
    texts = dict(rows)
    for r in got:
        span = texts[r["doc_id"]].encode()[r["start"] : r["end"]].decode()
        assert len(span.split()) == r["n_words"] >= 16
    cut = {r["doc_id"]: r["text"] for r in pg.remove(df).collect()}
    assert cut[100] == texts[100] and len(cut[101].split()) < len(texts[101].split()) - 40 and "changed" not in cut[103]
    assert pg.repeats(df.limit(0)).count() == 0


def test_passages_need_no_sentence_ends(spark):
    rng = random.Random(11)
    short, long = prose(rng, 55, 3), prose(rng, 55, 99)
    mixed = " ".join(f"{prose(rng, 13, 13)} {prose(rng, 2, 2)}" for _ in range(4))
    wrapped = prose(rng, 54, 9).split()
    lines = ["\n".join(" ".join(wrapped[k : k + w]) for k in range(0, 54, w)) for w in (7, 11)]
    rows = [(i, prose(rng, 90)) for i in range(40)]
    for k, (a, b) in enumerate([(short, short), (long, long), (mixed, mixed), lines]):
        rows += [(100 + 2 * k, f"{prose(rng, 31, 99)} {a} {prose(rng, 22, 99)}"), (101 + 2 * k, f"{prose(rng, 45, 99)} {b} {prose(rng, 9, 99)}")]
    texts = dict(rows)
    got = pg.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [short, short, long, long, mixed, mixed, *lines]
    spans = {r["doc_id"]: texts[r["doc_id"]].encode()[r["start"] : r["end"]].decode() for r in got}
    assert len(got) == 8 and spans == {100 + k: w for k, w in enumerate(want)}
    assert all(r["n_words"] == len(want[r["doc_id"] - 100].split()) and r["removed"] == (r["doc_id"] % 2 == 1) for r in got)


def test_passages_against_brute_force(spark):
    rng = random.Random(12)
    pool = [prose(rng, rng.randrange(5, 40), 7).split() for _ in range(12)]
    rows = []
    for i in range(40):
        words = sum((rng.choice(pool)[rng.randrange(4) :] if rng.random() < 0.6 else prose(rng, 9).split() for _ in range(6)), [])
        rows.append((i, " ".join(words)))
    own = {i: t.split() for i, t in rows}
    where: dict = {}
    for i, w in own.items():
        for k in range(len(w) - pg.RUN_WORDS + 1):
            where.setdefault(tuple(w[k : k + pg.RUN_WORDS]), set()).add(i)
    want = {(i, k + o) for i, w in own.items() for k in range(len(w) - pg.RUN_WORDS + 1) if len(where[tuple(w[k : k + pg.RUN_WORDS])]) > 1 for o in range(pg.RUN_WORDS)}
    got = set()
    for r in pg.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).where("kind = 'passage'").collect():
        before = len(dict(rows)[r["doc_id"]].encode()[: r["start"]].decode().split())
        got |= {(r["doc_id"], before + k) for k in range(r["n_words"])}
    assert want and got == want


def test_no_stretch_is_removed_everywhere(spark):
    rng = random.Random(13)
    early, late = prose(rng, 40, 8), prose(rng, 40, 8)
    line, new = prose(rng, 240, 10).split(), prose(rng, 30, 99)
    rows = [(i + 1000, prose(rng, 90)) for i in range(30)]
    rows += [(5, f"{prose(rng, 30)} {early} {prose(rng, 30)}"), (9, f"{prose(rng, 30)} {early} {late} {prose(rng, 30)}"), (12, f"{prose(rng, 30)} {early} {late} {prose(rng, 30)}")]
    rows += [(14, f"{prose(rng, 30)} {late} {prose(rng, 30)}"), (20, " ".join(line)), (21, " ".join([*line[:50], new, *line[50:]])), (22, f"{prose(rng, 40)} {new} {prose(rng, 40)}"), (23, f"{prose(rng, 40)} {new} {prose(rng, 40)}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = {r["doc_id"]: r["text"].split() for r in pg.remove(df).collect()}
    stretches = lambda words: {tuple(words[k : k + pg.RUN_WORDS]) for k in range(len(words) - pg.RUN_WORDS + 1)}
    stay = set().union(*map(stretches, left.values()))
    for passage in (early, late, new, f"{early} {late}"):
        assert stretches(passage.split()) <= stay
    assert " ".join(left[9]).count(late) == 1 and late not in " ".join(left[12] + left[14]) and early not in " ".join(left[12])
    assert not left[21] and new in " ".join(left[22]) and new not in " ".join(left[23])  # the line of 21 goes as a near copy
    assert {w for words in left.values() for w in words} <= {w for _, t in rows for w in t.split()}  # no words are glued


def test_copies_follow_their_class(spark):
    rng = random.Random(15)
    part, text, tiny = prose(rng, 40), prose(rng, 70, 9), prose(rng, 12)
    big = 1 << 62
    rows = [(big + 1, f"{prose(rng, 20)} {part} {prose(rng, 30)}")] + [(big + 10 + i, f"{text[:200]}\n{part}\n{text[200:]}") for i in range(4)]
    rows += [(-5, tiny), (-6, tiny), (-big, "\n".join([text[:200], text[200:]])), rows[2], (7, prose(rng, 50)), (8, "x " * 3000), (9, "x " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = pg.repeats(df.selectExpr("*", "1 as k", "2 as n", "'x' as rep")).collect()
    assert {r["doc_id"] for r in got} == {-big, *(big + 10 + i for i in range(4)), big + 1, 8, 9}
    texts = dict(rows)
    for r in got:
        assert len(texts[r["doc_id"]].encode()[r["start"] : r["end"]].decode().split()) == r["n_words"]
    left = {r["doc_id"]: r["text"].split() for r in pg.remove(df).collect()}
    assert all(not left[big + 10 + i] for i in range(1, 4)) and not left[9] and len(left[8]) == 3000
    assert " ".join(left[big + 1]).count(part) == 1 and left[-big] == texts[-big].split()
    stretches = lambda words: {tuple(words[k : k + pg.RUN_WORDS]) for k in range(len(words) - pg.RUN_WORDS + 1)}
    assert set().union(*(stretches(t.split()) for t in texts.values())) - {tuple(["x"] * pg.RUN_WORDS)} <= set().union(*map(stretches, left.values())) | stretches(texts[big + 10].split())


def test_short_repeats_are_no_passages(spark):
    """With more words asked for, only whole runs of so many count, however their parts are kept."""
    rng = random.Random(16)
    short, first, second = prose(rng, 40, 99), prose(rng, 30, 99), prose(rng, 30, 99)
    around = lambda x: f"{prose(rng, 20, 99)} {x} {prose(rng, 20, 99)}"
    rows = [(1, around(short)), (2, around(short)), (3, around(first)), (4, around(f"{first} {second}")), (5, around(f"{first} {second}")), (6, around(second))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    own = {i: t.split() for i, t in rows}
    for least in (pg.RUN_WORDS, 48):
        got = pg.repeats(df, least=least).collect()
        assert {r["doc_id"] for r in got} == ({1, 2, 3, 4, 5, 6} if least == pg.RUN_WORDS else {4, 5})
        assert sum(r["n_words"] for r in got if r["doc_id"] == 5) == 60 and all(r["removed"] for r in got if r["doc_id"] == 5)
    assert len(own[5]) == 100


def test_banding_recall():
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(3))
    found = 0
    for _ in range(400):
        a = rng.integers(0, 1 << 62, 70, dtype=np.uint64)
        b = np.concatenate([a[:60], rng.integers(0, 1 << 62, 10, dtype=np.uint64)])  # 60 / 80 = 0.75
        ta, tb = (set(pg.bands(np.array([0, len(x)]), x)[1].tolist()) for x in (a, b))
        found += bool(ta & tb)
    assert found >= 0.97 * 400
