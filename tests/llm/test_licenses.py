import random

import pytest
from test_paragraphs import prose

from mercantor.llm import licenses as li


def test_licenses(spark):
    rng = random.Random(8)
    mit = dict(enumerate(t for n, t in li.TEMPLATES if n == "MIT"))[1]
    words = mit.split()
    edited = " ".join(w for k, w in enumerate(words) if k % 12)
    rows = [
        (1, prose(rng, 400)), (2, f"{prose(rng, 90)}\nReleased under the MIT License."), (3, prose(rng, 50) + " " + mit.upper() + " " + prose(rng, 50)), (4, edited), (5, " ".join(words[:40])),
        (6, "Licensed under the Apache License, Version 2.0."), (7, None), (8, ""), (9, f"{mit} {mit}"), (10, "This is licensed under the GNU General Public License, version 3, see there."), (11, "the license of the software is not given"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in li.scan(df).collect()}
    assert {i: r["license"] for i, r in got.items()} == {1: None, 2: "MIT", 3: "MIT", 4: "MIT", 5: None, 6: "Apache-2.0", 7: None, 8: None, 9: "MIT", 10: "GPL-3.0", 11: None}
    assert got[3]["coverage"] == 1.0 and 0.75 <= got[4]["coverage"] < 1 and got[1]["coverage"] == 0.0
    r = got[2]
    assert dict(rows)[2].encode()[r["start"] : r["end"]] == b"Released under the MIT License"
    assert li.scan(df.limit(0)).count() == 0


def test_all_notices(spark):
    rng = random.Random(9)
    mit, gpl, cc = li.TEMPLATES[8][1], li.TEMPLATES[11][1], "Licensed under CC BY-NC 4.0."
    text = f"{prose(rng, 30)}\n{cc}\n{prose(rng, 30)}\n{gpl}\n{prose(rng, 30)}\n{mit}\n{prose(rng, 5)}\n{mit} {cc}"
    df = spark.createDataFrame([(1, text), (2, prose(rng, 60)), (3, li.TEMPLATES[10][1]), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in li.scan(df).collect()}
    assert [n["license"] for n in got[1]["notices"]] == ["CC-BY-NC-4.0", "GPL-3.0", "MIT", "MIT", "CC-BY-NC-4.0"]
    spans = [text.encode()[n["start"] : n["end"]].decode() for n in got[1]["notices"]]
    assert spans == [x.rstrip(".") for x in (cc, gpl, mit, mit, cc)] and all(n["coverage"] == 1.0 for n in got[1]["notices"])
    assert got[1]["license"] == "MIT" and (got[1]["start"], got[1]["end"]) == (got[1]["notices"][2]["start"], got[1]["notices"][2]["end"])
    assert got[2]["notices"] == got[4]["notices"] == []
    assert [(n["license"], n["template"]) for n in got[3]["notices"]] == [("Apache-2.0", 10)]  # the short notice lies inside


def test_notices_against_brute_force():
    """Every start is tried for every template, by the same rule of coverage; the scan's windows must lose none."""
    import pyarrow as pa

    from mercantor.llm.kernels import texts_of

    rng = random.Random(21)
    scanner = li.Scanner()
    plain = [t.lower().split() for _, t in li.TEMPLATES]
    docs, names = [], []
    for k in range(60):
        t = rng.randrange(len(plain))
        words = [w for w in plain[t] if rng.random() > (k % 3) * 0.04]
        docs.append(" ".join([prose(rng, rng.randrange(40), 99), *words, prose(rng, rng.randrange(40), 99)]))
        names.append(t)
    import re

    tokens = lambda s: re.findall(r"[0-9a-z\x80-\U0010ffff]+", s.lower())
    for part in texts_of(pa.array(docs)):
        found = scanner.scan(part)
        for i in range(part.n):
            own, best = tokens(docs[part.first + i]), 0
            for t, (_, text) in enumerate(li.TEMPLATES):
                want = tokens(text)
                slack = max(2, len(want) // 4)
                for p in range(len(own)):
                    if own[p : p + 3] == want[:3]:
                        pairs = li.align(own[max(0, p - slack) : p + len(want) + slack], want)
                        if len(pairs) >= li.COVERAGE * len(want):
                            best = max(best, len(pairs))
            got = found.get(i, [])
            assert not best or got and got[0][1] >= best, docs[part.first + i]


def test_edges(spark):
    mit = li.TEMPLATES[8][1]
    rows = [(1, mit), (1, mit), (None, mit), (3, None), (4, ""), (5, "é " * 10), (6, (prose(random.Random(1), 30) + " ") * 4000 + mit)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as license", "1 as notices")
    got = sorted((((r["doc_id"] or 0), r["license"] or "", len(r["notices"])) for r in li.scan(df).collect()))
    assert got == [(0, "MIT", 1), (1, "MIT", 1), (1, "MIT", 1), (3, "", 0), (4, "", 0), (5, "", 0), (6, "MIT", 1)]
    with pytest.raises(ValueError):
        li.Scanner((("X", "two words"),))


def test_alignment():
    assert li.longest_increasing([3, 1, 2, 9, 4, 5]) == [1, 2, 4, 5] and li.longest_increasing([]) == []
    a, b = "x a b c q d e".split(), "a b z c d e f".split()
    pairs = li.align(a, b)
    assert [a[i] for i, _ in pairs] == list("abcde") and all(a[i] == b[j] for i, j in pairs)
