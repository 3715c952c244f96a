import random
import re

import pyarrow as pa

from mercantor.llm import urlfilter as uf
from mercantor.llm.kernels import texts_of


def test_automaton_is_globbing():
    rng = random.Random(5)
    globs = ["", "*", "a", "a*b", "a?b", "?b?", "??b", "*?b?*", "*ab*", "?b?", "**", "a?*?b", "é*", r"\*x\?", "ab" * 70, "*" + "ab" * 40 + "*"]
    globs += ["".join(rng.choice("ab*?") for _ in range(rng.randrange(7))) for _ in range(60)]
    texts = ["", "a", "ab", "*x?", "é", "aéb", "漢b😀", "é漢b", "ab" * 70, "x" + "ab" * 41] + ["".join(rng.choice("ab") for _ in range(rng.randrange(9))) for _ in range(150)]
    machine = uf.Automaton(globs)
    for part in texts_of(pa.array(texts), 100):
        got = machine.match(part)
        for i in range(part.n):
            for k, g in enumerate(globs):
                pattern = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in re.sub(r"\\(.)", lambda m: chr(0xE000 + ord(m[1])), g))
                pattern = re.sub("[\ue000-\ue0ff]", lambda m: re.escape(chr(ord(m[0]) - 0xE000)), pattern)
                want = re.fullmatch(pattern, texts[part.first + i], re.S) is not None
                assert got[i, k] == want, (g, texts[part.first + i])


CASES = [
    (None, "", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("http://", "", "", None, "allow"),
    ("HTTP://EXAMPLE.com/x", "example.com", "/x", "com/", "allow"),
    ("http://example.com", "example.com", "", None, "allow"),
    ("http://example.com?x=/en/", "example.com", "", None, "allow"),
    ("http://example.com/en/1?q#f", "example.com", "/en/1", "example.com/en/", "block"),
    ("http://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
    ("http://www.example.com/en/2", "www.example.com", "/en/2", "www.example.com/en/", "allow"),
    ("http://xexample.com/en/", "xexample.com", "/en/", "com/", "allow"),
    ("http://a.net/es/1", "a.net", "/es/1", "net/es/", "block"),
    ("http://a.net/ES/1", "a.net", "/ES/1", None, "allow"),
    ("http://a.net/de/1", "a.net", "/de/1", None, "allow"),
    ("x://spam-farm.example.org/en/7", "spam-farm.example.org", "/en/7", None, "block"),
    ("http://h.org/a/b.zip#x", "h.org", "/a/b.zip", None, "block"),
    ("a://b://c.net/fr/", "b:", "//c.net/fr/", None, "allow"),
    ("http://Ünï.COM/p", "Ünï.com", "/p", "com/", "allow"),
    ("http://long.org/" + "x" * 20000, "long.org", "/" + "x" * 20000, None, "allow"),
]


def test_rules(spark):
    df = spark.createDataFrame([(i, c[0], "mine") for i, c in enumerate(CASES)], "page_id long, url string, verdict string")
    got = [tuple(r)[1:] for r in uf.digest(df).orderBy("page_id").collect()]
    assert got == [c[1:] for c in CASES]
    assert uf.digest(df.limit(0)).count() == 0
    assert uf.digest(df.union(df)).count() == 2 * len(CASES)
