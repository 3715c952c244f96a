import random
import re

import numpy as np
import pyarrow as pa
import pytest

from mercantor.llm.kernels import ALNUM, FOLD, VISIBLE, Words, shingles, texts_of

TEXTS = ["One two  TWO\nthree", None, "", " \t\v", "é–1 x_y", "a", "one two two three", "word " * 300]


@pytest.mark.parametrize("most", [1, 7, 1 << 20])
def test_words_are_those_of_the_patterns(most):
    kinds = {"visible": (VISIBLE, rb"[^\x20\x09-\x0D]+"), "letters": (ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")}
    for kind, pattern in kinds.values():
        got = []
        for part in texts_of(pa.array(TEXTS), most):
            w = Words(part, kind, FOLD)
            got += [[w.word(k) for k in range(w.first[i], w.first[i + 1])] for i in range(part.n)]
        assert got == [re.findall(pattern, (t or "").encode().lower()) for t in TEXTS]


def test_sliced_columns():
    a = pa.array(["x y", "z", None, "last one"]).slice(1)
    assert [p.bytes_of(i) for p in texts_of(a, 2) for i in range(p.n)] == [b"z", b"", b"last one"]


def test_equal_shingles_have_equal_hashes():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(12))) for _ in range(60)]
    known, seen = {}, {}
    for part in texts_of(pa.array(texts), 50):
        owner, hashes = shingles(Words(part, VISIBLE, FOLD))
        for i in range(part.n):
            w = texts[part.first + i].split()
            want = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
            own = hashes[owner == i].tolist()
            assert len(own) == len(want) and own == sorted(own)
            key = frozenset(want)
            assert known.setdefault(key, own) == own
            for h in own:
                seen.setdefault(h, set()).add(key)
    assert np.unique(list(seen)).size == len(set().union(*known))


def test_long_texts_are_hashed_as_short_ones():
    import numpy as np

    from mercantor.llm import kernels as kn

    text = "word " * 1_200_000 + "x" * 3_000_000 + " the end"
    (long,) = kn.texts_of(pa.array([text]))
    w = kn.Words(long, kn.VISIBLE)
    (short,) = kn.texts_of(pa.array(["word the end"]))
    s = kn.Words(short, kn.VISIBLE).hashes
    assert (w.hashes[:1_200_000] == s[0]).all() and w.hashes[-2:].tolist() == s[1:].tolist()
    piece = np.frombuffer(b"x" * 3_000_000, np.uint8)
    assert w.hashes[-3] == kn._hashes(kn._sums(piece, kn.NO_FOLD), np.array([0]), np.array([3_000_000]))[0]


def test_a_text_of_100_mb_fits():
    """Shingles, stretches and benchmark windows of one long text, each within 16 bytes a byte."""
    import subprocess
    import sys
    from pathlib import Path

    code = """
import resource, pyarrow as pa
from mercantor.llm import decontam, paragraphs
from mercantor.llm.kernels import FOLD, VISIBLE, Words, shingles, texts_of
text = " ".join(f"w{i * 7919 % 99991}" for i in range(1_400_000)) + " "
a = pa.array([text * (100_000_000 // len(text) + 1)], pa.large_string())
del text
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
windows = decontam.WindowSet([(1, " ".join(f"w{i * 7919 % 99991}" for i in range(500, 530)))])
for t in texts_of(a):
    assert len(t.data) > 100_000_000
    assert len(shingles(Words(t, VISIBLE, FOLD))[1]) > 90_000
    assert len(paragraphs.stretches(Words(t, VISIBLE))[0]) > 10_000_000
    assert len(windows.scan(t)[1][0]) > 2
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) / 1024)
"""
    root = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", code], cwd=root, env={"PYTHONPATH": root, "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
    assert float(done.stdout) < 1600
