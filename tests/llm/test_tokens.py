import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mercantor.llm import tokencount as tc
from mercantor.llm import wavelet as wv
from mercantor.llm.kernels import texts_of
from mercantor.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "the", "ing", "'s", " 're", "'ll", "'", '"', "é", "漢", " ", "  ", "\n", "\n\n", "\t", "\u00a0", "\u2003", "\x1c", "1", "23", "²", "!", "--", "<|endoftext|>", "<|endof", "Zürich", "😀", "_", "don't", "x'y", "'v", "\r\n", "\u2028", "\u0301"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(n, most, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(most))) for _ in range(n)]


def test_every_prefix_has_the_library_s_count(library):
    counter = tc.PrefixCounter(PATH)
    for t in [*texts(250, 10), "a" * 70, "-" * 90, "=" * 33 + "\n" * 20]:
        assert counter.counts(t) == [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]


def test_ids_are_the_library_s(library, monkeypatch):
    monkeypatch.setattr("mercantor.llm.tokens.MOST_PIECES", 300)
    enc, docs = Encoder(PATH), [*texts(300, 40), None, ""]
    for part in texts_of(pa.array(docs), 3000):
        ids, n = enc.encode(part)
        want = [library.encode(docs[part.first + i] or "", add_special_tokens=False).ids for i in range(part.n)]
        assert n.tolist() == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]


def test_tables_answer_prefix_and_budget_questions(library):
    docs = texts(40, 30, 8)
    for part in texts_of(pa.array(docs), 1 << 20):
        table = tc.PrefixTable(PATH, part)
        for i, t in enumerate(docs):
            count = [len(library.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)]
            assert [table.at(i, len(t[:k].encode())) for k in range(len(t) + 1)] == count
            for budget in (0, 1, 5, 1000):
                best = max(k for k in range(len(t) + 1) if count[k] <= budget)
                assert table.cut(i, budget) == len(t[:best].encode())


def test_counts(spark, library):
    docs = [None, "", *texts(60, 60), "word " * 1500, "same", "same"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, n_tokens int")
    got = tc.count(df, PATH).orderBy("doc_id").collect()
    for r, t in zip(got, docs, strict=True):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((t or "").encode()), n, n > 1024)
        assert (r["cut_bytes"] == r["n_bytes"]) or r["over_limit"]
    assert tc.count(df.limit(0), PATH).count() == 0
    tables = {r["doc_id"]: r["counts"] for r in tc.prefix_tables(df, PATH).collect()}
    assert all((tables[r["doc_id"]] or [0])[-1] == r["n_tokens"] for r in got)
    for i, t in enumerate(docs[:30]):
        assert tables[i] == [len(library.encode(t[: k + 1], add_special_tokens=False).ids) for k in range(len(t or ""))]
    for r in tc.truncated(tc.prefix_tables(df, PATH), 9).collect():
        c = [0, *tables[r["doc_id"]]]
        assert (r["chars"], r["tokens"]) == (max(k for k, n in enumerate(c) if n <= 9), c[r["chars"]])


@pytest.mark.parametrize("n, letters", [(0, 1), (1, 1), (7, 1), (200, 2), (1000, 37), (3000, 60000)])
def test_wavelet_matrix(n, letters):
    rng = np.random.Generator(np.random.PCG64(n))
    ids = rng.integers(0, letters, n).astype(np.uint16)
    m = wv.WaveletMatrix.from_bytes(wv.WaveletMatrix.of(ids).to_bytes())
    assert m.decode().tolist() == ids.tolist()
    for i in rng.integers(0, max(n, 1), 30).tolist() if n else []:
        t = int(ids[i])
        before = np.flatnonzero(ids == t)
        assert m.access(i) == t and m.rank(t, i) == int((before < i).sum()) and m.rank(t) == len(before)
        k = int(rng.integers(0, len(before)))
        assert m.select(t, k) == before[k]
    assert m.rank(60001) == 0
    with pytest.raises(IndexError):
        m.access(n)
    with pytest.raises(ValueError):
        wv.WaveletMatrix.from_bytes(m.to_bytes() + b"x")


def test_shards_follow_one_another(spark, tmp_path):
    rows = [(f"id{i * 7919 % 5000:05d}", f"w{i} " * (i % 5)) for i in range(2000)] + [(None, "none"), ("id00003", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    path = str(tmp_path / "w")
    wv.write(df.selectExpr("*", "1 as shard", "2 as ids"), PATH, path)
    got = sorted(map(tuple, wv.read(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or ""))
    assert [r[1] for r in got] == [sum(r[2] for r in got[:k]) for k in range(len(got))]
    assert 1 < spark.read.parquet(path).select("shard").distinct().count() <= 4


def test_files(spark, library, tmp_path):
    rows = [(3 * i % 101, t) for i, t in enumerate(texts(101, 50, 5))] + [(200, None), (201, ""), (7, "again"), (300, "long text " * 4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = str(tmp_path / "w")
    wv.write(df, PATH, path, segment=500)
    got = sorted(map(tuple, wv.read(spark, path).collect()), key=lambda r: r[1])
    at, want = 0, {}
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert [r[0] for r in got] == sorted(i for i, _ in rows)
    for i, start, n, crc in got:
        assert start == at and (n, crc) in want[i]
        at += n
    token = library.encode("again", add_special_tokens=False).ids[0]
    total = sum(library.encode(t or "", add_special_tokens=False).ids.count(token) for _, t in rows)
    assert sum(r["n"] for r in wv.occurrences(spark, path, token).collect()) == total
    shards = {}
    for r in spark.read.parquet(path).orderBy("shard", "at").collect():
        shards.setdefault(r["shard"], []).extend(wv.WaveletMatrix.from_bytes(bytes(r["matrix"])).decode().tolist())
    s, flat = max(shards.items(), key=lambda x: len(x[1]))
    assert len(spark.read.parquet(path).where(f"shard = {s}").collect()) > 2
    places = [0, 1, 499, 500, len(flat) // 2, len(flat) - 1]
    assert {r["q"]: r["token"] for r in wv.access(spark, path, s, places).collect()} == {i: flat[i] for i in places}
    where = [i for i, x in enumerate(flat) if x == token]
    assert {r["q"]: r["n"] for r in wv.count_before(spark, path, token, s, [*places, len(flat)]).collect()} == {i: flat[:i].count(token) for i in [*places, len(flat)]}
    assert {r["q"]: r["place"] for r in wv.locate(spark, path, token, s, [0, len(where) - 1, len(where)]).collect()} == {k: where[k] for k in {0, len(where) - 1} if where}
    wv.write(df.limit(0), PATH, str(tmp_path / "none"))
    assert wv.read(spark, str(tmp_path / "none")).count() == 0
