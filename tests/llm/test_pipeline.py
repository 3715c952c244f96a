import random
import re

import corpus_pipeline as cp
import pyarrow.parquet as pq

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(1)
    test = prose(rng, 30)
    base = prose(rng, 100)
    near = base.split()
    near[50] = "changed"
    rows = [(i, prose(rng, 80), "en", f"s{i % 4}", 0, "extra") for i in range(40)]
    rows += [(100, base, "en", "s0", 0, None), (101, base, "en", "s1", 0, None), (102, " ".join(near), "en", "s2", 0, None), (103, "too short", "en", "s0", 0, None), (104, prose(rng, 60) + " " + test, "en", "s0", 0, None), (105, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, failed string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, test)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == before.columns
            seen.append([r["doc_id"] for r in docs.collect()])
    quality, distinct, clean, mixed = seen
    assert sorted(quality) == [*range(40), 100, 101, 102, 104]
    assert sorted(distinct) == [*range(40), 100, 104] and sorted(clean) == [*range(40), 100]
    assert set(mixed) <= set(clean) and len(mixed) > len(clean)
    total = sum(len(WORD.findall(r[1])) for r in rows if r[0] in set(clean))
    taken = sum(len(WORD.findall(dict((r[0], r[1]) for r in rows)[i])) for i in mixed)
    assert abs(taken - 1.5 * total) <= 4 * 100
    out = docs.collect()
    assert sorted(r["doc_id"] for r in out) == sorted(mixed)
    again = cp.run(spark, str(tmp_path)).collect()
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, again)) == sorted(map(key, out))
    assert pq.read_table(str(tmp_path / "4")).num_rows == len(mixed)
