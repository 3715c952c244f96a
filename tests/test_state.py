"""Deltas: batch, outcomes and stream agree with a plain fold."""

import itertools
import random

from mercantor.streaming import state as ss

SCHEMA = "key long, authority int, at long, seq long, payload string"


def fold(rows):
    state, out = {}, []
    for key, authority, at, seq, payload in sorted(rows, key=lambda r: r[3]):
        old = state.get(key)
        if old is None or (authority, at) > old[:2]:
            kind = "Applied"
        elif (authority, at) < old[:2]:
            kind = "Stale"
        else:
            kind = "Idempotent" if payload == old[2] else "Applied"
        if kind == "Applied":
            state[key] = (authority, at, payload)
        out.append((key, seq, kind))
    return state, sorted(out)


def deltas(seed=5):
    rng = random.Random(seed)
    return [(rng.randrange(4), rng.randrange(1, 3), rng.randrange(4), i, rng.choice(["InStock", "OutOfStock"])) for i in range(120)]


def test_batch(spark):
    rows = deltas()
    df = spark.createDataFrame(rows, SCHEMA)
    state, outcomes = fold(rows)
    assert sorted((r["key"], r["seq"], r["outcome"]) for r in ss.outcomes(df).collect()) == outcomes
    assert {r["key"]: (r["authority"], r["at"], r["payload"]) for r in ss.latest(df).collect()} == state


def test_order_of_processing_does_not_matter(spark):
    rows = [(1, 1, 1, 0, "InStock"), (1, 2, 1, 1, "OutOfStock"), (1, 1, 9, 2, "InStock")]
    got = {tuple(ss.latest(spark.createDataFrame(list(p), SCHEMA)).first()) for p in itertools.permutations(rows)}
    assert got == {(1, "OutOfStock", 2, 1)}


def test_stream(spark, tmp_path):
    rows = deltas(8)
    for k in range(3):
        spark.createDataFrame(rows[40 * k : 40 * k + 40], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ss.stream_latest(stream).writeStream.outputMode("update").foreachBatch(ss.upsert_to(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["key"]: (r["authority"], r["at"], r["payload"]) for r in ss.current(spark.read.parquet(str(tmp_path / "out")).drop("version")).collect()}
    assert got == fold(rows)[0]


def test_versions_are_merged(spark, tmp_path):
    rows = deltas(9)
    write = ss.upsert_to(str(tmp_path / "out"))
    for k in range(3):
        write(spark.createDataFrame(rows[40 * k : 40 * k + 40], SCHEMA), k)
    before = {tuple(r) for r in ss.current(spark.read.parquet(str(tmp_path / "out")).drop("version")).select("key", "payload", "authority", "at").collect()}
    assert ss.compact(spark, str(tmp_path / "out")) == 3
    left = spark.read.parquet(str(tmp_path / "out"))
    assert [r["version"] for r in left.select("version").distinct().collect()] == [3] and left.count() == len(before)
    assert {tuple(r) for r in ss.current(left.drop("version")).select("key", "payload", "authority", "at").collect()} == before
