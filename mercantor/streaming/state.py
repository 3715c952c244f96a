"""Live availability: deltas with authority and a logical clock, as a batch and as a stream.

Higher authority beats time; with equal authority the later time wins; equal time with the same payload changes
nothing, with another payload it applies.  The state after any deltas is the largest (authority, time, arrival), so
no order of processing matters: the batch form is one grouping, outcomes are one window, and the stream keeps
one row for each key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

APPLIED, SAME, STALE = "Applied", "Idempotent", "Stale"


_OWN = ("payload", "authority", "at")


def latest(deltas: DataFrame, key: str = "key") -> DataFrame:
    """The state of each key: deltas (key, authority, at, seq, payload, ...) reduced by the largest; more columns go along."""
    more = [c for c in deltas.columns if c not in (key, "seq", *_OWN)]
    best = F.max_by(F.struct(*_OWN, *more), F.struct("authority", "at", "seq"))
    return deltas.groupBy(key).agg(best.alias("s")).select(key, *[F.col(f"s.{c}") for c in (*_OWN, *more)])


def seeds(catalog: DataFrame, availability: Column, units: Column) -> DataFrame:
    """The catalog's inventory as the first observation of each variant: any later one of equal authority replaces it."""
    return catalog.select(F.col("variant_id").alias("key"), F.lit(1).alias("authority"), F.lit(0).cast("long").alias("at"), F.lit(-1).cast("long").alias("seq"), availability.alias("payload"), units.cast("long").alias("units"))


def outcomes(deltas: DataFrame, key: str = "key") -> DataFrame:
    """Each delta with what it did on arrival; the first one of a key (its seed) is Applied."""
    before = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    top = F.max(F.struct("authority", "at", "seq", "payload")).over(before)
    own = lambda p: F.struct(F.col(f"{p}authority"), F.col(f"{p}at"))
    out = deltas.withColumn("top", top)
    result = F.when(F.col("top").isNull() | (own("") > own("top.")), APPLIED).when(own("") < own("top."), STALE).when(F.col("payload").eqNullSafe(F.col("top.payload")), SAME).otherwise(APPLIED)
    return out.withColumn("outcome", result).drop("top")


def with_overlay(hits: DataFrame, state: DataFrame, key: str = "key") -> DataFrame:
    """Hits whose state is in stock."""
    return hits.join(state.where("payload = 'InStock'").select(key), key, "left_semi")


def stream_latest(deltas: DataFrame, key: str = "key"):
    """A stream of deltas to a stream of changed states, one state row a key (``applyInPandasWithState``)."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else None
        old = now
        for pdf in frames:
            if pdf.empty:
                continue
            i = np.lexsort((pdf["seq"], pdf["at"], pdf["authority"]))[-1]
            new = (int(pdf["authority"].iloc[i]), int(pdf["at"].iloc[i]), int(pdf["seq"].iloc[i]), pdf["payload"].iloc[i])
            if now is None or new[:3] > now[:3]:
                now = new
        if now != old:
            state.update(now)
            yield pd.DataFrame({key: [k[0]], "authority": [now[0]], "at": [now[1]], "seq": [now[2]], "payload": [now[3]]})

    kind = deltas.schema[key].dataType.simpleString()
    return deltas.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, authority int, at long, seq long, payload string", "authority int, at long, seq long, payload string", "update", GroupStateTimeout.NoTimeout)


def upsert_to(path: str, key: str = "key"):
    """A ``foreachBatch`` sink that writes each batch's changed states as one more version under ``path``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{path}/version={number}")

    return write


def compact(spark: SparkSession, path: str, key: str = "key") -> int:
    """Replaces all versions under ``path`` by one that holds the newest state of each key; returns its number.

    The merged version is written whole before the older ones go, and reading both in between gives the same states.
    """
    seen = [r["version"] for r in spark.read.parquet(path).select("version").distinct().collect()]
    merged = max(seen) + 1
    latest(spark.read.parquet(path).where(F.col("version") < merged).drop("version"), key).withColumn("seq", F.lit(-1).cast("long")).withColumn("version", F.lit(merged)).write.mode("overwrite").parquet(f"{path}/version={merged}")
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for v in seen:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={v}"), True)
    return merged


def current(states: DataFrame, key: str = "key") -> DataFrame:
    """The newest state of each key from versions that `upsert_to` wrote."""
    return latest(states, key)


