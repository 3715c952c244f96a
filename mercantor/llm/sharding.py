"""Sharding by balanced label propagation.

Links are given through hubs: documents with the same hub (equal texts, a near-copy component, or the two ends
of an edge) are neighbours.  Every document starts in a shard drawn by hash.  In each round a hub wants the
shard that holds most of its members; members move there if the shard's quota of linked documents allows it,
else their hub waits.  Rounds go on until none lowers the number of documents outside their hub's shard.  Unlinked documents gain nothing by staying, so they make room: a last pass by prefix
sums moves the overflow of full shards to shards with room and makes the law hold exactly.

Hubs larger than a quarter of a shard are split into chunks first, so one group of copies that holds a third of
all rows spreads over as many shards as it needs and never meets in one task.  Prefix sums and slots take two
levels (sums of hash buckets, then rows inside a bucket), so no task gets a whole shard.

Laws: ``rows`` keeps the row counts of shards at most one apart; ``bytes`` keeps the byte sums as near as single
rows allow.  Defined results: a null text has size 8 (the framing alone) and crc32 0, and null texts link with
nothing; empty texts link with each other; repeated rows are rows of their own; an empty table gives no rows;
only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import drop, keep

SHARDS = 24
FRAME_BYTES = 8
ROWS_A_BUCKET = 50_000


def rows_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, hub, u): hub is a hash of the text, null for null; u is the row's own hash."""
    text = F.col(f"`{text_col}`")
    body = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    hub = F.when(text.isNotNull(), F.xxhash64(text, F.octet_length(text), F.crc32(F.encode(text, "UTF-8"))))
    key = F.col(f"`{id_col}`")
    return docs.select(key.alias("doc_id"), (body + FRAME_BYTES).alias("size"), F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"), hub.alias("hub"), F.xxhash64(key, text).alias("u"))


def chunked(rows: DataFrame, weight: Column, chunk: float) -> DataFrame:
    """Hubs of one row become null; hubs heavier than ``chunk`` are split by the rows' hashes.

    ``spread`` says in how many parts a hub's rows are ordered, so that no task gets a whole chunk.
    """
    hubs = rows.where("hub is not null").groupBy("hub").agg(F.count("*").alias("n"), F.sum(weight).alias("w")).where("n > 1")
    hubs = hubs.select("hub", F.ceil(F.col("w") / F.lit(max(chunk, 1.0))).alias("parts"), F.ceil(F.col("n") / ROWS_A_BUCKET).alias("spread"))
    out = rows.join(hubs, "hub", "left")
    part = F.pmod(F.col("u"), F.col("parts"))
    return out.withColumns({"hub": F.when(F.col("parts") == 1, F.col("hub")).when(F.col("parts") > 1, F.xxhash64("hub", part)), "spread": F.coalesce(F.ceil(F.col("spread") / F.col("parts")), F.lit(1))}).drop("parts")


def propagate(rows: DataFrame, shards: int, weight: Column, quota: float) -> DataFrame:
    """Moves of linked rows towards the shard that holds most of their hub, within quotas, until a round cuts no less.

    What lies outside its hub's main shard is a whole number that falls in every round but the last two, so the
    rounds end by themselves.
    """
    rows = keep(rows.withColumn("shard", F.pmod(F.xxhash64("u"), F.lit(shards)).cast("int")))
    least, stalled, k = None, 0, 0
    while True:
        linked = rows.where("hub is not null")
        held = linked.groupBy("hub", "shard").agg(F.sum(weight).alias("w"))
        wish = held.groupBy("hub").agg(F.max_by("shard", F.struct("w", (-F.col("shard")).alias("low"))).alias("want"), F.sum("w").alias("whole"), F.max("w").alias("there"))
        wish = keep(wish.where("there < whole"))
        cut_now = wish.agg(F.coalesce(F.sum(F.col("whole") - F.col("there")), F.lit(0))).first()[0]
        stalled = 0 if least is None or cut_now < least else stalled + 1
        least = cut_now if least is None else min(least, cut_now)
        if not cut_now or stalled == 2:
            drop(wish)
            return rows
        # Quotas: what linked rows may still come to each shard.  One row for each shard.
        moving = wish.groupBy(F.col("want").alias("to")).agg(F.sum(F.col("whole") - F.col("there")).alias("come"))
        load = linked.groupBy(F.col("shard").alias("to")).agg(F.sum(weight).alias("load"))
        room = moving.join(load, "to", "left").select("to", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(quota) - F.coalesce("load", F.lit(0))) / F.col("come"))).alias("open"))
        lot = F.pmod(F.xxhash64("hub", F.lit(k)), F.lit(1 << 20)) / float(1 << 20)
        # A hub that the quota turns away asks for a shard drawn by lot in the next round's stead.
        accepted = wish.join(F.broadcast(room), F.col("want") == F.col("to")).withColumn("lot", lot)
        other = F.pmod(F.xxhash64("hub", F.lit(k), F.lit(1)), F.lit(shards)).cast("int")
        go = F.when(F.col("lot") < F.col("open"), F.col("want")).when(F.col("open") <= 0, other)
        moves = accepted.select("hub", go.alias("go")).where("go is not null")
        before, rows = rows, keep(rows.join(moves, "hub", "left").withColumn("shard", F.coalesce("go", "shard")).drop("go"))
        drop(before, wish)
        k += 1


def _running(rows: DataFrame, group: list[str], order: list[Column | str], bucket: Column, weight: Column, n: int) -> DataFrame:
    """Adds ``before``: the weight of the group's rows that come earlier, by bucket and then ``order``."""
    x = rows.withColumn("b", bucket)
    sums = x.groupBy(*group, "b").agg(F.sum(weight).alias("bw"))
    up_to = Window.partitionBy(*group).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("b0", F.coalesce(F.sum("bw").over(up_to), F.lit(0))).drop("bw")
    if n <= 200_000:  # rows of the table of sums
        sums = F.broadcast(sums)
    inside = Window.partitionBy(*group, "b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return x.join(sums, [*group, "b"]).withColumn("before", F.col("b0") + F.coalesce(F.sum(weight).over(inside), F.lit(0))).drop("b", "b0")


def balance(rows: DataFrame, shards: int, weight: Column, goals: list[float], buckets: int) -> DataFrame:
    """Moves what exceeds the shards' goals, unlinked rows before linked ones, to the shards that lack weight."""
    home = F.element_at(F.array(*[F.lit(float(g)) for g in goals]), F.col("shard") + 1)
    size_class = F.lit(63) - F.least(F.lit(63), F.floor(F.log2(weight + 1)).cast("int"))  # large rows first: the tail is fine-grained
    large = F.lit(buckets) * 66 + F.pmod("hub", F.lit(1 << 30)) * 4096 + F.pmod("u", F.least("spread", F.lit(4096)))  # a large hub's own buckets
    rank = F.when(F.col("spread") > 1, large).when(F.col("hub").isNotNull(), F.pmod("hub", F.lit(buckets))).otherwise(F.lit(buckets) * (1 + size_class) + F.pmod("u", F.lit(buckets)))
    order = ["hub", "u", "doc_id"]
    x = _running(rows, ["shard"], order, rank.cast("long"), weight, shards * buckets * 65).withColumn("over", F.col("before") + weight / 2.0 > home)
    x = keep(x.drop("before"))
    held = {r["shard"]: float(r["w"]) for r in x.where("not over").groupBy("shard").agg(F.sum(weight).alias("w")).collect()}  # one number a shard
    lacking, ends, at = [], [], 0.0
    for s in range(shards):
        if (gap := goals[s] - held.get(s, 0.0)) > 0:
            at += gap
            lacking.append(s)
            ends.append(at)
    if not lacking:
        return x.drop("over")
    pool = _running(x.where("over").withColumn("all", F.lit(0)), ["all"], order, rank.cast("long"), weight, buckets * 65)
    middle = F.col("before") + weight / 2.0
    spot = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= middle))
    to = F.element_at(F.array(*map(F.lit, lacking)), F.least(spot + 1, F.lit(len(lacking))))
    moved = pool.withColumn("shard", to.cast("int")).drop("before", "all", "over")
    return x.where("not over").drop("over").select(*moved.columns).union(moved)


def shard(docs: DataFrame, *, shards: int = SHARDS, law: str = "rows", id_col: str = "doc_id", text_col: str = "text", hubs: DataFrame | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, hub, shard, slot).  ``hubs`` (id_col, hub) replaces equal texts as links."""
    if law not in ("rows", "bytes"):
        raise ValueError(f"no such law: {law}")
    rows = rows_of(docs, id_col, text_col)
    if hubs is not None:
        links = hubs.groupBy(F.col(id_col).alias("doc_id")).agg(F.min(F.xxhash64("hub")).alias("hub"))
        rows = rows.drop("hub").join(links, "doc_id", "left")
    rows = keep(rows)
    weight = F.lit(1).cast("long") if law == "rows" else F.col("size")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
    buckets = max(1, min(1 << 16, -(-n // (shards * ROWS_A_BUCKET))))
    mean = total / shards
    goals = [float(total // shards + (s < total % shards)) for s in range(shards)] if law == "rows" else [mean] * shards
    labelled = propagate(chunked(rows, weight, mean / 4), shards, weight, mean)
    drop(rows)
    for _ in range(1 if law == "rows" else 3):
        before, labelled = labelled, keep(balance(labelled, shards, weight, goals, buckets))
        drop(before)
    one = F.lit(1).cast("long")
    out = _running(labelled, ["shard"], ["u", "doc_id"], F.pmod("u", F.lit(buckets)).cast("long"), one, shards * buckets)
    return out.withColumnRenamed("before", "slot").select("doc_id", "size", "text_crc32", "hub", "shard", "slot")


def cut(sharded: DataFrame) -> DataFrame:
    """One row: linked rows, and those of them outside the shard that holds most of their hub."""
    held = sharded.where("hub is not null").groupBy("hub", "shard").agg(F.count("*").alias("n"))
    return held.groupBy("hub").agg(F.sum("n").alias("n"), F.max("n").alias("most")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("linked"), F.coalesce(F.sum(F.col("n") - F.col("most")), F.lit(0)).alias("cut"))


def digest(docs: DataFrame, law: str = "rows") -> DataFrame:
    """The contract's columns."""
    out = shard(docs.select("doc_id", "text"), law=law)
    return out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
