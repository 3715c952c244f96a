"""Live availability from deltas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import SQL, catalog, table, variants
from ..registry import query
from ..streaming import state as ss

_DELTAS = f"""{SQL}, deltas AS (
  SELECT variant_id AS key, CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END AS authority, CAST(event_id // 50 AS BIGINT) AS "at", event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'InStock' WHEN 1 THEN 'OutOfStock' ELSE 'Backorder' END AS payload, event_id % 90 AS units
  FROM events JOIN variant ON product_id = user_id AND supplier_id % 7 = event_id % 7
  UNION ALL SELECT variant_id, 1, 0, -1, CASE WHEN quantity > 45 THEN 'OutOfStock' ELSE 'InStock' END, units FROM variant)"""


def deltas(spark, d):
    """Events as deltas of some variants of a product on a coarse clock, after the inventory of every variant."""
    e, v = table(spark, d, "events"), variants(spark, d)
    payload = F.element_at(F.array(*map(F.lit, ("InStock", "OutOfStock", "Backorder"))), (F.col("event_id") % 3 + 1).cast("int"))
    hit = e.join(v.select("product_id", "variant_id", "supplier_id"), (F.col("product_id") == F.col("user_id")) & (F.col("supplier_id") % 7 == F.col("event_id") % 7))
    rows = hit.select(F.col("variant_id").alias("key"), F.when(F.col("event_type") == "purchase", 2).otherwise(1).alias("authority"), F.expr("event_id div 50").alias("at"), F.col("event_id").alias("seq"), payload.alias("payload"), (F.col("event_id") % 90).alias("units"))
    return ss.seeds(v, F.when(F.col("quantity") > 45, "OutOfStock").otherwise("InStock"), F.col("units")).unionByName(rows)


_TOP = "max({'authority': authority, 'at': \"at\", 'seq': seq, 'payload': payload}) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"{_DELTAS} SELECT key, seq, CASE WHEN t IS NULL OR (authority, \"at\") > (t.authority, t.at) THEN 'Applied' WHEN (authority, \"at\") < (t.authority, t.at) THEN 'Stale' WHEN payload = t.payload THEN 'Idempotent' ELSE 'Applied' END AS outcome FROM (SELECT *, {_TOP} AS t FROM deltas)")
def m_outcomes(spark, d):
    return ss.outcomes(deltas(spark, d)).select("key", "seq", "outcome")


_STATE = f"{_DELTAS}, state AS (SELECT key, s.payload AS payload, s.authority AS authority, s.at AS \"at\", s.units AS units FROM (SELECT key, arg_max({{'payload': payload, 'authority': authority, 'at': \"at\", 'units': units}}, {{'a': authority, 'b': \"at\", 'c': seq}}) AS s FROM deltas GROUP BY key))"


@query(f"{_STATE} SELECT * FROM state")
def m_latest(spark, d):
    return ss.latest(deltas(spark, d))


@query(f"{_STATE} SELECT product_id, variant_id FROM catalog WHERE brand = 'Brand#17' AND variant_id IN (SELECT key FROM state WHERE payload = 'InStock')")
def m_query_with_overlay(spark, d):
    hits = catalog(spark, d).where("brand = 'Brand#17'").select("product_id", "variant_id", F.col("variant_id").alias("key"))
    return ss.with_overlay(hits, ss.latest(deltas(spark, d))).select("product_id", "variant_id")


@query(f"{_STATE} SELECT payload, count(*) AS n FROM state GROUP BY payload")
def m_availability(spark, d):
    return ss.latest(deltas(spark, d)).groupBy("payload").agg(F.count("*").alias("n"))


@query(f"{_STATE} SELECT ordinal, units FROM state JOIN (SELECT variant_id, row_number() OVER (ORDER BY product_id, variant_id) - 1 AS ordinal FROM variant) ON variant_id = key WHERE payload = 'InStock'")
def m_available_ordinals(spark, d):
    """The ordinals of the variants in stock, with their units."""
    now = ss.latest(deltas(spark, d)).where("payload = 'InStock'")
    return now.join(variants(spark, d).select(F.col("variant_id").alias("key"), "ordinal"), "key").select("ordinal", "units")
