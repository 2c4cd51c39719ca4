"""Deterministic dirt injected into the test tables (same expressions in Spark
and in the oracle SQL). Every row of the source table is kept."""

from pyspark.sql import functions as F

from tablelens.catalog.base import table

DIRTY_EVENTS_SQL = """(
  SELECT event_id,
         CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END AS ts,
         user_id,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS event_type,
         CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS value,
         props, 1 AS const_col, CAST(NULL AS VARCHAR) AS empty_col
  FROM events
  UNION ALL
  SELECT event_id,
         CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END AS ts,
         user_id,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS event_type,
         CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS value,
         props, 1 AS const_col, CAST(NULL AS VARCHAR) AS empty_col
  FROM events WHERE event_type = 'error')"""


def dirty_events(spark, d):
    e = table(spark, d, "events")
    eid = F.col("event_id")

    def proj(x):
        return x.select(
            "event_id", F.when(eid % 5 == 0, F.lit(None)).otherwise(F.col("ts")).alias("ts"), "user_id",
            F.when(eid % 7 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("event_type"),
            F.when(eid % 10 == 0, F.lit(None)).otherwise(F.col("value")).alias("value"),
            "props", F.lit(1).alias("const_col"), F.lit(None).cast("string").alias("empty_col"))
    return proj(e).unionByName(proj(e.filter(F.col("event_type") == "error")))


DIRTY_ORDERS_SQL = """(
  SELECT o_orderkey,
         CASE o_orderkey % 3 WHEN 0 THEN concat('  ', lower(o_orderpriority))
                             WHEN 1 THEN concat(o_orderpriority, ' ') ELSE o_orderpriority END AS priority,
         CASE WHEN o_orderkey % 50 = 0 THEN 'n/a'
              ELSE concat('$', CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)) END AS amount,
         CASE WHEN o_orderkey % 25 = 0 THEN 'bad' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS order_day,
         o_orderstatus AS status, o_totalprice
  FROM orders)"""


def dirty_orders(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    pr = F.col("o_orderpriority")
    return o.select(
        "o_orderkey",
        F.when(k % 3 == 0, F.concat(F.lit("  "), F.lower(pr))).when(k % 3 == 1, F.concat(pr, F.lit(" ")))
         .otherwise(pr).alias("priority"),
        F.when(k % 50 == 0, F.lit("n/a"))
         .otherwise(F.concat(F.lit("$"), F.floor("o_totalprice").cast("long").cast("string"))).alias("amount"),
        F.when(k % 25 == 0, F.lit("bad"))
         .otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("order_day"),
        F.col("o_orderstatus").alias("status"), "o_totalprice")


SPIKY_EVENTS_SQL = """(
  SELECT event_id, ts, user_id, event_type,
         CASE WHEN event_id % 500 = 0 THEN value * 50 ELSE value END AS value
  FROM events)"""


def spiky_events(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", "ts", "user_id", "event_type",
                    F.when(F.col("event_id") % 500 == 0, F.col("value") * 50)
                     .otherwise(F.col("value")).alias("value"))


# The eight short reviews of the reference's text fixture.
REVIEWS = [
    "excellent product great value", "terrible quality very bad",
    "it is okay", "love it highly recommend", "worst experience ever",
    "good but slow", "average", "amazing fast delivery",
]

REVIEW_EVENTS_SQL = ("(SELECT event_id, ts, event_type, "
                     f"[{', '.join(repr(r) for r in REVIEWS)}][event_id % 8 + 1] AS review FROM events)")


def review_events(spark, d):
    e = table(spark, d, "events")
    arr = F.array(*[F.lit(r) for r in REVIEWS])
    return e.select("event_id", "ts", "event_type",
                    F.element_at(arr, (F.col("event_id") % 8 + 1).cast("int")).alias("review"))
