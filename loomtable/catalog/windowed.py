"""Ranking, running, rolling and session queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtable.catalog import money, plain, query, table
from loomtable.operators import windows


@query("""
SELECT c_nationkey, c_custkey, c_acctbal FROM (
  SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn
  FROM customer) WHERE rn = 1
""")
def top1_per_group(spark, sf):
    customer = table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    order = [F.desc("c_acctbal"), F.asc("c_custkey")]
    return windows.top_n_per_group(customer, ["c_nationkey"], order, 1)


@query("""
SELECT c_mktsegment, c_custkey, c_acctbal,
       row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS row_number,
       rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) AS rank,
       dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) AS dense_rank
FROM (SELECT c_mktsegment, c_custkey, CAST(floor(c_acctbal / 10) AS BIGINT) AS c_acctbal FROM customer)
""")
def rank_compare(spark, sf):
    customer = table(spark, sf, "customer").select(
        "c_mktsegment", "c_custkey", F.floor(F.col("c_acctbal") / 10).alias("c_acctbal")
    )
    ranked = windows.rank_compare(customer, ["c_mktsegment"], "c_acctbal", ["c_custkey"])
    return ranked.withColumns({
        c: F.col(c).cast("bigint") for c in ("row_number", "rank", "dense_rank")
    })


@query("""
SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM (
  SELECT *, dense_rank() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC) AS d FROM lineitem)
WHERE d = 1
""")
def top_with_ties(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    return windows.top_with_ties(lines, ["l_partkey"], "l_quantity")


@query("""
WITH t AS (
  SELECT c_nationkey, o_custkey, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS total
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY total DESC, o_custkey) AS rn FROM t)
SELECT c_nationkey, o_custkey, CAST(total AS DOUBLE) AS total, CAST(rn AS INTEGER) AS position
FROM r WHERE rn <= 3
""")
def top3_per_group(spark, sf):
    totals = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.sum(money("o_totalprice")).alias("total")
    )
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    placed = totals.join(customer, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")
    order = [F.desc("total"), F.asc("o_custkey")]
    return plain(windows.top_n_per_group(placed, ["c_nationkey"], order, 3, "position"))


def user_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("user_id", "ts", "event_id", "value")


@query("""
SELECT event_id, user_id,
       CAST(sum(CAST(value AS DECIMAL(12,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id
            ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_total
FROM events
""")
def running_total(spark, sf):
    events = user_events(spark, sf).withColumn("value", money("value"))
    totals = windows.running_total(events, ["user_id"], ["ts", "event_id"], "value")
    return plain(totals.select("event_id", "user_id", "running_total"))


@query("""
SELECT event_id, user_id, lag(value) OVER w AS previous, lead(value) OVER w AS next,
       value - lag(value) OVER w AS difference
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def lag_lead_diff(spark, sf):
    moved = windows.neighbours(user_events(spark, sf), ["user_id"], ["ts", "event_id"], "value")
    return moved.select("event_id", "user_id", "previous", "next", "difference")


@query("""
SELECT o_orderkey, o_custkey,
       CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) OVER w AS DOUBLE) / count(*) OVER w AS rolling_average
FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE)
             RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)
""")
def rolling_7d_avg(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", money("o_totalprice").alias("amount")
    )
    rolled = windows.rolling_days(orders, ["o_custkey"], "o_orderdate", "amount", 7)
    return rolled.select("o_orderkey", "o_custkey", "rolling_average")


@query("""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS sec FROM events),
g AS (SELECT *, sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec) AS gap FROM e),
s AS (SELECT event_id, user_id,
             CAST(sum(CASE WHEN gap IS NULL OR gap > 1800 THEN 1 ELSE 0 END)
                  OVER (PARTITION BY user_id ORDER BY sec) AS BIGINT) AS session_number FROM g)
SELECT event_id, user_id, session_number,
       user_id || '_' || lpad(CAST(session_number AS VARCHAR), greatest(3, length(CAST(session_number AS VARCHAR)))::INTEGER, '0') AS session_id
FROM s
""")
def sessionize(spark, sf):
    numbered = windows.sessionize(user_events(spark, sf), "user_id", "ts")
    return numbered.select("event_id", "user_id", "session_number", "session_id")
