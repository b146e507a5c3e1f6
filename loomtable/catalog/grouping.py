"""Grouping, distinct, pivot, imputation, salting and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtable.catalog import money, plain, query, table
from loomtable.operators import aggregates as agg
from loomtable.operators import quality
from loomtable.operators.windows import dedupe_by_key
from loomtable.plans import etl, people, spend


def customer_amounts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("customer_id"), F.col("o_orderkey").alias("order_id"),
        money("o_totalprice").alias("amount"),
    )


AMOUNTS_SQL = "SELECT o_custkey AS customer_id, CAST(o_totalprice AS DECIMAL(12,2)) AS amount FROM orders"


@query(f"""
SELECT customer_id, count(*) AS order_count, CAST(sum(amount) AS DOUBLE) AS total_spend,
       CAST(max(amount) AS DOUBLE) AS largest, CAST(min(amount) AS DOUBLE) AS smallest
FROM ({AMOUNTS_SQL}) GROUP BY customer_id
""")
def customer_spend_sum(spark, sf):
    return plain(customer_amounts(spark, sf).groupBy("customer_id").agg(
        F.count("*").alias("order_count"), F.sum("amount").alias("total_spend"),
        F.max("amount").alias("largest"), F.min("amount").alias("smallest"),
    ))


@query(f"""
SELECT customer_id, CAST(sum(amount) AS DOUBLE) / count(amount) AS average_purchase
FROM ({AMOUNTS_SQL}) GROUP BY customer_id
""")
def customer_spend_avg(spark, sf):
    # The exact sum divided once, so the result does not depend on row order.
    return customer_amounts(spark, sf).groupBy("customer_id").agg(
        (F.sum("amount").cast("double") / F.count("amount")).alias("average_purchase")
    )


@query(f"""
SELECT customer_id, CAST(round(sum(amount), 1) AS DOUBLE) AS total_spent
FROM ({AMOUNTS_SQL}) GROUP BY customer_id
""")
def customer_spend_rounded(spark, sf):
    return plain(spend.spend_per_customer(customer_amounts(spark, sf)))


@query(f"""
SELECT customer_id, CAST(round(sum(amount), 1) AS DOUBLE) AS total_spent
FROM ({AMOUNTS_SQL}) GROUP BY customer_id
""")
def customer_spend_sql(spark, sf):
    return plain(spend.spend_per_customer_sql(customer_amounts(spark, sf)))


@query("""
SELECT round(avg(value), 4) AS average_value, count(value) AS readings FROM events
""")
def global_average(spark, sf):
    return table(spark, sf, "events").agg(
        F.round(F.avg("value"), 4).alias("average_value"), F.count("value").alias("readings")
    )


@query("""
SELECT o_custkey, count(*) AS orders FROM orders GROUP BY o_custkey HAVING count(*) > 12
""")
def busy_customers(spark, sf):
    counts = agg.value_counts(table(spark, sf, "orders"), ["o_custkey"], "orders")
    return counts.filter(F.col("orders") > 12)


@query("""
SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers,
       count(DISTINCT l_orderkey) AS orders
FROM lineitem GROUP BY l_returnflag
""")
def count_distincts(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count_distinct("l_partkey").alias("parts"),
        F.count_distinct("l_suppkey").alias("suppliers"),
        F.count_distinct("l_orderkey").alias("orders"),
    )


@query("SELECT DISTINCT lang, source FROM documents")
def distinct_values(spark, sf):
    return table(spark, sf, "documents").select("lang", "source").distinct()


@query("SELECT DISTINCT md5(text) AS text_hash, lang, n_chars FROM documents")
def dedupe_exact(spark, sf):
    hashed = table(spark, sf, "documents").select(F.md5("text").alias("text_hash"), "lang", "n_chars")
    return hashed.dropDuplicates()


@query("""
SELECT * EXCLUDE (rn) FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey,
                            l_quantity, l_extendedprice, l_returnflag) AS rn
  FROM lineitem) WHERE rn = 1
""")
def dedupe_by_keys(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_returnflag",
    )
    return dedupe_by_key(lines, ["l_orderkey", "l_linenumber"])


@query("SELECT md5(text) AS text_hash, min(doc_id) AS doc_id FROM documents GROUP BY md5(text)")
def one_document_per_text(spark, sf):
    hashed = table(spark, sf, "documents").select(F.md5("text").alias("text_hash"), "doc_id")
    return dedupe_by_key(hashed, ["text_hash"])


@query("""
SELECT md5(text) AS text_hash, count(*) AS occurrence_count FROM documents
GROUP BY md5(text) HAVING count(*) > 1
""")
def dup_values(spark, sf):
    hashed = table(spark, sf, "documents").select(F.md5("text").alias("text_hash"))
    return agg.duplicated_values(hashed, ["text_hash"])


@query("SELECT md5(text) AS text_hash FROM documents GROUP BY md5(text) HAVING count(*) = 1")
def unique_values(spark, sf):
    hashed = table(spark, sf, "documents").select(F.md5("text").alias("text_hash"))
    return agg.single_values(hashed, ["text_hash"])


@query("""
SELECT l_orderkey, l_linenumber, count(*) AS duplicate_count FROM lineitem
GROUP BY ALL HAVING count(*) > 1
""")
def duplicate_line_keys(spark, sf):
    return quality.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


PEOPLE_SQL = """
people AS (
  SELECT c_custkey AS id, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS name,
         CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS age
  FROM customer),
mean AS (SELECT avg(age) AS m FROM people)
"""


def people_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Customers twice over, some without name or balance (the balance stands for age)."""
    key = F.col("c_custkey")
    once = table(spark, sf, "customer").select(
        key.alias("id"), F.when(key % 5 != 0, F.col("c_name")).alias("name"),
        F.when(key % 7 != 0, F.col("c_acctbal")).alias("age"),
    )
    return once.unionAll(once)


@query(f"""
WITH {PEOPLE_SQL}
SELECT id, coalesce(name, 'Unknown') AS name, round(coalesce(age, m), 4) AS age FROM people, mean
""")
def mean_impute(spark, sf):
    cleaned = people.clean_people(people_with_gaps(spark, sf))
    return cleaned.withColumn("age", F.round("age", 4))


@query(f"""
WITH {PEOPLE_SQL}
SELECT id, coalesce(name, 'Unknown') AS name, round(coalesce(age, m), 4) AS age
FROM people, mean WHERE coalesce(age, m) > 4000
""")
def people_over_limit(spark, sf):
    cleaned = people.older_than(people.clean_people(people_with_gaps(spark, sf)), 4000)
    return cleaned.withColumn("age", F.round("age", 4))


@query("""
SELECT strftime(o_orderdate, '%Y-%m') AS month,
       CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(12,2)) END) AS DOUBLE) AS F,
       CAST(sum(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(12,2)) END) AS DOUBLE) AS O,
       CAST(sum(CASE WHEN o_orderstatus = 'P' THEN CAST(o_totalprice AS DECIMAL(12,2)) END) AS DOUBLE) AS P
FROM orders GROUP BY 1
""")
def pivot_status(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderstatus",
        money("o_totalprice").alias("amount"),
    )
    return plain(agg.pivot_sum(orders, "month", "o_orderstatus", ["F", "O", "P"], "amount"))


@query("""
SELECT c_mktsegment, CAST(CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END
       AS INTEGER) AS place, count(*) AS customers
FROM customer GROUP BY 1
""")
def business_order(spark, sf):
    place = agg.order_by_list("c_mktsegment", ["MACHINERY", "BUILDING"])
    counts = agg.value_counts(table(spark, sf, "customer"), ["c_mktsegment"], "customers")
    return counts.withColumn("place", place.cast("int")).orderBy("place", "c_mktsegment")


@query("""
SELECT event_type, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total_amount
FROM events GROUP BY event_type
""")
def salted_sum(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", money("value").alias("value"))
    return plain(agg.salted_sum(events, ["event_type"], "value", ["event_id"], "total_amount"))


@query("""
SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total, max(l_quantity) AS largest,
       min(l_quantity) AS smallest,
       CAST(coalesce(sum(l_linenumber) FILTER (WHERE l_quantity > 1000), 0) AS BIGINT) AS folded
FROM lineitem
""")
def reduce_actions(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn(
        "_none", F.when(F.col("l_quantity") > 1000, F.col("l_linenumber"))
    )
    return lines.agg(
        F.count("*").alias("n"), F.sum("l_linenumber").alias("total"),
        F.max("l_quantity").alias("largest"), F.min("l_quantity").alias("smallest"),
        agg.fold_sum("_none").alias("folded"),
    )


@query("SELECT l_linestatus, l_returnflag, count(*) AS occurrence_count FROM lineitem GROUP BY ALL")
def count_by_value(spark, sf):
    return agg.value_counts(table(spark, sf, "lineitem"), ["l_linestatus", "l_returnflag"])


@query("""
SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal = (SELECT min(c_acctbal) FROM customer)
""")
def rows_at_minimum(spark, sf):
    return agg.rows_at_minimum(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")


@query("""
SELECT user_id, min(value) AS min_value FROM events WHERE event_type = 'error' GROUP BY user_id
""")
def min_value_by_type(spark, sf):
    return spend.minimum_by_type(
        table(spark, sf, "events"), "error", "user_id", "value", "event_type"
    )


def etl_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders twice with some missing dates, amounts and customers; customers without some labels."""
    key = F.col("o_orderkey")
    orders = table(spark, sf, "orders").select(
        key.alias("order_id"),
        F.when(key % 11 != 0, F.col("o_custkey")).alias("customer_id"),
        F.when(key % 13 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"),
        F.when(key % 17 != 0, money("o_totalprice")).alias("amount"),
    )
    nation = table(spark, sf, "nation")
    cust = F.col("c_custkey")
    customers = (
        table(spark, sf, "customer").filter(F.col("c_acctbal") > 0)
        .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
        .select(
            cust.alias("customer_id"), F.when(cust % 19 != 0, F.col("n_name")).alias("city"),
            F.when(cust % 23 != 0, F.col("c_mktsegment")).alias("segment"),
        )
    )
    return orders.unionAll(orders), customers.unionAll(customers)


ETL_SQL = """
o AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id,
         CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_totalprice AS DECIMAL(12,2)) ELSE 0 END AS amount
  FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0),
c AS (
  SELECT c_custkey AS customer_id,
         CASE WHEN c_custkey % 19 <> 0 THEN n_name END AS city,
         CASE WHEN c_custkey % 23 <> 0 THEN c_mktsegment END AS segment
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0),
e AS (
  SELECT o.*, coalesce(city, 'Unknown') AS city, coalesce(segment, 'Unknown') AS segment
  FROM o LEFT JOIN c USING (customer_id))
"""


def etl_enriched(spark: SparkSession, sf: str) -> DataFrame:
    orders, customers = etl_inputs(spark, sf)
    usable = etl.usable_orders(orders).withColumn("amount", money("amount"))
    return etl.with_labels(usable, etl.usable_customers(customers))


@query(f"WITH {ETL_SQL} SELECT city, CAST(sum(amount) AS DOUBLE) AS total_sales FROM e GROUP BY city")
def etl_city_totals(spark, sf):
    return plain(etl.report(etl_enriched(spark, sf), ["city"], "amount", "total_sales"))


@query(f"""
WITH {ETL_SQL}
SELECT segment, round(CAST(sum(amount) AS DOUBLE) / count(*), 3) AS average_order_value
FROM e GROUP BY segment
""")
def etl_segment_avg(spark, sf):
    averages = plain(etl.report(etl_enriched(spark, sf), ["segment"], "amount", "average_order_value", "mean"))
    return averages.withColumn("average_order_value", F.round("average_order_value", 3))


@query(f"""
WITH {ETL_SQL}
SELECT customer_id, CAST(sum(amount) AS DOUBLE) AS total_spend FROM e GROUP BY customer_id
ORDER BY 2 DESC, 1 LIMIT 3
""")
def etl_top3(spark, sf):
    return plain(etl.report(etl_enriched(spark, sf), ["customer_id"], "amount", "total_spend", n=3))


@query(f"""
WITH {ETL_SQL},
t AS (SELECT city, customer_id, sum(amount) AS total FROM e GROUP BY city, customer_id),
r AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY total DESC, customer_id) AS rn FROM t)
SELECT city, customer_id, CAST(total AS DOUBLE) AS total_spend, CAST(rn AS INTEGER) AS spending_position
FROM r WHERE rn <= 3
""")
def etl_top3_per_city(spark, sf):
    leaders = etl.report(etl_enriched(spark, sf), ["city", "customer_id"], "amount", "total_spend", n=3,
                         within=["city"], position="spending_position")
    return plain(leaders)
