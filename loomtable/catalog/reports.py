"""Retail reports and validation over facts built from orders and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtable.catalog import money, plain, query, table
from loomtable.functions.cleaning import order_total
from loomtable.operators import quality
from loomtable.plans import checks, reports

NET = "round(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(5,2))), 2)"
LINES_SQL = f"""
l AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity,
         {NET} AS amount, CAST(l_shipdate AS DATE) AS ship_date
  FROM lineitem)
"""
FACT_SQL = f"""
{LINES_SQL},
f AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS order_status,
         o_orderpriority AS payment_method, CAST(o_orderdate AS DATE) AS order_date,
         sum(quantity) AS quantity, sum(amount) AS amount
  FROM orders JOIN l ON o_orderkey = order_id GROUP BY ALL)
"""


def line_facts(spark: SparkSession, sf: str) -> DataFrame:
    """One fact per order line: product, quantity and net amount."""
    net = money("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(5,2)"))
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.round(net, 2).alias("calculated_total_amount"), F.to_date("l_shipdate").alias("ship_date"),
    )


def order_heads(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("order_status"), F.col("o_orderpriority").alias("payment_method"),
        F.to_date("o_orderdate").alias("order_date"),
    )


def order_facts(spark: SparkSession, sf: str) -> DataFrame:
    """One fact per order; lines are added up before they meet the order heads."""
    totals = line_facts(spark, sf).groupBy("order_id").agg(
        F.sum("quantity").alias("quantity"),
        F.sum("calculated_total_amount").alias("calculated_total_amount"),
    )
    return order_heads(spark, sf).join(totals, "order_id")


def customer_dim(spark: SparkSession, sf: str) -> DataFrame:
    nation = F.broadcast(table(spark, sf, "nation"))  # 25 rows
    return table(spark, sf, "customer").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    ).select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("first_name"),
        F.col("c_mktsegment").alias("last_name"), F.col("n_name").alias("country"),
        F.col("n_regionkey").alias("state"),
    )


def product_dim(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"), F.col("p_brand").alias("brand"),
        money("p_retailprice").alias("price"), money("p_retailprice").alias("cost"),
    )


AVERAGE = "CAST(round(sum(amount) / count(amount), 2) AS DOUBLE) AS average_order_value"


@query(f"""
WITH {FACT_SQL}
SELECT count(DISTINCT order_id) AS total_orders, count(DISTINCT customer_id) AS unique_customers,
       CAST(sum(quantity) AS BIGINT) AS total_units, CAST(sum(amount) AS DOUBLE) AS total_revenue,
       {AVERAGE}
FROM f
""")
def overall_performance(spark, sf):
    return plain(reports.overall_performance(order_facts(spark, sf), per_order=True))


@query(f"""
WITH {LINES_SQL}
SELECT p_type AS category, count(DISTINCT order_id) AS total_orders,
       CAST(sum(quantity) AS BIGINT) AS total_units, CAST(sum(amount) AS DOUBLE) AS total_revenue,
       CAST(sum(amount - quantity * CAST(p_retailprice AS DECIMAL(12,2))) AS DOUBLE) AS estimated_profit
FROM l JOIN part ON product_id = p_partkey GROUP BY p_type
""")
def revenue_by_category(spark, sf):
    return plain(reports.revenue_by_category(line_facts(spark, sf), product_dim(spark, sf)))


CUSTOMER_SALES_SQL = f"""
WITH {FACT_SQL},
s AS (
  SELECT customer_id, c_name AS first_name, c_mktsegment AS last_name, n_name AS country,
         n_regionkey AS state, count(DISTINCT order_id) AS total_orders,
         CAST(sum(quantity) AS BIGINT) AS total_units, CAST(sum(amount) AS DOUBLE) AS total_revenue
  FROM f JOIN customer ON customer_id = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY ALL)
SELECT * FROM s
"""


@query(CUSTOMER_SALES_SQL + " ORDER BY total_revenue DESC, customer_id LIMIT 10")
def top_customers_by_revenue(spark, sf):
    return plain(reports.top_customers(order_facts(spark, sf), customer_dim(spark, sf), per_order=True))


@query(CUSTOMER_SALES_SQL)
def mart_customer_sales(spark, sf):
    return plain(reports.customer_sales(order_facts(spark, sf), customer_dim(spark, sf), per_order=True))


PRODUCT_SALES_SQL = f"""
WITH {LINES_SQL},
s AS (
  SELECT product_id, p_name AS product_name, p_type AS category, p_brand AS brand,
         count(DISTINCT order_id) AS total_orders, CAST(sum(quantity) AS BIGINT) AS total_units,
         CAST(sum(amount) AS DOUBLE) AS total_revenue,
         CAST(sum(amount - quantity * CAST(p_retailprice AS DECIMAL(12,2))) AS DOUBLE) AS estimated_profit
  FROM l JOIN part ON product_id = p_partkey GROUP BY ALL)
SELECT * FROM s
"""


@query(PRODUCT_SALES_SQL + " ORDER BY total_units DESC, total_revenue DESC, product_id LIMIT 10")
def top_products_by_units(spark, sf):
    return plain(reports.top_products(line_facts(spark, sf), product_dim(spark, sf)))


@query(PRODUCT_SALES_SQL)
def mart_product_sales(spark, sf):
    return plain(reports.product_sales(line_facts(spark, sf), product_dim(spark, sf)))


@query(f"""
WITH {FACT_SQL}
SELECT order_status, payment_method, count(DISTINCT order_id) AS total_orders,
       CAST(sum(quantity) AS BIGINT) AS total_units, CAST(sum(amount) AS DOUBLE) AS total_revenue
FROM f GROUP BY ALL
""")
def revenue_by_status_payment(spark, sf):
    return plain(reports.revenue_by_status_payment(order_facts(spark, sf), per_order=True))


@query(f"""
WITH {FACT_SQL}
SELECT CAST(date_trunc('month', order_date) AS DATE) AS sales_month,
       count(DISTINCT order_id) AS total_orders, count(DISTINCT customer_id) AS unique_customers,
       CAST(sum(quantity) AS BIGINT) AS total_units, CAST(sum(amount) AS DOUBLE) AS total_revenue,
       {AVERAGE}
FROM f GROUP BY 1
""")
def monthly_sales_trend(spark, sf):
    return plain(reports.monthly_trend(order_facts(spark, sf), per_order=True))


@query(f"""
WITH {LINES_SQL}
SELECT o_orderstatus AS order_status, count(*) AS shipped_order_count,
       round(avg(date_diff('day', CAST(o_orderdate AS DATE), ship_date)), 2) AS average_shipping_days
FROM orders JOIN l ON o_orderkey = order_id WHERE ship_date IS NOT NULL GROUP BY 1
""")
def avg_shipping_days(spark, sf):
    lines = line_facts(spark, sf).select("order_id", "ship_date")
    return plain(reports.shipping_days_by_status(order_heads(spark, sf).join(lines, "order_id")))


@query("""
WITH p AS (SELECT p_partkey, CAST(p_retailprice AS DECIMAL(12,2)) AS price, 10 * p_size AS cost FROM part)
SELECT p_partkey AS product_id, CAST(price AS DOUBLE) AS price, CAST(price - cost AS DOUBLE) AS gross_margin,
       CAST(round((price - cost) * 100 / price, 2) AS DOUBLE) AS gross_margin_pct
FROM p
""")
def product_margin(spark, sf):
    """Margins with a cost that follows the size, as the tables hold none."""
    cost = (F.col("p_size") * 10).cast("decimal(12,2)")
    products = table(spark, sf, "part").select(
        F.col("p_partkey").alias("product_id"), money("p_retailprice").alias("price"), cost.alias("cost"))
    margins = reports.with_margin(products)
    return plain(margins.select("product_id", "price", "gross_margin", "gross_margin_pct"))


def checked_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines in the shape of order facts, as stored and unchecked."""
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("product_id"), F.to_date("l_shipdate").alias("ship_date"),
        F.col("l_quantity").cast("int").alias("quantity"), money("l_extendedprice").alias("unit_price"),
        (F.col("l_discount") * 100).cast("decimal(5,2)").alias("discount_pct"),
        # A stored total that ignores the discount, so that rows with one fail the recheck.
        (F.col("l_quantity").cast("int") * money("l_extendedprice")).cast("decimal(14,2)")
        .alias("calculated_total_amount"),
    )
    return lines.join(order_heads(spark, sf).select("order_id", "customer_id", "order_date"), "order_id")


CHECKED_SQL = """
k AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS product_id,
         CAST(l_quantity AS INTEGER) AS q, CAST(l_extendedprice AS DECIMAL(12,2)) AS p,
         CAST(round(l_discount * 100) AS INTEGER) AS d
  FROM lineitem)
"""


@query(f"""
WITH {CHECKED_SQL}
SELECT order_id, CAST(q * p AS DOUBLE) AS stored_total,
       CAST(round(CAST(q * p AS DECIMAL(18,2)) * CAST((100 - d) * 0.01 AS DECIMAL(5,2)), 2) AS DOUBLE) AS recalculated_total,
       CASE WHEN d = 0 THEN 'PASS' ELSE 'FAIL' END AS validation_result
FROM k
""")
def validation_pass_fail(spark, sf):
    return plain(checks.recheck_totals(checked_lines(spark, sf)))


@query("""
SELECT l_orderkey AS order_id, l_linenumber AS line, 'shipped before ordered' AS rules
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate
""")
def rule_violations(spark, sf):
    bad = checks.rule_violations(checked_lines(spark, sf))
    return bad.select("order_id", "line", F.array_join("broken_rules", ", ").alias("rules"))


@query(f"""
WITH {CHECKED_SQL}
SELECT order_id, line,
       CAST(round(CAST(q * p AS DECIMAL(18,2)) * CAST((100 - d) * 0.01 AS DECIMAL(5,2)), 2) AS DOUBLE) AS total,
       CAST(CAST(q * p AS DECIMAL(18,2))
            - round(CAST(q * p AS DECIMAL(18,2)) * CAST((100 - d) * 0.01 AS DECIMAL(5,2)), 2) AS DOUBLE) AS difference
FROM k
""")
def recalculated_total(spark, sf):
    lines = checked_lines(spark, sf).withColumn(
        "total", order_total(F.col("quantity"), F.col("unit_price"), F.col("discount_pct"))
    )
    gap = F.abs(F.col("calculated_total_amount") - F.col("total"))
    return plain(lines.select("order_id", "line", "total", gap.alias("difference")))


@query("""
SELECT 'customers' AS dataset, (SELECT count(*) FROM customer) AS source_record_count,
       (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS target_record_count,
       (SELECT count(*) FROM customer WHERE NOT c_acctbal > 0) AS removed_record_count
UNION ALL
SELECT 'orders', (SELECT count(*) FROM orders), (SELECT count(*) FROM orders WHERE o_orderstatus = 'F'),
       (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F')
""")
def dq_counts(spark, sf):
    sources = {"customers": table(spark, sf, "customer"), "orders": table(spark, sf, "orders")}
    return quality.count_summary(sources, _kept(sources))


def _kept(sources: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {
        "customers": sources["customers"].filter(F.col("c_acctbal") > 0),
        "orders": sources["orders"].filter(F.col("o_orderstatus") == "F"),
    }


@query("""
SELECT 'customers' AS dataset, count(*) AS target_record_count, count(*) AS loaded_record_count,
       'PASS' AS validation_result FROM customer WHERE c_acctbal > 0
UNION ALL
SELECT 'orders', count(*) FILTER (WHERE o_orderstatus = 'F'), count(*), 'FAIL' FROM orders
""")
def dq_reconcile(spark, sf):
    sources = {"customers": table(spark, sf, "customer"), "orders": table(spark, sf, "orders")}
    kept = _kept(sources)
    expected = quality.count_summary(sources, kept)
    return quality.count_reconcile(expected, {"customers": kept["customers"], "orders": sources["orders"]})
