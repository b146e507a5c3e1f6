"""Retail curation over dirty text tables derived from customer, part, orders and lineitem.

Each raw column mixes the spellings, formats and errors that the cleaning rules deal
with; which one a row gets depends on its key. The SQL states the clean value directly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtable.catalog import plain, query, table
from loomtable.plans import retail
from loomtable.schemas import RAW_CUSTOMERS, RAW_ORDERS, RAW_PRODUCTS


def pick(key: Column, *choices: Column | str | None) -> Column:
    """Choice number ``key % len(choices)``."""
    place = F.pmod(key, F.lit(len(choices)))
    result = F.when(F.lit(False), "")
    for i, choice in enumerate(choices):
        value = F.lit(choice) if choice is None or isinstance(choice, str) else choice
        result = result.when(place == i, value)
    return result


def text(value: Column) -> Column:
    return value.cast("string")


def raw_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer twice: once as meant, once as a later copy with another first name."""
    k = F.col("c_custkey")
    digits = F.lpad(text(k), 10, "2")
    area, middle, last = (F.substring(digits, a, n) for a, n in ((1, 3), (4, 3), (7, 4)))
    day = F.date_add(F.to_date(F.lit("2020-01-01")), F.pmod(k, F.lit(1000)).cast("int"))
    once = table(spark, sf, "customer").select(
        F.when(k % 11 == 0, "N/A").when(k % 13 == 0, F.concat(text(k), F.lit(".7")))
        .otherwise(F.concat(F.lit(" "), text(k), F.lit(" "))).alias("customer_id"),
        F.concat(F.lit(" "), F.upper("c_mktsegment"), F.lit("  ")).alias("first_name"),
        F.when(k % 9 == 0, "null").otherwise(F.lower("c_name")).alias("last_name"),
        pick(k, F.concat(F.lit("User"), text(k), F.lit("@Example.COM")), "bad-email", " NONE ",
             F.concat(F.lit("u."), text(k), F.lit("+x@mail.example.org"))).alias("email"),
        pick(k, F.format_string("(%s) %s-%s", area, middle, last),
             F.format_string("1-%s-%s-%s", area, middle, last), "555",
             F.concat_ws(".", area, middle, last)).alias("phone"),
        pick(k, F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "yyyy/MM/dd"),
             F.date_format(day, "dd-MM-yyyy"), "2023-02-30").alias("signup_date"),
        pick(k, "U.S.A.", "united states", " Canada", "mexico", "France").alias("country"),
        pick(k, "minnesota", "WI", "Ontario", "N/A").alias("state"),
        F.when(k % 6 == 0, "").otherwise(F.lpad(text(F.pmod(k, F.lit(100000))), 5, "0")).alias("postal_code"),
        pick(k, "TRUE", "Yes", "1", "No", "n", "maybe").alias("is_active"),
        pick(k, "-5", text(F.pmod(k, F.lit(100001))), "100001", "NaN").alias("loyalty_points"),
    )
    return once.unionAll(once.withColumn("first_name", F.lit("zz"))).select(*RAW_CUSTOMERS.fieldNames())


CUSTOMERS_SQL = """
cc AS (
  SELECT CAST(k AS BIGINT) AS customer_id,
    upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS first_name,
    CASE WHEN k % 9 <> 0 THEN upper(left(c_name, 1)) || lower(substr(c_name, 2)) END AS last_name,
    CASE k % 4 WHEN 0 THEN 'user' || k || '@example.com' WHEN 3 THEN 'u.' || k || '+x@mail.example.org' END AS email,
    CASE WHEN k % 4 <> 2 THEN substr(digits, 1, 3) || '-' || substr(digits, 4, 3) || '-' || substr(digits, 7, 4) END AS phone,
    CASE WHEN k % 4 <> 3 THEN DATE '2020-01-01' + CAST(k % 1000 AS INTEGER) END AS signup_date,
    CASE k % 5 WHEN 2 THEN 'CANADA' WHEN 3 THEN 'MEXICO' WHEN 4 THEN 'FRANCE' ELSE 'USA' END AS country,
    CASE k % 4 WHEN 0 THEN 'MN' WHEN 1 THEN 'WI' WHEN 2 THEN 'ON' END AS state,
    CASE WHEN k % 6 <> 0 THEN lpad(CAST(k % 100000 AS VARCHAR), 5, '0') END AS postal_code,
    CASE WHEN k % 6 < 3 THEN true WHEN k % 6 < 5 THEN false END AS is_active,
    CAST(CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN k % 100001 END AS INTEGER) AS loyalty_points
  FROM (SELECT *, c_custkey AS k, lpad(CAST(c_custkey AS VARCHAR), 10, '2') AS digits FROM customer)
  WHERE k % 11 <> 0)
"""


#: Product ids here have four digits or more, so that every part has one of its own.
PRODUCT_IDS = r"^P\d{4,}$"


def part_number(key: Column) -> Column:
    return F.when(key < 1000, F.lpad(text(key), 4, "0")).otherwise(text(key))


def raw_products(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    price = F.col("p_retailprice").cast("decimal(12,2)")
    day = F.date_add(F.to_date(F.lit("2021-01-01")), F.pmod(k, F.lit(700)).cast("int"))
    number = part_number(k)
    return table(spark, sf, "part").select(
        F.when(k % 17 == 0, F.concat(F.lit("X"), text(k))).otherwise(F.concat(F.lit(" p"), number)).alias("product_id"),
        F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("product_name"),
        F.concat(F.lit(" "), F.upper("p_type")).alias("category"),
        F.when(k % 10 == 0, "ikea").otherwise(F.col("p_brand")).alias("brand"),
        pick(k, F.concat(F.lit("$"), text(price)), F.translate(text(price), ".", ","),
             "-5", "abc", "€ 1,234.50").alias("price"),
        pick(k, text(F.round(price * F.lit("0.6").cast("decimal(2,1)"), 2)), "-1", "0").alias("cost"),
        F.when(k % 4 == 0, "-3").otherwise(text(F.pmod(k, F.lit(500)))).alias("stock_quantity"),
        pick(k, "1.2345", "0", "n/a").alias("weight_kg"),
        pick(k, F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "yyyy/MM/dd"), "2022-13-01").alias("created_date"),
        pick(k, "Y", "FALSE").alias("is_active"),
    ).select(*RAW_PRODUCTS.fieldNames())


PRODUCTS_SQL = """
cp AS (
  SELECT * EXCLUDE (k, rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY product_name, category_text, brand_text,
                                 price_text, cost_text, stock_text, k) AS rn
    FROM (
      SELECT k, 'P' || lpad(CAST(k AS VARCHAR), greatest(4, length(CAST(k AS VARCHAR)))::INTEGER, '0') AS product_id, p_name AS product_name,
        upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS category, upper(p_type) AS category_text,
        CASE WHEN k % 10 = 0 THEN 'IKEA' ELSE p_brand END AS brand,
        CASE WHEN k % 10 = 0 THEN 'ikea' ELSE p_brand END AS brand_text,
        CAST(CASE k % 5 WHEN 0 THEN price WHEN 1 THEN price WHEN 4 THEN 1234.50 END AS DECIMAL(12,2)) AS price,
        [ '$' || price, replace(CAST(price AS VARCHAR), '.', ','), '-5', 'abc', '€ 1,234.50'][k % 5 + 1] AS price_text,
        CAST(CASE k % 3 WHEN 0 THEN round(price * CAST(0.6 AS DECIMAL(2,1)), 2) WHEN 2 THEN 0 END AS DECIMAL(12,2)) AS cost,
        [CAST(round(price * CAST(0.6 AS DECIMAL(2,1)), 2) AS VARCHAR), '-1', '0'][k % 3 + 1] AS cost_text,
        CAST(CASE WHEN k % 4 = 0 THEN 0 ELSE k % 500 END AS INTEGER) AS stock_quantity,
        CASE WHEN k % 4 = 0 THEN '-3' ELSE CAST(k % 500 AS VARCHAR) END AS stock_text,
        CAST(CASE k % 3 WHEN 0 THEN 1.235 END AS DECIMAL(8,3)) AS weight_kg,
        CASE WHEN k % 3 < 2 THEN DATE '2021-01-01' + CAST(k % 700 AS INTEGER) END AS created_date,
        k % 2 = 0 AS is_active
      FROM (SELECT *, p_partkey AS k, CAST(p_retailprice AS DECIMAL(12,2)) AS price FROM part)
      WHERE k % 17 <> 0))
  WHERE rn = 1)
"""
PRODUCT_COLUMNS = (
    "product_id, product_name, category, brand, price, cost, stock_quantity, weight_kg, created_date, is_active"
)


def raw_orders(spark: SparkSession, sf: str) -> DataFrame:
    """One raw order per line item, so most order ids come several times."""
    k, qty = F.col("l_orderkey"), F.col("l_quantity").cast("int")
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    pct = F.round(F.col("l_discount") * 100).cast("int")
    date = F.col("o_orderdate")
    total = F.round(qty * price * (100 - pct) * F.lit("0.01").cast("decimal(3,2)"), 2)
    heads = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf, "lineitem").join(heads, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(
        F.when(k % 29 == 0, "XYZ").otherwise(text(k)).alias("order_id"),
        F.when(k % 31 == 0, "").otherwise(text(F.col("o_custkey"))).alias("customer_id"),
        F.concat(F.lit("p"), part_number(F.col("l_partkey"))).alias("product_id"),
        F.when(k % 37 == 0, "15-30-2023").otherwise(pick(
            k, F.date_format(date, "yyyy-MM-dd"), F.date_format(date, "yyyy/MM/dd"),
            F.date_format(date, "MM-dd-yyyy"),
        )).alias("order_date"),
        F.when(k % 5 == 0, "null").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("ship_date"),
        F.when(k % 41 == 0, "1000").when(k % 43 == 0, "two").otherwise(text(qty)).alias("quantity"),
        pick(k, F.concat(F.lit("$"), text(price)), F.translate(text(price), ".", ",")).alias("unit_price"),
        F.when(k % 7 == 0, "").when(k % 47 == 0, "150").otherwise(text(pct)).alias("discount_pct"),
        F.when(k % 3 == 0, "").otherwise(text(total)).alias("total_amount"),
        pick(k, " VISA", "credit card", "DEBIT", "PayPal ", "apple pay", "GooglePay", "CASH", "n/a",
             "gift card").alias("payment_method"),
        pick(k, "SHIPPED", "pending", "", "on hold").alias("order_status"),
    ).select(*RAW_ORDERS.fieldNames())


ORDERS_SQL = """
co AS (
  SELECT * EXCLUDE (rn, customer_text, date_text, ship_text, quantity_text, price_text, discount_text, total_text)
  FROM (
    SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY customer_text, product_id, date_text, ship_text,
                                 quantity_text, price_text, discount_text, total_text) AS rn
    FROM (
      SELECT CAST(CASE WHEN k % 29 <> 0 THEN k END AS BIGINT) AS order_id,
        CAST(CASE WHEN k % 31 <> 0 THEN o_custkey END AS BIGINT) AS customer_id,
        CASE WHEN k % 31 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS customer_text,
        'P' || lpad(CAST(l_partkey AS VARCHAR), greatest(4, length(CAST(l_partkey AS VARCHAR)))::INTEGER, '0') AS product_id,
        CASE WHEN k % 37 <> 0 THEN CAST(o_orderdate AS DATE) END AS order_date,
        CASE WHEN k % 37 = 0 THEN '15-30-2023' WHEN k % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
             WHEN k % 3 = 1 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%m-%d-%Y') END AS date_text,
        CASE WHEN k % 5 <> 0 THEN CAST(l_shipdate AS DATE) END AS ship_date,
        CASE WHEN k % 5 = 0 THEN 'null' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS ship_text,
        CAST(CASE WHEN k % 41 = 0 THEN 1000 WHEN k % 43 <> 0 THEN qty END AS INTEGER) AS quantity,
        CASE WHEN k % 41 = 0 THEN '1000' WHEN k % 43 = 0 THEN 'two' ELSE CAST(qty AS VARCHAR) END AS quantity_text,
        price AS unit_price,
        CASE WHEN k % 2 = 0 THEN '$' || price ELSE replace(CAST(price AS VARCHAR), '.', ',') END AS price_text,
        CAST(CASE WHEN k % 7 = 0 THEN 0 WHEN k % 47 = 0 THEN 150 ELSE pct END AS DECIMAL(5,2)) AS discount_pct,
        CASE WHEN k % 7 = 0 THEN '' WHEN k % 47 = 0 THEN '150' ELSE CAST(pct AS VARCHAR) END AS discount_text,
        CASE WHEN k % 3 <> 0 THEN total END AS source_total_amount,
        CASE WHEN k % 3 = 0 THEN '' ELSE CAST(total AS VARCHAR) END AS total_text,
        ['Credit Card', 'Credit Card', 'Debit Card', 'PayPal', 'Apple Pay', 'Google Pay', 'Cash',
         'Unknown', 'Gift Card'][k % 9 + 1] AS payment_method,
        ['Shipped', 'Pending', 'Unknown', 'On Hold'][k % 4 + 1] AS order_status
      FROM (SELECT *, CAST(round(CAST(qty * price AS DECIMAL(18,2)) * CAST((100 - pct) * 0.01 AS DECIMAL(5,2)), 2)
                      AS DECIMAL(12,2)) AS total
            FROM (SELECT *, l_orderkey AS k, CAST(l_quantity AS INTEGER) AS qty,
                         CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
                         CAST(round(l_discount * 100) AS INTEGER) AS pct
                  FROM lineitem JOIN orders ON l_orderkey = o_orderkey))))
  WHERE rn = 1)
"""
FACTS_SQL = """
cf AS (
  SELECT *, CASE WHEN source_total_amount IS NOT NULL
            THEN abs(source_total_amount - calculated_total_amount) END AS amount_difference
  FROM (
    SELECT *, CAST(round(CAST(quantity * unit_price AS DECIMAL(18,2))
         * CAST((100 - discount_pct) * 0.01 AS DECIMAL(7,4)), 2) AS DECIMAL(14,2)) AS calculated_total_amount
    FROM co
    WHERE order_id IS NOT NULL AND customer_id IN (SELECT customer_id FROM cc)
      AND product_id IN (SELECT product_id FROM cp) AND order_date IS NOT NULL
      AND (ship_date IS NULL OR ship_date >= order_date)
      AND quantity BETWEEN 1 AND 100 AND unit_price > 0 AND discount_pct BETWEEN 0 AND 100))
"""
ALL_SQL = f"WITH {CUSTOMERS_SQL}, {PRODUCTS_SQL}, {ORDERS_SQL}, {FACTS_SQL}"


def doubles(*names: str) -> str:
    """DuckDB clause that turns decimal columns into doubles."""
    return "REPLACE (" + ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names) + ")"


def raw_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {
        "customers": raw_customers(spark, sf),
        "products": raw_products(spark, sf),
        "orders": raw_orders(spark, sf),
    }


@query(f"WITH {CUSTOMERS_SQL} SELECT * FROM cc")
def clean_customers(spark, sf):
    return retail.clean_customers(raw_customers(spark, sf))


@query(f"""
WITH {PRODUCTS_SQL}
SELECT * {doubles('price', 'cost', 'weight_kg')} FROM (SELECT {PRODUCT_COLUMNS} FROM cp)
""")
def clean_products(spark, sf):
    return plain(retail.clean_products(raw_products(spark, sf), PRODUCT_IDS))


@query(f"WITH {ORDERS_SQL} SELECT * {doubles('unit_price', 'discount_pct', 'source_total_amount')} FROM co")
def clean_orders(spark, sf):
    return plain(retail.clean_orders(raw_orders(spark, sf)))


@query(f"""
{ALL_SQL}
SELECT * {doubles('unit_price', 'discount_pct', 'source_total_amount', 'calculated_total_amount',
                  'amount_difference')} FROM cf
""")
def retail_fact_orders(spark, sf):
    return plain(retail.curate(raw_tables(spark, sf), PRODUCT_IDS)["orders"])


@query(f"""
{ALL_SQL}
SELECT order_id, order_date, strftime(order_date, '%Y-%m') AS order_month, ship_date,
  CAST(date_diff('day', order_date, ship_date) AS INTEGER) AS shipping_days, order_status, payment_method,
  customer_id, concat_ws(' ', first_name, last_name) AS customer_name, email, country, state,
  product_id, product_name, category, brand, quantity, CAST(price AS DOUBLE) AS list_price,
  CAST(unit_price AS DOUBLE) AS unit_price, CAST(cost AS DOUBLE) AS cost,
  CAST(discount_pct AS DOUBLE) AS discount_pct, CAST(quantity * unit_price AS DOUBLE) AS gross_sales,
  CAST(round(CAST(quantity * unit_price AS DECIMAL(18,2)) * CAST(discount_pct * 0.01 AS DECIMAL(7,4)), 2)
       AS DOUBLE) AS discount_amount,
  CAST(calculated_total_amount AS DOUBLE) AS net_sales, CAST(quantity * cost AS DOUBLE) AS total_cost,
  CAST(calculated_total_amount - quantity * cost AS DOUBLE) AS profit
FROM cf JOIN cc USING (customer_id) JOIN cp USING (product_id)
""")
def retail_sales_enriched(spark, sf):
    return plain(retail.curate(raw_tables(spark, sf), PRODUCT_IDS)["sales_enriched"])


@query(f"""
{ALL_SQL},
n AS (
  SELECT 'customers' AS dataset, (SELECT 2 * count(*) FROM customer) AS s, (SELECT count(*) FROM cc) AS t
  UNION ALL SELECT 'products', (SELECT count(*) FROM part), (SELECT count(*) FROM cp)
  UNION ALL SELECT 'orders', (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
                   (SELECT count(*) FROM cf))
SELECT dataset, CAST(s AS BIGINT) AS source_record_count, t AS target_record_count,
       CAST(s - t AS BIGINT) AS removed_record_count FROM n
""")
def retail_dq_summary(spark, sf):
    return retail.curate(raw_tables(spark, sf), PRODUCT_IDS)["data_quality_summary"]
