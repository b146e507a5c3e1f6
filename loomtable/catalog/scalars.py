"""String, number, date, conditional, array and JSON functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtable.catalog import query, table
from loomtable.functions import cleaning as c
from loomtable.functions.times import day_number, days_between, epoch_seconds, month_key, month_start
from loomtable.plans import people
from loomtable.schemas import CUSTOMER_JSON, INT, columns


@query(r"""
SELECT p_partkey, trim('  ' || p_name || ' ') AS trimmed, upper(p_name) AS uppered,
       lower(p_brand) AS lowered,
       upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS capitalized,
       CAST(length(p_name) AS INTEGER) AS len, substr(p_name, 2, 3) AS part3,
       concat_ws('-', p_brand, p_type) AS joined, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded,
       CAST(instr(p_name, ' ') AS INTEGER) AS blank_at,
       regexp_replace(p_name, '[aeiou]', '*', 'g') AS masked,
       regexp_matches(p_name, '^[a-m]') AS early, starts_with(p_name, 'red') AS is_red,
       string_split(p_name, ' ')[1] AS first_word, string_split(p_name, ' ')[3] AS third_word,
       regexp_extract(p_brand, '#(\d+)', 1) AS brand_number
FROM part
""")
def string_functions(spark, sf):
    name = F.col("p_name")
    return table(spark, sf, "part").select(
        "p_partkey",
        F.trim(F.concat(F.lit("  "), name, F.lit(" "))).alias("trimmed"),
        F.upper(name).alias("uppered"), F.lower("p_brand").alias("lowered"),
        F.initcap(F.lower("p_type")).alias("capitalized"),
        F.length(name).alias("len"), F.substring(name, 2, 3).alias("part3"),
        F.concat_ws("-", "p_brand", "p_type").alias("joined"),
        F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"),
        F.instr(name, " ").alias("blank_at"),
        F.regexp_replace(name, "[aeiou]", "*").alias("masked"),
        name.rlike("^[a-m]").alias("early"), name.startswith("red").alias("is_red"),
        F.get(F.split(name, " "), F.lit(0)).alias("first_word"),
        F.get(F.split(name, " "), F.lit(2)).alias("third_word"),
        F.regexp_extract("p_brand", r"#(\d+)", 1).alias("brand_number"),
    )


@query("""
SELECT l_orderkey, l_linenumber, l_quantity + l_linenumber AS plus, l_quantity - l_linenumber AS minus,
       l_quantity * l_linenumber AS times, l_quantity / l_linenumber AS divided,
       CAST(l_linenumber % 3 AS INTEGER) AS modulo, round(sqrt(l_quantity), 6) AS root,
       CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)), 1) AS DOUBLE) AS rounded,
       abs(l_quantity - 25) AS distance,
       l_quantity / nullif(l_linenumber - 1, 0) AS guarded
FROM lineitem
""")
def math_functions(spark, sf):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (q + n).alias("plus"), (q - n).alias("minus"),
        (q * n).alias("times"), (q / n).alias("divided"), (n % 3).alias("modulo"),
        F.round(F.sqrt(q), 6).alias("root"),
        F.round(F.col("l_extendedprice").cast("decimal(12,2)"), 1).cast("double").alias("rounded"),
        F.abs(q - 25).alias("distance"), F.try_divide(q, n - 1).alias("guarded"),
    )


@query("""
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS size,
       coalesce(CASE WHEN l_tax > 0.04 THEN l_returnflag END, 'none') AS flag_or_none,
       coalesce(CASE WHEN l_linenumber > 3 THEN l_discount END, 0.0) AS discount_or_zero,
       TRY_CAST(CASE WHEN l_returnflag = 'R' THEN 'XYZ' ELSE CAST(l_linenumber AS VARCHAR) END AS INTEGER) AS as_int,
       l_linestatus = 'O' AS is_open
FROM lineitem
""")
def conditional_functions(spark, sf):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    text = F.when(F.col("l_returnflag") == "R", "XYZ").otherwise(n.cast("string"))
    filled = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(q < 10, "small").when(q < 30, "medium").otherwise("large").alias("size"),
        F.coalesce(F.when(F.col("l_tax") > 0.04, F.col("l_returnflag")), F.lit("none")).alias("flag_or_none"),
        F.when(n > 3, F.col("l_discount")).alias("discount_or_zero"),
        text.try_cast("int").alias("as_int"), (F.col("l_linestatus") == "O").alias("is_open"),
    )
    return filled.fillna({"discount_or_zero": 0.0})


@query("""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed_date,
       CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) AS seconds,
       CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS day_no,
       CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS since_1995,
       strftime(o_orderdate, '%Y-%m') AS month_key, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start,
       o_orderdate + INTERVAL 90 SECOND AS shifted
FROM orders
""")
def date_functions(spark, sf):
    date = F.col("o_orderdate")
    layout = F.pmod("o_orderkey", F.lit(3))
    text = (
        F.when(layout == 0, F.date_format(date, "yyyy-MM-dd"))
        .when(layout == 1, F.date_format(date, "yyyy/MM/dd"))
        .otherwise(F.date_format(date, "MM-dd-yyyy"))
    )
    parsed = c.parse_date(F.col("text"), c.ORDER_DATES)
    stamp = F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit(" 00:01:30"))
    start = F.to_date(F.lit("1995-01-01"))
    return table(spark, sf, "orders").withColumn("text", text).select(
        "o_orderkey", parsed.alias("parsed_date"), epoch_seconds(date).alias("seconds"),
        day_number(date).alias("day_no"), days_between(start, F.to_date(date)).alias("since_1995"),
        month_key(date).alias("month_key"), month_start(date).alias("month_start"),
        F.to_timestamp(stamp).cast("timestamp_ntz").alias("shifted"),
    )


@query("""
SELECT 'documents' AS origin, doc_id AS id, i - 1 AS position, nullif(w[i], '') AS line FROM (
  SELECT doc_id, string_split(text, chr(10)) AS w FROM documents), unnest(range(1, len(w) + 1)) AS r(i)
UNION ALL
SELECT 'events', event_id, NULL, NULL FROM events WHERE event_type = 'error'
""")
def explode_outer_pos(spark, sf):
    """Lines of every document by position; rows without an array survive as nulls."""
    docs = table(spark, sf, "documents").select(
        F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), F.split("text", "\n").alias("lines"))
    empty = table(spark, sf, "events").filter(F.col("event_type") == "error").select(
        F.lit("events").alias("origin"), F.col("event_id").alias("id"), F.array().cast("array<string>").alias("lines")
    )
    exploded = docs.unionAll(empty).select("origin", "id", F.posexplode_outer("lines").alias("position", "line"))
    return exploded.select(
        "origin", "id", F.col("position").cast("bigint").alias("position"),
        F.nullif("line", F.lit("")).alias("line"),
    )


@query("""
SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part
""")
def explode_words(spark, sf):
    words = F.split("p_name", " ")
    return table(spark, sf, "part").select("p_partkey", F.explode(words).alias("word"))


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events
""")
def json_extract(spark, sf):
    parsed = F.from_json("props", columns(k=INT))
    return table(spark, sf, "events").select("event_id", parsed["k"].alias("k"))


@query("""
SELECT c_custkey AS customer_id,
       CASE WHEN c_custkey % 5 <> 0 THEN n_name END AS customer_city
FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def json_nested(spark, sf):
    nation = F.broadcast(table(spark, sf, "nation"))  # 25 rows
    rows = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    city = F.when(F.col("c_custkey") % 5 != 0, F.col("n_name"))
    inner = F.struct(F.col("c_custkey").alias("id"), city.alias("city"))
    text = rows.select(F.to_json(F.struct(inner.alias("customer"))).alias("json_text"))
    parsed = text.select(F.from_json("json_text", CUSTOMER_JSON).alias("parsed"))
    return parsed.select(
        F.col("parsed.customer.id").alias("customer_id"),
        F.col("parsed.customer.city").alias("customer_city"),
    )


@query("""
SELECT c_custkey, c_acctbal AS salary, c_acctbal * 1.1::DOUBLE AS salary_after_promotion
FROM customer WHERE c_acctbal > 30
""")
def salary_raise(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("salary"))
    return people.raise_salary(customer.filter(F.col("salary") > 30), "c_custkey")


@query("""
SELECT c_custkey, CAST(c_nationkey + 10 AS BIGINT) AS in_ten FROM customer
""")
def column_transform(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", (F.col("c_nationkey") + 10).cast("bigint").alias("in_ten")
    )
