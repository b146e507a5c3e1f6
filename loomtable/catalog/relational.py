"""Projections, joins, sets and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtable.catalog import money, plain, query, table
from loomtable.functions.text import tokens
from loomtable.operators import joins, sets
from loomtable.operators.quality import orphans
from loomtable.operators.similarity import item_similarity, similar_items
from loomtable.plans import heroes, spend

URGENT = "o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'"
URGENT_SQL = f"(SELECT * FROM orders WHERE {URGENT})"


def urgent_orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").filter(
        (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")
    )


@query("""
SELECT c_name AS customer, upper(c_mktsegment) AS segment, CAST(c_nationkey AS BIGINT) AS nation,
       c_acctbal * 2 AS double_balance, n_name
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 1
WHERE (c_acctbal BETWEEN 100 AND 9000 AND c_mktsegment IN ('BUILDING', 'MACHINERY'))
   OR (n_name IS NOT NULL AND c_acctbal <> 0 AND regexp_matches(c_name, '#0+[1-9]'))
""")
def projection_filter(spark, sf):
    customer = table(spark, sf, "customer").drop("c_custkey")
    nation = table(spark, sf, "nation").filter(F.col("n_regionkey") == 1)
    joined = joins.left_on(customer, nation, "c_nationkey", "n_nationkey")
    kept = joined.filter(
        (F.col("c_acctbal").between(100, 9000) & F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
        | (F.col("n_name").isNotNull() & (F.col("c_acctbal") != 0) & F.col("c_name").rlike("#0+[1-9]"))
    )
    return kept.selectExpr(
        "c_name AS customer", "upper(c_mktsegment) AS segment",
        "CAST(c_nationkey AS BIGINT) AS nation", "c_acctbal * 2 AS double_balance", "n_name",
    )


@query("""
SELECT p_partkey, p_size AS value, p_size * p_size AS squared, 'num_' || p_size AS prefixed,
       length(p_name) AS name_length, upper(p_name) AS upper_name
FROM part WHERE p_size % 2 = 0 AND p_size > 5
""")
def numbers_chain(spark, sf):
    value = F.col("value")
    return (
        table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("value"), "p_name")
        .filter((value % 2 == 0) & (value > 5))
        .select(
            "p_partkey", "value", (value * value).alias("squared"),
            F.concat(F.lit("num_"), value.cast("string")).alias("prefixed"),
            F.length("p_name").cast("bigint").alias("name_length"),
            F.upper("p_name").alias("upper_name"),
        )
    )


@query("""
SELECT c_custkey, c_name, o_custkey, o_orderkey, o_totalprice
FROM customer JOIN orders o ON c_custkey = o_custkey
""")
def inner_join(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey", "c_name")
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return joins.inner_on(customer, orders, "c_custkey", "o_custkey")


@query(f"""
SELECT c_custkey, c_name, o_orderkey, o_totalprice
FROM customer LEFT JOIN {URGENT_SQL} o ON c_custkey = o_custkey
""")
def left_join(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey", "c_name")
    orders = urgent_orders(spark, sf).select("o_custkey", "o_orderkey", "o_totalprice")
    return joins.left_on(customer, orders, "c_custkey", "o_custkey").drop("o_custkey")


@query(f"""
SELECT c_custkey, c_name,
       CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(12,2))), 0) AS DOUBLE) AS total_spend
FROM customer LEFT JOIN {URGENT_SQL} o ON c_custkey = o_custkey
GROUP BY c_custkey, c_name
""")
def left_join_zero_spend(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey", "c_name")
    orders = urgent_orders(spark, sf).select("o_custkey", money("o_totalprice").alias("amount"))
    return plain(joins.total_per_left_row(
        customer, orders, "c_custkey", "o_custkey", "amount", "total_spend"
    ))


@query(f"""
SELECT c_custkey, c_name FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM {URGENT_SQL} o)
""")
def customers_without_orders(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey", "c_name")
    return joins.anti_join(customer, urgent_orders(spark, sf), "c_custkey", "o_custkey")


@query(f"""
SELECT c_custkey AS customer_id, c_name AS name
FROM customer LEFT JOIN {URGENT_SQL} o ON c_custkey = o_custkey
WHERE o_custkey IS NULL
""")
def customers_without_orders_sql(spark, sf):
    customer = table(spark, sf, "customer").selectExpr("c_custkey AS customer_id", "c_name AS name")
    orders = urgent_orders(spark, sf).selectExpr("o_custkey AS customer_id")
    return spend.customers_without_orders_sql(customer, orders)


@query("""
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 20)
""")
def orders_with_valid_keys(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    part = table(spark, sf, "part").filter(F.col("p_size") < 20).select("p_partkey")
    return joins.semi_join(lines, part, "l_partkey", "p_partkey")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey AS part_id FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 20)
""")
def orphan_lines(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("part_id")
    )
    part = table(spark, sf, "part").filter(F.col("p_size") < 20)
    return orphans(lines, part.select(F.col("p_partkey").alias("part_id")), "part_id")


@query("""
SELECT l_partkey AS part_id, count(*) AS line_count, coalesce(any_value(p_name), 'unknown') AS p_name
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 20) p ON l_partkey = p_partkey
GROUP BY l_partkey
""")
def broadcast_lookup_default(spark, sf):
    counts = (
        table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("part_id"))
        .agg(F.count("*").alias("line_count"))
    )
    names = table(spark, sf, "part").filter(F.col("p_size") < 20)
    return joins.lookup_with_default(
        counts, names.withColumnRenamed("p_partkey", "part_id"), "part_id", "p_name", "unknown"
    )


@query("""
SELECT o_orderpriority, count(*) AS orders
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus = 'F' AND c_acctbal > 0
GROUP BY o_orderpriority
""")
def filtered_join_count(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "custkey")
    solvent = table(spark, sf, "customer").filter(F.col("c_acctbal") > 0)
    return joins.filtered_join_count(
        orders, solvent.select(F.col("c_custkey").alias("custkey")), "custkey",
        F.col("o_orderstatus") == "F", "o_orderpriority", "orders",
    )


RATINGS_SQL = """
r AS (SELECT l_orderkey AS u, l_partkey AS i, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
"""


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as users, parts as items, the largest quantity as rating."""
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(
        F.max("l_quantity").alias("rating")
    )


@query(f"""
WITH {RATINGS_SQL}
SELECT a.i AS item1, b.i AS item2,
       round(sum(a.q * b.q) / (sqrt(sum(a.q * a.q)) * sqrt(sum(b.q * b.q))), 6) AS score,
       count(*) AS num_pairs
FROM r a JOIN r b ON a.u = b.u AND a.i < b.i
GROUP BY a.i, b.i HAVING count(*) >= 2
""")
def item_pairs_cosine(spark, sf):
    pairs = item_similarity(ratings(spark, sf), "l_orderkey", "l_partkey", "rating", min_pairs=2)
    return pairs.withColumn("score", F.round("score", 6))


@query(f"""
WITH {RATINGS_SQL},
p AS (
  SELECT a.i AS item1, b.i AS item2, count(*) AS num_pairs,
         round(sum(a.q * b.q) / (sqrt(sum(a.q * a.q)) * sqrt(sum(b.q * b.q))), 6) AS score
  FROM r a JOIN r b ON a.u = b.u AND a.i < b.i
  WHERE a.i = 42 OR b.i = 42
  GROUP BY a.i, b.i
)
SELECT p_name, CASE WHEN item1 = 42 THEN item2 ELSE item1 END AS similar_item, score, num_pairs
FROM p JOIN part ON p_partkey = CASE WHEN item1 = 42 THEN item2 ELSE item1 END
WHERE score > 0.5
ORDER BY score DESC, num_pairs DESC, similar_item LIMIT 10
""")
def similar_items_for_one(spark, sf):
    found = similar_items(ratings(spark, sf), "l_orderkey", "l_partkey", "rating", 42, min_score=0.5)
    best = (
        found.withColumn("score", F.round("score", 6))
        .orderBy(F.desc("score"), F.desc("num_pairs"), "similar_item").limit(10)
    )
    part = table(spark, sf, "part")
    return best.join(part, best.similar_item == part.p_partkey).select(
        "p_name", "similar_item", "score", "num_pairs"
    )


@query(f"""
WITH {RATINGS_SQL}
SELECT CASE WHEN a.i = 42 THEN b.i ELSE a.i END AS other_item, count(*) AS num_pairs
FROM r a JOIN r b ON a.u = b.u AND a.i < b.i
WHERE (a.i = 42 OR b.i = 42)
GROUP BY 1
""")
def other_side_of_pairs(spark, sf):
    one = F.lit(42)
    found = similar_items(ratings(spark, sf), "l_orderkey", "l_partkey", "rating", 42)
    pairs = found.select(F.least("similar_item", one).alias("item1"), F.greatest("similar_item", one).alias("item2"),
                         "num_pairs")
    return pairs.select(joins.other_side("item1", "item2", one).alias("other_item"), "num_pairs")


def adjacency_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Text lines ``part order order ...``: one order per line number, blanks at the end."""
    met = F.array_repeat(F.col("l_orderkey").cast("string"), F.col("l_linenumber"))
    return table(spark, sf, "lineitem").select(
        F.concat(F.concat_ws(" ", F.col("l_partkey").cast("string"), met), F.lit(" ")).alias("value")
    )


def hero_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").cast("bigint").alias("id"), F.concat_ws(" ", "p_name", "p_partkey").alias("name")
    )


HERO_SQL = """
c AS (SELECT l_partkey AS id, CAST(sum(l_linenumber) AS BIGINT) AS connections FROM lineitem GROUP BY 1)
"""


@query(f"""
WITH {HERO_SQL}
SELECT p_name || ' ' || p_partkey AS name, connections
FROM (SELECT * FROM c ORDER BY connections DESC, id LIMIT 1) t JOIN part ON id = p_partkey
""")
def hero_most_connected(spark, sf):
    counts = heroes.connections(adjacency_lines(spark, sf))
    return heroes.most_connected(counts, hero_names(spark, sf))


@query(f"""
WITH {HERO_SQL}
SELECT p_name || ' ' || p_partkey AS name, connections
FROM c JOIN part ON id = p_partkey WHERE connections = (SELECT min(connections) FROM c)
""")
def hero_least_connected(spark, sf):
    counts = heroes.connections(adjacency_lines(spark, sf))
    return heroes.least_connected(counts, hero_names(spark, sf))


RETURNED = "SELECT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_returnflag = 'R'"
ACCEPTED = "SELECT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_returnflag = 'A'"


def lines_with_flag(spark: SparkSession, sf: str, flag: str) -> DataFrame:
    return table(spark, sf, "lineitem").filter(F.col("l_returnflag") == flag).select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")
    )


@query(f"{RETURNED} UNION ALL {ACCEPTED}")
def union_all(spark, sf):
    return sets.union_all(lines_with_flag(spark, sf, "R"), lines_with_flag(spark, sf, "A"))


@query(f"{RETURNED} INTERSECT {ACCEPTED}")
def intersect_keys(spark, sf):
    return sets.intersect(lines_with_flag(spark, sf, "R"), lines_with_flag(spark, sf, "A"))


@query(f"""
SELECT k, n FROM ({RETURNED}) r
WHERE NOT EXISTS (SELECT 1 FROM ({ACCEPTED}) a WHERE a.k = r.k AND a.n = r.n)
""")
def subtract_keys(spark, sf):
    return sets.subtract(lines_with_flag(spark, sf, "R"), lines_with_flag(spark, sf, "A"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20")
def take_ordered(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy("o_totalprice", "o_orderkey").limit(20)


@query("SELECT c_mktsegment, c_acctbal, c_custkey FROM customer ORDER BY 1, 2 DESC, 3")
def global_sort(spark, sf):
    customer = table(spark, sf, "customer").select("c_mktsegment", "c_acctbal", "c_custkey")
    return customer.orderBy(F.asc("c_mktsegment"), F.desc("c_acctbal"), F.asc("c_custkey"))


@query("""
SELECT word, count(*) AS n FROM (
  SELECT unnest(string_split(p_name, ' ')) AS word FROM part) WHERE word <> '' GROUP BY word
""")
def name_tokens(spark, sf):
    part = table(spark, sf, "part")
    return part.select(F.explode(tokens(F.col("p_name"))).alias("word")).groupBy("word").agg(
        F.count("*").alias("n")
    )
