"""Sources and sinks: write test tables in a format, read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtable import sinks
from loomtable.catalog import money, plain, query, table
from loomtable.catalog.retail import ALL_SQL, PRODUCT_IDS, doubles, raw_tables
from loomtable.plans import etl, movies, retail, spend
from loomtable.schemas import INT, LONG, REAL, SALES_FILE, TEXT, columns
from loomtable.session import scratch_path
from loomtable.sources import (
    parse_lines,
    read_delimited,
    read_exported,
    read_inferred,
    read_lines,
    read_quarantined,
    read_raw,
)
from loomtable.streaming import events as stream

PEOPLE_FILE = columns(c_custkey=LONG, c_name=TEXT, c_nationkey=INT, c_acctbal=REAL)


def customer_columns(spark, sf):
    return table(spark, sf, "customer").select(*PEOPLE_FILE.fieldNames())


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "csv")
    sinks.export_csv(customer_columns(spark, sf), path)
    return read_delimited(spark, f"{path}/*.csv", PEOPLE_FILE, header=True)


@query("SELECT c_custkey AS id, c_name AS name FROM customer")
def csv_columns(spark, sf):
    path = scratch_path(spark, "csv")
    sinks.export_csv(customer_columns(spark, sf), path)
    raw = read_raw(spark, path, PEOPLE_FILE)
    return raw.select(F.col("c_custkey").cast("bigint").alias("id"), F.col("c_name").alias("name"))


@query("SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS balance FROM customer")
def csv_inferred(spark, sf):
    path = scratch_path(spark, "csv")
    sinks.export_csv(customer_columns(spark, sf), path)
    inferred = read_inferred(spark, path, ["id", "name", "nation", "balance"])
    return inferred.withColumn("id", F.col("id").cast("bigint"))


def quarantine_lines(spark, sf):
    """Folder of customer lines in CSV; some have a bad number, some a field too many. One file has the header."""
    key = F.col("c_custkey")
    balance = F.when(key % 7 == 0, "not_a_number").otherwise(F.col("c_acctbal").cast("string"))
    line = F.concat_ws(",", key.cast("string"), "c_name", F.col("c_nationkey").cast("string"), balance)
    extra = F.when(key % 10 == 0, ",unexpected").otherwise("")
    path = scratch_path(spark, "quarantine")
    header = ",".join(PEOPLE_FILE.fieldNames())
    lines = table(spark, sf, "customer").select(F.concat(line, extra).alias("value"))
    head = spark.range(1).select(F.lit(header).alias("value"))
    sinks.write_text(head.unionAll(lines), path)
    return path


@query("""
SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer
WHERE c_custkey % 7 <> 0 AND c_custkey % 10 <> 0
""")
def csv_usable(spark, sf):
    usable, _ = read_quarantined(spark, quarantine_lines(spark, sf), PEOPLE_FILE)
    return usable.drop("source_filename")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal FROM customer
WHERE c_custkey % 7 = 0 OR c_custkey % 10 = 0
""")
def csv_malformed(spark, sf):
    _, malformed = read_quarantined(spark, quarantine_lines(spark, sf), PEOPLE_FILE)
    return malformed.filter(F.col("source_filename").endswith(".txt")).select("c_custkey", "c_acctbal")


@query("""
SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer
WHERE c_custkey % 7 <> 0 AND c_custkey % 10 <> 0
""")
def csv_drop_malformed(spark, sf):
    """Lines that do not fit are dropped by the reader, the header among them."""
    return read_delimited(spark, quarantine_lines(spark, sf), PEOPLE_FILE, mode="DROPMALFORMED")


@query("SELECT c_custkey, c_acctbal FROM customer")
def csv_fail_fast(spark, sf):
    """A clean export read in the mode that ends at the first malformed line."""
    path = scratch_path(spark, "csv")
    sinks.export_csv(customer_columns(spark, sf), path)
    rows = read_delimited(spark, path, PEOPLE_FILE, header=True, mode="FAILFAST")
    return rows.select("c_custkey", "c_acctbal")


@query("""
SELECT c_custkey, 'é "' || c_name || '",' || chr(10) || '2' AS c_name,
       CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal, c_custkey % 7 = 0 AS malformed
FROM customer
""")
def csv_records(spark, sf):
    """ISO-8859-1 records with quotes and line breaks inside fields; some have a bad number. Both parts of the split."""
    key = F.col("c_custkey")
    balance = F.when(key % 7 == 0, "not_a_number").otherwise(F.col("c_acctbal").cast("string"))
    name = F.concat(F.lit('é "'), "c_name", F.lit('",\n2'))
    path = scratch_path(spark, "records")
    table(spark, sf, "customer").select(key, name.alias("c_name"), "c_nationkey", balance.alias("c_acctbal")).write.csv(
        path, header=True, encoding="ISO-8859-1", escape='"')
    usable, malformed = read_quarantined(spark, path, PEOPLE_FILE, encoding="ISO-8859-1", multi_line=True)
    kept = ["c_custkey", "c_name", "c_acctbal"]
    return usable.select(*kept, F.lit(False).alias("malformed")).unionByName(
        malformed.select(*kept, F.lit(True).alias("malformed")))


@query("""
SELECT c_mktsegment, c_custkey, c_acctbal FROM customer
""")
def partitioned_roundtrip(spark, sf):
    path = scratch_path(spark, "parted")
    customer = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    sinks.write_parquet(customer, path, ["c_mktsegment"])
    return spark.read.parquet(path)


@query("""
SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS date,
       o_totalprice AS amount, coalesce(n_name, 'Unknown') AS city, coalesce(c_mktsegment, 'Unknown') AS segment
FROM orders LEFT JOIN (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0)
  ON o_custkey = c_custkey
""")
def etl_by_city(spark, sf):
    """Enriched orders written one folder per city and read back."""
    nation = F.broadcast(table(spark, sf, "nation"))  # 25 rows
    customers = table(spark, sf, "customer").filter(F.col("c_acctbal") > 0).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    ).selectExpr("c_custkey AS customer_id", "n_name AS city", "c_mktsegment AS segment")
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_totalprice").alias("amount"),
    )
    path = scratch_path(spark, "by-city")
    etl.write_by(etl.with_labels(etl.usable_orders(orders), customers), path, "city")
    return spark.read.parquet(path)


@query("""
SELECT l_partkey || ',' || l_returnflag || ',' ||
       CAST(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_quantity AS INTEGER) AS DECIMAL(18,2)) AS VARCHAR) AS value
FROM lineitem
""")
def line_revenue_text(spark, sf):
    """Sales lines written as delimited text, parsed back, and turned into revenue lines."""
    path = scratch_path(spark, "sales")
    sales = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("product_id"), F.col("l_returnflag").alias("name"),
        F.col("l_linestatus").alias("category"), F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").cast("int").alias("quantity"),
    )
    sinks.write_text(sales, path, spend.sales_line(SALES_FILE.fieldNames()))
    rows = parse_lines(read_lines(spark, f"{path}/*.txt"), SALES_FILE)
    exact = rows.withColumn("price", money("price"))
    return exact.select(spend.revenue_line("price", "quantity", ["product_id", "name"]).alias("value"))


@query(r"""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '  ' || text || '  ' WHEN 1 THEN '"a", \b' || chr(13) || chr(10) || text
                               WHEN 2 THEN '' END AS text, lang
FROM documents
""")
def csv_lossless(spark, sf):
    """Texts with line breaks, quotes, commas, backslashes and outer blanks, empty and missing ones, out and back."""
    kind = F.col("doc_id") % 4
    docs = table(spark, sf, "documents").select(
        "doc_id", F.when(kind == 0, F.concat(F.lit("  "), "text", F.lit("  ")))
        .when(kind == 1, F.concat(F.lit('"a", \\b\r\n'), "text")).when(kind == 2, F.lit("")).alias("text"), "lang")
    path = scratch_path(spark, "lossless")
    sinks.export_csv(docs, path)
    return read_exported(spark, path, docs.schema)


@query("SELECT event_type || ' ' || count(*) AS value FROM events GROUP BY event_type")
def text_single_file(spark, sf):
    path = scratch_path(spark, "one")
    counts = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    line = F.concat_ws(" ", "event_type", "n")
    sinks.write_text(sinks.one_file(counts), path, line)
    return read_lines(spark, path)


@query("""
SELECT l_partkey AS movie_id,
       coalesce(any_value('é ' || p_name), 'unknown') AS movie_name, count(*) AS rating_count
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 30) p ON l_partkey = p_partkey GROUP BY l_partkey
""")
def most_rated_titles(spark, sf):
    """Tab-separated ratings and pipe-separated ISO-8859-1 titles."""
    ratings_path, titles_path = scratch_path(spark, "ratings"), scratch_path(spark, "titles")
    ratings = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", F.lit(0)
    )
    ratings.write.csv(ratings_path, sep="\t")
    titles = table(spark, sf, "part").filter(F.col("p_size") < 30).select(
        "p_partkey", F.concat(F.lit("é "), "p_name"), "p_brand"
    )
    titles.write.csv(titles_path, sep="|", encoding="ISO-8859-1")
    return movies.most_rated(
        movies.read_ratings(spark, ratings_path), movies.read_titles(spark, titles_path)
    )


@query(f"""
{ALL_SQL}
SELECT * {doubles('unit_price', 'discount_pct', 'source_total_amount', 'calculated_total_amount',
                  'amount_difference')} FROM cf
""")
def table_reload(spark, sf):
    """Curate, store, export to CSV, and reload the exported facts into a typed table."""
    raw = raw_tables(spark, sf)
    base = scratch_path(spark, "tables")
    run_id = base.rsplit("-", 1)[1]
    curated, warehouse = f"loom_curated_{run_id}", f"loom_warehouse_{run_id}"
    sinks.create_database(spark, curated, f"{base}/curated")
    sinks.create_database(spark, warehouse, f"{base}/warehouse")
    retail.run(raw, curated, f"{base}/export", product_ids=PRODUCT_IDS)
    tables = retail.load_exports(spark, f"{base}/export", warehouse)
    return plain(spark.table(tables["fact_orders"]))


@query("SELECT event_type, count(*) AS events FROM events GROUP BY event_type")
def event_stream_counts(spark, sf):
    schema = table(spark, sf, "events").schema
    out = scratch_path(spark, "counts")
    stream.run_counts(stream.read_event_stream(spark, f"{sf}/events.parque[t]", schema), ["event_type"], out)
    return stream.latest_counts(spark, out)


@query("""
SELECT CASE WHEN event_type = 'purchase' THEN 'order' ELSE 'navigation' END AS channel,
       count(*) AS events, count(DISTINCT user_id) AS users
FROM events GROUP BY 1
""")
def event_stream_channels(spark, sf):
    schema = table(spark, sf, "events").schema
    out = scratch_path(spark, "channels")
    events = stream.read_event_stream(spark, f"{sf}/events.parque[t]", schema)
    routed = events.withColumn("channel", stream.channel(F.col("event_type"), ["purchase"]))
    stream.run_routing(routed, out)
    return spark.read.parquet(f"{out}/routed").groupBy("channel").agg(
        F.count("*").alias("events"), F.count_distinct("user_id").alias("users")
    )
