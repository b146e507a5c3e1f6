"""Ids beyond 32 bits, products beyond four digits and sessions beyond three digits stay what they are."""

import pytest
from pyspark.sql import functions as F

from loomtable import schemas, session
from loomtable.functions.cleaning import strict_long
from loomtable.operators.windows import sessionize
from loomtable.plans import etl, heroes, movies, retail, spend
from loomtable.schemas import RAW_ORDERS, RAW_PRODUCTS
from loomtable.sources import read_delimited

A, B = 3_000_000_000, 3_000_000_001


def raw(spark, schema, key, ids):
    df = spark.createDataFrame([(i,) for i in ids], f"{key} string")
    return df.select(*[F.col(key) if n == key else F.lit(None).cast("string").alias(n) for n in schema.fieldNames()])


def test_large_order_ids(spark, rows):
    orders = retail.clean_orders(raw(spark, RAW_ORDERS, "order_id", ["5", "3000000000", "3000000001", "12.7"]))
    assert rows(orders, "order_id") == sorted([(5,), (3000000000,), (3000000001,), (12,)], key=lambda r: (True, str(r[0])))


def test_product_id_pattern_is_a_parameter(spark, rows):
    products = raw(spark, RAW_PRODUCTS, "product_id", ["p1234", "P12345", "P12"])
    assert rows(retail.clean_products(products), "product_id") == [("P1234",)]
    assert rows(retail.clean_products(products, r"^P\d{4,}$"), "product_id") == [("P1234",), ("P12345",)]


def test_many_sessions_of_one_user(spark):
    events = spark.range(1200).select(
        F.lit("u").alias("user"), F.timestamp_seconds(F.col("id") * 7200 + 1_700_000_000).alias("ts"))
    ids = sessionize(events, "user", "ts").select("session_id")
    assert ids.distinct().count() == 1200 and ids.filter("session_id = 'u_1200'").count() == 1


def test_large_movie_ids(spark, rows, tmp_path):
    ratings = [(A + 7, A, 4.0), (A + 7, B, 3.0), (A + 8, A, 5.0), (A + 8, B, 1.0), (1, A, 2.0)]
    (tmp_path / "r").write_text("".join(f"{u}\t{m}\t{r}\t99\n" for u, m, r in ratings))
    (tmp_path / "t").write_bytes(f"{A}|Amélie|x\n{B}|Up|y\nno number|z|w\n".encode("ISO-8859-1"))
    rated, titles = movies.read_ratings(spark, str(tmp_path / "r")), movies.read_titles(spark, str(tmp_path / "t"))
    counted = movies.most_rated(rated, titles)
    assert rows(counted, "movie_id", "movie_name", "rating_count") == [(A, "Amélie", 3), (B, "Up", 2)]
    assert rows(movies.similar_titles(rated, titles, A, 2, 0.0), "movie_name", "num_pairs") == [("Up", 2)]


def test_ids_beyond_64_bits_are_an_error(spark, rows, tmp_path):
    texts = spark.createDataFrame([(t,) for t in ("9223372036854775807", " 5 ", "x", "1.5", "", None)], "t string")
    assert rows(texts.select(strict_long(F.col("t")))) == [(None,)] * 4 + [(5,), (2**63 - 1,)]
    (tmp_path / "r").write_text("1\t9223372036854775808\t3.0\t99\n")
    (tmp_path / "t").write_text("9223372036854775808|name\n")
    for read in (movies.read_ratings(spark, str(tmp_path / "r")), movies.read_titles(spark, str(tmp_path / "t"))):
        with pytest.raises(Exception, match="id beyond 64 bits"):
            read.collect()
    line = spark.createDataFrame([("9223372036854775808 1 2",)], "value string")
    with pytest.raises(Exception, match="id beyond 64 bits"):
        heroes.connections(line).collect()


def test_large_hero_ids(spark, rows):
    lines = spark.createDataFrame([(f"{A} 1 2 3",), (f"{B} 1",), (f"{A} 4",)], "value string")
    names = spark.createDataFrame([(A, "ANA"), (B, "BO")], schemas.HERO_NAMES)
    counts = heroes.connections(lines)
    assert rows(heroes.most_connected(counts, names)) == [("ANA", 4)]
    assert rows(heroes.least_connected(counts, names)) == [("BO", 1)]


def test_large_ids_in_json_and_labelled_orders(spark, rows):
    text = spark.createDataFrame([(f'{{"customer": {{"id": {A}, "city": "Bonn"}}}}',)], "t string")
    assert rows(text.select(F.from_json("t", schemas.CUSTOMER_JSON)["customer"]["id"])) == [(A,)]
    orders = spark.createDataFrame([(A, B, "2025-01-02", 5.0), (B, B, "2025-01-02", 6.0)], schemas.ETL_ORDERS)
    customers = spark.createDataFrame([(B, "Oslo", "port"), (A, "Bonn", None)], schemas.ETL_CUSTOMERS)
    joined = etl.with_labels(etl.usable_orders(orders), etl.usable_customers(customers))
    assert rows(joined, "order_id", "customer_id", "city") == [(A, B, "Oslo"), (B, B, "Oslo")]


@pytest.mark.parametrize("schema, ids", [
    ("PEOPLE", ["id"]), ("CSV_PEOPLE", ["id"]), ("FRIENDS", ["id"]), ("HERO_NAMES", ["id"]),
    ("CUSTOMER_ORDERS", ["customer_id", "order_id"]), ("RATINGS", ["user_id", "movie_id"]),
    ("ETL_ORDERS", ["order_id", "customer_id"]), ("ETL_CUSTOMERS", ["customer_id"]),
])
def test_large_ids_in_files(spark, rows, tmp_path, schema, ids):
    kinds = getattr(schemas, schema)
    line = ",".join(str(A) if f.name in ids else "1" for f in kinds)
    (tmp_path / "x.csv").write_text(line + "\n")
    assert rows(read_delimited(spark, str(tmp_path / "x.csv"), kinds), *ids) == [(A,) * len(ids)]


def test_large_customer_ids_in_spend(spark, rows):
    orders = spark.createDataFrame([(A, 1, 10.0), (A, 2, 5.0), (B, 3, 7.0)], schemas.CUSTOMER_ORDERS)
    for spent in (spend.spend_per_customer(orders), spend.spend_per_customer_sql(orders)):
        assert rows(spent) == [(A, 15.0), (B, 7.0)]


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Cluster:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError):
        session.shared_root(Cluster)
