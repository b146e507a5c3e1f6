"""Sources, sinks, the retail run end to end, and the stream jobs."""

import glob

import pytest
from pyspark.sql import functions as F

from loomtable import schemas, sinks
from loomtable.plans import retail, reports
from loomtable.sources import (drop_header, parse_lines, read_delimited, read_exported, read_inferred, read_lines,
                               read_quarantined)
from loomtable.streaming import events as stream


@pytest.fixture
def csv_folder(tmp_path):
    (tmp_path / "part_1.csv").write_text("id,name,age\n7,Ines,61\n8,Tomás,19\n")
    (tmp_path / "part_2.csv").write_text("id,name,age\n9,Wu,44\n10,Olu,4o\n11,Pia,52,x,y\n")
    return tmp_path


def test_quarantine(spark, rows, csv_folder):
    usable, bad = read_quarantined(spark, f"{csv_folder}/*.csv", schemas.CSV_PEOPLE)
    assert rows(usable, "id", "age") == [(7, 61), (8, 19), (9, 44)]
    assert rows(bad, "id", "age") == [(10, None), (11, 52)]
    # The split holds for any column selection and for plain counts.
    assert (usable.count(), bad.count()) == (3, 2)
    assert rows(bad, "id") == [(10,), (11,)]
    assert rows(bad, "_corrupt_record") == [("10,Olu,4o",), ("11,Pia,52,x,y",)]
    assert rows(usable.select("source_filename").distinct()) == [("part_1.csv",), ("part_2.csv",)]


def test_quarantine_of_records_over_several_lines(spark, rows, tmp_path):
    body = 'id,name,age\n7,"Inés\nMaría ""I""",61\n8,"a, b",x\n"id","name","age"\n9,one,2,3\n10,"é",5\n11,short\n'
    (tmp_path / "latin.csv").write_bytes(body.encode("ISO-8859-1"))
    usable, bad = read_quarantined(
        spark, str(tmp_path / "latin.csv"), schemas.CSV_PEOPLE, encoding="ISO-8859-1", multi_line=True)
    assert rows(usable, "id", "name", "age") == [(10, "é", 5), (7, 'Inés\nMaría "I"', 61)]
    assert rows(bad, "id", "name", "age") == [(11, "short", None), (8, "a, b", None), (9, "one", 2)]
    assert rows(bad, "_corrupt_record") == [("11,short",), ('8,"a, b",x',), ("9,one,2,3",)]
    assert (usable.count(), bad.select("id").count()) == (2, 3)


def test_quarantine_of_text_columns(spark, rows, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,\nid,name\n,\n")
    usable, bad = read_quarantined(spark, str(tmp_path / "a.csv"), schemas.strings("id", "name"))
    assert rows(usable, "id", "name") == [(None, None), ("1", None)] and bad.isEmpty()


def test_inferred_types_are_checked_in_every_row(spark, rows, tmp_path):
    early = "".join(f"{i},{i}.5,2024-01-0{i % 9 + 1},t{i},{3_000_000_000 + i},true,\n" for i in range(20))
    (tmp_path / "a.csv").write_text("a,b,c,d,e,f,g\n" + early)
    df = read_inferred(spark, str(tmp_path / "a.csv"))
    assert df.dtypes == [("a", "int"), ("b", "double"), ("c", "date"), ("d", "string"), ("e", "bigint"),
                         ("f", "boolean"), ("g", "string")]
    assert df.count() == 20 and df.agg(F.sum("e")).first()[0] == 60_000_000_190
    for late in ("x,1,2024-01-01,t,1,true,", "1,1,2024-02-30,t,1,true,", "5000000000,1,,,,,"):
        (tmp_path / "b.csv").write_text("a,b,c,d,e,f,g\n" + early + late + "\n")
        with pytest.raises(Exception, match="was inferred as"):
            read_inferred(spark, str(tmp_path / "b.csv"), sample_rows=20).collect()
        assert read_inferred(spark, str(tmp_path / "b.csv")).count() == 21  # a whole sample widens the type
    (tmp_path / "c.csv").write_text("a,b\n")
    assert read_inferred(spark, str(tmp_path / "c.csv")).dtypes == [("a", "string"), ("b", "string")]


def test_parse_modes(spark, csv_folder):
    lines = drop_header(read_lines(spark, f"{csv_folder}/part_2.csv"), "id,name,age")
    assert lines.count() == 3
    strict = parse_lines(lines, schemas.CSV_PEOPLE, mode="FAILFAST")
    with pytest.raises(Exception, match="(?i)malformed"):
        strict.collect()
    dropped = read_delimited(spark, f"{csv_folder}/part_2.csv", schemas.CSV_PEOPLE, header=True, mode="DROPMALFORMED")
    assert [tuple(r) for r in dropped.collect()] == [(9, "Wu", 44)]
    # The number of fields counts, whichever column is selected.
    assert [tuple(r) for r in dropped.select("id").collect()] == [(9,), (10,)]
    strict = read_delimited(spark, f"{csv_folder}/part_2.csv", schemas.CSV_PEOPLE, header=True, mode="FAILFAST")
    with pytest.raises(Exception, match="(?i)malformed"):
        strict.select("id").collect()


def test_single_file_or_an_error(spark, tmp_path):
    df = spark.range(0, 100, 1, 4).select(F.col("id").cast("string").alias("value"))
    sinks.write_text(sinks.one_file(df, max_rows=100), str(tmp_path / "one"))
    assert len(glob.glob(str(tmp_path / "one/part-*"))) == 1
    with pytest.raises(ValueError, match="one file"):
        sinks.one_file(df, max_rows=99)


def test_export_comes_back_as_it_was(spark, rows, tmp_path, monkeypatch):
    texts = ["a\nb", "c\r\nd\r", '"', 'x","y', " pad ", "", None, "\\", '\\"', "\t", "é,ü", "null", "#no comment", "'"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(2)
    monkeypatch.setattr(sinks, "ROWS_PER_FILE", 3)
    sinks.export_csv(df, str(tmp_path / "t"))
    assert len(glob.glob(str(tmp_path / "t/part-*"))) >= 5
    back = read_exported(spark, str(tmp_path / "t"), df.schema)
    assert rows(back.orderBy("id")) == rows(df.orderBy("id"))
    assert (back.count(), back.select("id").distinct().count()) == (len(texts), len(texts))


def test_export_writes_empty_nulls_and_iso_dates(spark, tmp_path):
    df = spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b, DATE '2024-03-01' AS c")
    sinks.export_csv(df, str(tmp_path / "out"))
    (part,) = glob.glob(str(tmp_path / "out/part-*"))
    assert open(part).read() == "a,b,c\n1,,2024-03-01\n"


def test_partition_column_comes_back_last(spark, tmp_path):
    df = spark.createDataFrame([(1, "NY", 5.0), (2, None, 6.0)], "id INT, city STRING, v DOUBLE")
    sinks.write_parquet(df, str(tmp_path / "p"), ["city"])
    assert spark.read.parquet(str(tmp_path / "p")).columns == ["id", "v", "city"]


CUSTOMERS = """customer_id,first_name,last_name,email,phone,signup_date,country,state,postal_code,is_active,loyalty_points
1, ann ,LEE,Ann@Mail.com,(612) 555-0100,2023-01-15,U.S.A.,minnesota,55401,Yes,-5
1,ann,LEE,Ann@Mail.com,(612) 555-0100,2023-01-15,U.S.A.,minnesota,55401,Yes,-5
2,bob,null,bad,555,15-03-2023,canada,Ontario,N/A,No,200000
XYZ,x,y,,,,,,,,
"""
PRODUCTS = """product_id,product_name,category,brand,price,cost,stock_quantity,weight_kg,created_date,is_active
p1001,USB Cable,electronics,Acme,$14.99,5.00,-3,0.2,2023/02/20,1
P1002,Desk,FURNITURE,ikea,"399,99",200,10,abc,2023-02-30,maybe
BAD,Thing,x,y,1,1,1,1,2023-01-01,1
"""
ORDERS = """order_id,customer_id,product_id,order_date,ship_date,quantity,unit_price,discount_pct,total_amount,payment_method,order_status
1,1,p1001,2023-03-01,2023-03-04,2,$14.99,10,26.98,visa,SHIPPED
2,2,P1002,03-15-2023,,1,"399,99",,399.00,,pending
3,1,P1001,2023-03-01,2023-02-01,1,14.99,0,14.99,cash,shipped
4,9,P1001,2023-03-01,,1,14.99,0,14.99,cash,shipped
5,1,P9999,2023-03-01,,1,14.99,0,14.99,cash,shipped
6,1,P1001,2023-03-01,,1000,14.99,0,14.99,cash,shipped
"""


def test_retail_run(spark, rows, tmp_path):
    for name, body in (("customers", CUSTOMERS), ("products", PRODUCTS), ("orders", ORDERS)):
        (tmp_path / f"{name}.csv").write_text(body)
    raw = retail.read_raw_tables(spark, str(tmp_path))
    sinks.create_database(spark, "shop", str(tmp_path / "shop"))
    tables = retail.run(raw, "shop", str(tmp_path / "export"), single_files=True)
    assert rows(tables["data_quality_summary"]) == [
        ("customers", 4, 2, 2), ("orders", 6, 2, 4), ("products", 3, 2, 1)]
    facts = tables["orders"].orderBy("order_id").collect()
    assert [(f.order_id, str(f.calculated_total_amount), str(f.amount_difference), f.payment_method)
            for f in facts] == [(1, "26.98", "0.00", "Credit Card"), (2, "399.99", "0.99", "Unknown")]
    enriched = tables["sales_enriched"].orderBy("order_id").collect()
    assert [(e.customer_name, str(e.profit), e.shipping_days, e.order_month) for e in enriched] == [
        ("Ann Lee", "16.98", 3, "2023-03"), ("Bob", "199.99", None, "2023-03")]
    assert len(glob.glob(str(tmp_path / "export/fact_orders/part-*"))) == 1

    sinks.create_database(spark, "depot", str(tmp_path / "depot"))
    for _ in range(2):  # loading again replaces, never doubles
        loaded = retail.load_exports(spark, str(tmp_path / "export"), "depot")
    assert spark.table(loaded["fact_orders"]).schema.simpleString() == schemas.FACT_ORDERS.simpleString()
    assert rows(spark.table(loaded["fact_orders"])) == rows(tables["orders"])
    assert rows(spark.table(loaded["dim_products"])) == rows(tables["products"])
    assert reports.overall_performance(tables["orders"]).first().total_units == 3


@pytest.mark.parametrize("body, error", [
    ("id,name,age\n1,a,old\n", "CAST_INVALID_INPUT"),
    ("id,name,age\n1,a\n", "(?i)malformed"),
    ("id,name,age\n1,a,2,more\n", "(?i)malformed"),
    ("id,name\n1,a\n", "no column age"),
])
def test_reload_aborts_on_bad_rows(spark, tmp_path, body, error):
    (tmp_path / "x.csv").write_text(body)
    with pytest.raises(Exception, match=error):
        sinks.reload_table(spark, str(tmp_path / "x.csv"), "default", "bad_load", schemas.CSV_PEOPLE)


def test_aborted_reload_keeps_the_old_table(spark, rows, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text("id,name,age\n1,a,2\n2,b,3\n")
    bad.write_text("id,name,age\n" + "".join(f"{i},x,1\n" for i in range(1000)) + "1,a,2,long\n")
    sinks.create_database(spark, "kept", str(tmp_path / "kept"))
    with pytest.raises(Exception, match="(?i)malformed"):
        sinks.reload_table(spark, str(bad), "kept", "people", schemas.CSV_PEOPLE)
    assert not spark.catalog.listTables("kept")
    for _ in range(2):
        sinks.reload_table(spark, str(good), "kept", "people", schemas.CSV_PEOPLE)
        with pytest.raises(Exception, match="(?i)malformed"):
            sinks.reload_table(spark, str(bad), "kept", "people", schemas.CSV_PEOPLE)
        assert rows(spark.table("kept.people")) == [(1, "a", 2), (2, "b", 3)]
        assert [t.name for t in spark.catalog.listTables("kept")] == ["people"]
    # A table may be replaced by rows read from itself.
    sinks.save_table(spark.table("kept.people").filter("id = 2"), "kept", "people")
    assert rows(spark.table("kept.people")) == [(2, "b", 3)]


def test_failed_swap_keeps_the_old_table(spark, rows, tmp_path):
    sinks.create_database(spark, "swapped", str(tmp_path / "swapped"))
    sinks.save_table(spark.range(3).toDF("id"), "swapped", "t")
    with pytest.raises(Exception, match="(?i)not.found|cannot be found"):
        sinks._swap(spark, "swapped.missing", "swapped.t")
    assert rows(spark.table("swapped.t")) == [(0,), (1,), (2,)]


def test_reload_aborts_on_a_file_with_another_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,age\n1,a,2\n")
    (tmp_path / "b.csv").write_text("id,age,name\n1,2,a\n")
    with pytest.raises(Exception, match="(?i)header"):
        sinks.reload_table(spark, str(tmp_path), "default", "bad_load", schemas.CSV_PEOPLE)


def test_stream_restarts_without_counting_twice(spark, rows, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "event_id INT, event_type STRING"
    spark.createDataFrame([(1, "purchase"), (2, "view")], schema).write.mode("append").parquet(source)
    frame = spark.read.parquet(source)
    for _ in range(2):
        stream.run_counts(stream.read_event_stream(spark, source, frame.schema), ["event_type"], out)
        assert rows(stream.latest_counts(spark, out)) == [("purchase", 1), ("view", 1)]
    spark.createDataFrame([(3, "view")], schema).write.mode("append").parquet(source)
    stream.run_counts(stream.read_event_stream(spark, source, frame.schema), ["event_type"], out)
    assert rows(stream.latest_counts(spark, out)) == [("purchase", 1), ("view", 2)]

    # A path pattern finds a table kept as one file or as a folder of files.
    stream.run_counts(stream.read_event_stream(spark, f"{tmp_path}/i[n]", frame.schema), ["event_type"],
                      str(tmp_path / "by_pattern"))
    assert rows(stream.latest_counts(spark, str(tmp_path / "by_pattern"))) == [("purchase", 1), ("view", 2)]

    routed = stream.read_event_stream(spark, source, frame.schema).withColumn(
        "channel", stream.channel(F.col("event_type"), ["purchase"]))
    stream.run_routing(routed, str(tmp_path / "routes"))
    back = spark.read.parquet(str(tmp_path / "routes/routed"))
    assert rows(back, "event_id", "channel") == [(1, "order"), (2, "navigation"), (3, "navigation")]
