"""Dirty values and the clean values they must become."""

from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from loomtable.functions import cleaning as c

CASES = [
    (c.clean_text, [(" n/a ", None), ("", None), (" Ab ", "Ab"), (None, None), ("Nan", None), ("nana", "nana")]),
    (c.parse_int, [("12", 12), ("XYZ", None), ("12.7", 12), ("-12.7", -12), ("+3", 3), ("12.", 12),
                   ("1.2.3", None), ("99999999999", None), ("99999999999.5", None), ("12a", None), (None, None)]),
    (c.parse_decimal, [("$14.99", D("14.99")), ("399,99", D("399.99")), ("1,234.50", D("1234.50")),
                       ("1,234", D("1.23")), ("1,234,567", None), ("abc", None), ("€ 5", D("5.00")),
                       ("1.235", D("1.24")), ("£1\t2", D("12.00")), ("123456789012", None), (None, None)]),
    (lambda x: c.parse_date(x, c.CUSTOMER_DATES), [
        ("2023-01-15", date(2023, 1, 15)), ("2023/02/20", date(2023, 2, 20)), ("15-03-2023", date(2023, 3, 15)),
        ("2023-02-30", None), ("2023-1-5", None), ("hello", None), ("2023-01-15x", None), (None, None)]),
    (lambda x: c.parse_date(x, c.ORDER_DATES), [("03-15-2023", date(2023, 3, 15)), ("15-03-2023", None)]),
    (c.parse_boolean, [("TRUE", True), ("Yes", True), ("Y", True), ("1", True), ("No", False), ("0", False),
                       ("false", False), ("n", False), ("maybe", None), (None, None)]),
    (c.parse_phone, [("(612) 555-0100", "612-555-0100"), ("1-612-555-0100", "612-555-0100"), ("555", None),
                     ("2-612-555-0100", None), ("1234567890", "123-456-7890"), ("n/a", None)]),
    (c.parse_email, [("A.B@Example.COM", "a.b@example.com"), ("a@b", None), ("a@b.c1", None), (None, None)]),
    (c.parse_country, [("U.S.A.", "USA"), ("us", "USA"), ("United States of America", "USA"),
                       ("canada", "CANADA"), ("Côte", "CÔTE"), ("N/A", None)]),
    (c.parse_state, [("minnesota", "MN"), ("wi", "WI"), ("Ontario", "ON"), ("Texas", "TEXAS"), ("", None)]),
    (c.parse_name, [("mary ANN", "Mary Ann"), ("null", None)]),
    (c.parse_loyalty, [("-5", 0), ("100000", 100000), ("100001", None), ("7", 7), ("x", None)]),
    (c.parse_brand, [("ikea", "IKEA"), ("Acme", "Acme"), (None, None)]),
    (c.parse_payment, [("Visa", "Credit Card"), ("master card", "Credit Card"), ("DEBIT", "Debit Card"),
                       ("Pay Pal", "PayPal"), ("gift card", "Gift Card"), ("n/a", "Unknown"), (None, "Unknown"),
                       ("apple\tpay", "Apple Pay")]),
    (c.parse_status, [("SHIPPED", "Shipped"), ("", "Unknown")]),
    (c.parse_discount, [("10", D("10.00")), ("", D("0.00")), ("abc", D("0.00"))]),
    (lambda x: c.valid_product_id(c.parse_product_id(x)), [("p1001", True), ("P12", False), ("P12345", False)]),
    (lambda x: c.at_least_zero(c.parse_int(x)), [("-3", 0), ("4", 4), ("x", None)]),
    (lambda x: c.positive(c.parse_decimal(x)), [("0", None), ("-1", None), ("2", D("2.00"))]),
    (lambda x: c.not_negative(c.parse_decimal(x)), [("0", D("0.00")), ("-1", None)]),
]


@pytest.mark.parametrize("index", range(len(CASES)))
def test_cleaning(spark, index):
    rule, cases = CASES[index]
    df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "i INT, text STRING")
    got = [r.out for r in df.select("i", rule(F.col("text")).alias("out")).orderBy("i").collect()]
    assert got == [want for _, want in cases]


def test_order_total_rounds_half_up(spark):
    df = spark.createDataFrame([(3, D("0.35"), D("50.00"))], "q INT, p DECIMAL(12,2), d DECIMAL(5,2)")
    assert df.select(c.order_total(F.col("q"), F.col("p"), F.col("d"))).first()[0] == D("0.53")
