"""Explicit schemas of the supported inputs and curated tables.

The column names, their order and their types are fixed formats; ids are 64-bit.
"""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

INT, LONG, TEXT, REAL = IntegerType(), LongType(), StringType(), DoubleType()
DATE, FLAG = DateType(), BooleanType()


def columns(**types: DataType) -> StructType:
    """Schema from ``name=type`` pairs, in the order given."""
    return StructType([StructField(name, kind) for name, kind in types.items()])


def strings(*names: str) -> StructType:
    """Schema with every column read as text (raw landing layer)."""
    return columns(**dict.fromkeys(names, TEXT))


PEOPLE = columns(id=LONG, name=TEXT, age=REAL, city=TEXT)
CSV_PEOPLE = columns(id=LONG, name=TEXT, age=INT)
SALES_FILE = columns(product_id=TEXT, name=TEXT, category=TEXT, price=REAL, quantity=INT)
CUSTOMER_ORDERS = columns(customer_id=LONG, order_id=LONG, amount=REAL)
FRIENDS = columns(id=LONG, name=TEXT, age=INT, friends=INT)
RATINGS = columns(user_id=LONG, movie_id=LONG, rating=REAL, timestamp=LONG)
HERO_NAMES = columns(id=LONG, name=TEXT)
WEATHER = columns(station_id=TEXT, date=INT, type=TEXT, value=FloatType())
CUSTOMER_JSON = columns(customer=columns(id=LONG, city=TEXT))
ETL_ORDERS = columns(order_id=LONG, customer_id=LONG, date=TEXT, amount=REAL)
ETL_CUSTOMERS = columns(customer_id=LONG, city=TEXT, segment=TEXT)

RAW_ORDERS = strings(
    "order_id", "customer_id", "product_id", "order_date", "ship_date", "quantity",
    "unit_price", "discount_pct", "total_amount", "payment_method", "order_status",
)
RAW_PRODUCTS = strings(
    "product_id", "product_name", "category", "brand", "price", "cost",
    "stock_quantity", "weight_kg", "created_date", "is_active",
)
RAW_CUSTOMERS = strings(
    "customer_id", "first_name", "last_name", "email", "phone", "signup_date",
    "country", "state", "postal_code", "is_active", "loyalty_points",
)

DIM_CUSTOMERS = columns(
    customer_id=LONG, first_name=TEXT, last_name=TEXT, email=TEXT, phone=TEXT,
    signup_date=DATE, country=TEXT, state=TEXT, postal_code=TEXT,
    is_active=FLAG, loyalty_points=INT,
)
DIM_PRODUCTS = columns(
    product_id=TEXT, product_name=TEXT, category=TEXT, brand=TEXT,
    price=DecimalType(12, 2), cost=DecimalType(12, 2), stock_quantity=INT,
    weight_kg=DecimalType(8, 3), created_date=DATE, is_active=FLAG,
)
FACT_ORDERS = columns(
    order_id=LONG, customer_id=LONG, product_id=TEXT, order_date=DATE, ship_date=DATE,
    quantity=INT, unit_price=DecimalType(12, 2), discount_pct=DecimalType(5, 2),
    source_total_amount=DecimalType(12, 2), calculated_total_amount=DecimalType(14, 2),
    amount_difference=DecimalType(14, 2), payment_method=TEXT, order_status=TEXT,
)
DQ_SUMMARY = columns(
    dataset=TEXT, source_record_count=LONG, target_record_count=LONG, removed_record_count=LONG
)
