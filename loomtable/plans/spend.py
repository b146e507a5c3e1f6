"""Small customer jobs: spend, weather minimum, sales lines, customers without orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtable.operators.aggregates import group_sum
from loomtable.sources import register_view


def spend_per_customer(orders: DataFrame, digits: int = 1) -> DataFrame:
    """Rounded total per customer, largest first."""
    totals = group_sum(orders, ["customer_id"], "amount", "total_spent", digits)
    return totals.orderBy(F.desc("total_spent"), "customer_id")


def spend_per_customer_sql(orders: DataFrame, digits: int = 1) -> DataFrame:
    """The same job as a SQL string over a global view."""
    view = register_view(orders, "customer_orders", across_sessions=True)
    return orders.sparkSession.sql(
        f"SELECT customer_id, round(sum(amount), {int(digits)}) AS total_spent "
        f"FROM {view} GROUP BY customer_id ORDER BY total_spent DESC, customer_id"
    )


def customers_without_orders_sql(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Customers without orders, as SQL over session views, written as an anti join."""
    known = register_view(customers, "all_customers")
    placed = register_view(orders, "all_orders")
    spark = customers.sparkSession
    found = spark.sql(
        f"SELECT c.customer_id, c.name FROM {known} c LEFT ANTI JOIN {placed} o "
        "ON c.customer_id = o.customer_id ORDER BY c.customer_id"
    )
    for view in (known, placed):
        spark.catalog.dropTempView(view)  # the rows don't need them any more
    return found


def minimum_by_type(readings: DataFrame, kind: str, key: str, value: str, type_column: str = "type") -> DataFrame:
    """Smallest value per key among the readings of one type."""
    return (
        readings.filter(F.col(type_column) == kind)
        .groupBy(key).agg(F.min(value).alias("min_value"))
    )


def sales_line(columns: list[str], sep: str = ",") -> Column:
    """One delimited text line from some columns."""
    return F.concat_ws(sep, *[F.col(c).cast("string") for c in columns])


def revenue_line(price: str, quantity: str, labels: list[str]) -> Column:
    """``labels..., price * quantity`` with two decimals."""
    revenue = F.format_string("%.2f", (F.col(price) * F.col(quantity)).cast("double"))
    return F.concat_ws(",", *[F.col(c).cast("string") for c in labels], revenue)
