"""Validation queries over the curated order facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtable.operators.quality import failing, pass_fail


def rule_violations(orders: DataFrame) -> DataFrame:
    """Orders breaking a business rule, each with the rules it breaks."""
    col = F.col
    required = ("order_id", "customer_id", "product_id", "order_date")
    rules = {f"{name} missing": col(name).isNull() for name in required}
    rules |= {
        "quantity out of range": ~col("quantity").between(1, 100),
        "price not positive": col("unit_price") <= 0,
        "discount out of range": ~col("discount_pct").between(0, 100),
        "total not positive": col("calculated_total_amount") <= 0,
        "shipped before ordered": col("ship_date") < col("order_date"),
    }
    return failing(orders, rules)


def recheck_totals(orders: DataFrame) -> DataFrame:
    """Recompute each order's total and compare: PASS or FAIL per order."""
    net = F.col("quantity") * F.col("unit_price") * (1 - F.col("discount_pct") / 100)
    again = F.round(net, 2)
    return orders.select(
        "order_id",
        F.col("calculated_total_amount").alias("stored_total"),
        again.alias("recalculated_total"),
        pass_fail(F.col("calculated_total_amount") == again).alias("validation_result"),
    )
