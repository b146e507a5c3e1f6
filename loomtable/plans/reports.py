"""Retail reports over curated facts and dimensions.

``orders`` needs: order_id, customer_id, product_id, order_date, ship_date, quantity,
calculated_total_amount, order_status, payment_method (as far as a report uses them).
``per_order`` says that there is one fact per order; otherwise (lines) orders are counted distinct.
Facts are added up by key before any join with a dimension where the result allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtable.functions.times import days_between, month_start

AMOUNT = "calculated_total_amount"
PRODUCT = ("product_id", "product_name", "category", "brand")
CUSTOMER = ("customer_id", "first_name", "last_name", "country", "state")


def _measures(per_order: bool, *extra: Column) -> list[Column]:
    orders = F.count("order_id") if per_order else F.count_distinct("order_id")
    return [
        orders.alias("total_orders"),
        *extra,
        F.sum("quantity").alias("total_units"),
        F.round(F.sum(AMOUNT), 2).alias("total_revenue"),
    ]


def _customers_and_average() -> list[Column]:
    return [
        F.count_distinct("customer_id").alias("unique_customers"),
        F.round(F.avg(AMOUNT), 2).alias("average_order_value"),
    ]


def overall_performance(orders: DataFrame, per_order: bool = False) -> DataFrame:
    buyers, average = _customers_and_average()
    return orders.agg(*_measures(per_order, buyers), average)


def revenue_by_category(orders: DataFrame, products: DataFrame, per_order: bool = False) -> DataFrame:
    """Revenue and estimated profit (revenue less quantity times cost) per category."""
    profit = F.col(AMOUNT) - F.col("quantity") * F.col("cost")
    return (
        orders.join(products.select("product_id", "category", "cost"), "product_id")
        .groupBy("category")
        .agg(*_measures(per_order), F.round(F.sum(profit), 2).alias("estimated_profit"))
        .orderBy(F.desc("total_revenue"), "category")
    )


def customer_sales(orders: DataFrame, customers: DataFrame, per_order: bool = False) -> DataFrame:
    """Orders, units and revenue per customer."""
    totals = orders.groupBy("customer_id").agg(*_measures(per_order))
    return customers.select(*CUSTOMER).join(totals, "customer_id")


def top_customers(
    orders: DataFrame, customers: DataFrame, n: int = 10, per_order: bool = False
) -> DataFrame:
    ranked = customer_sales(orders, customers, per_order)
    return ranked.orderBy(F.desc("total_revenue"), "customer_id").limit(n)


def product_sales(orders: DataFrame, products: DataFrame, per_order: bool = False) -> DataFrame:
    """Orders, units, revenue and estimated profit per product."""
    totals = orders.groupBy("product_id").agg(
        *_measures(per_order),
        # Lines without an amount or quantity carry no profit either.
        F.sum(F.when(F.col("quantity").isNotNull(), F.col(AMOUNT))).alias("_amount"),
        F.sum(F.when(F.col(AMOUNT).isNotNull(), F.col("quantity"))).alias("_units"),
    )
    profit = F.round(F.col("_amount") - F.col("_units") * F.col("cost"), 2)
    return (
        products.select(*PRODUCT, "cost").join(totals, "product_id")
        .withColumn("estimated_profit", profit)
        .drop("cost", "_amount", "_units")
    )


def top_products(orders: DataFrame, products: DataFrame, n: int = 10) -> DataFrame:
    ranked = product_sales(orders, products)
    return ranked.orderBy(F.desc("total_units"), F.desc("total_revenue"), "product_id").limit(n)


def revenue_by_status_payment(orders: DataFrame, per_order: bool = False) -> DataFrame:
    keys = ("order_status", "payment_method")
    return orders.groupBy(*keys).agg(*_measures(per_order)).orderBy(F.desc("total_revenue"), *keys)


def monthly_trend(orders: DataFrame, per_order: bool = False) -> DataFrame:
    buyers, average = _customers_and_average()
    return (
        orders.groupBy(month_start(F.col("order_date")).alias("sales_month"))
        .agg(*_measures(per_order, buyers), average)
        .orderBy("sales_month")
    )


def shipping_days_by_status(orders: DataFrame) -> DataFrame:
    days = days_between(F.col("order_date"), F.col("ship_date"))
    return (
        orders.filter(F.col("ship_date").isNotNull())
        .groupBy("order_status")
        .agg(F.count("*").alias("shipped_order_count"),
             F.round(F.avg(days), 2).alias("average_shipping_days"))
        .orderBy("average_shipping_days", "order_status")
    )


def with_margin(products: DataFrame) -> DataFrame:
    """Gross margin and its percentage of the price."""
    margin = F.col("price") - F.col("cost")
    return products.withColumns({
        "gross_margin": margin,
        "gross_margin_pct": F.round(F.try_divide(margin * 100, F.col("price")), 2),
    })
