"""Reports over orders joined with what is known of their customers: totals, means and leaders by any label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtable import sinks
from loomtable.functions.cleaning import UNKNOWN
from loomtable.operators.aggregates import group_mean, group_sum
from loomtable.operators.windows import dedupe_by_key, top_n_per_group

#: Labels a customer brings to an order.
LABELS = ("city", "segment")


def labelled(df: DataFrame) -> DataFrame:
    """Missing labels filled in."""
    return df.withColumns({name: F.coalesce(name, F.lit(UNKNOWN)) for name in LABELS})


def usable_orders(raw: DataFrame) -> DataFrame:
    """One row for each order that has a usable row: with id, customer and a real date. No amount counts as zero."""
    parsed = raw.withColumns({
        "date": F.try_to_date(F.col("date"), "yyyy-MM-dd"),
        "amount": F.coalesce("amount", F.lit(0)),
    })
    # Unusable rows go first, so that all those without an id never meet in one group.
    return dedupe_by_key(parsed.dropna(subset=["order_id", "customer_id", "date"]), ["order_id"])


def usable_customers(raw: DataFrame) -> DataFrame:
    """One labelled row for each customer id."""
    return labelled(dedupe_by_key(raw.filter("customer_id IS NOT NULL"), ["customer_id"]))


def with_labels(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """All orders, with the labels of their customers where those are known."""
    return labelled(orders.join(customers.select("customer_id", *LABELS), "customer_id", "left"))


def report(
    orders: DataFrame, keys: list[str], measure: str, name: str, how: str = "sum",
    n: int | None = None, within: list[str] | None = None, position: str | None = None,
) -> DataFrame:
    """``measure`` summed or averaged (``how``) per ``keys`` as ``name``; only the ``n`` largest, if given, overall or
    within each value of ``within``. Equal values are settled by the keys."""
    if how not in ("sum", "mean"):
        raise ValueError("how is sum or mean")
    figures = (group_sum if how == "sum" else group_mean)(orders, keys, measure, name)
    if n is None:
        return figures
    order = [F.desc(name), *[F.asc(k) for k in keys]]
    return top_n_per_group(figures, within, order, n, position) if within else figures.orderBy(*order).limit(n)


def write_by(orders: DataFrame, path: str, label: str) -> None:
    """One folder for each value of a label."""
    sinks.write_parquet(orders, path, [label])
