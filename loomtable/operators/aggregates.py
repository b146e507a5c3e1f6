"""Grouped, distinct, pivoted, imputed and salted calculations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, keys: list[str], name: str = "occurrence_count") -> DataFrame:
    """Rows per distinct value."""
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def duplicated_values(df: DataFrame, keys: list[str], name: str = "occurrence_count") -> DataFrame:
    """Values that occur more than once, with their counts."""
    return value_counts(df, keys, name).filter(F.col(name) > 1)


def single_values(df: DataFrame, keys: list[str]) -> DataFrame:
    """Values that occur exactly once."""
    return value_counts(df, keys, "_n").filter(F.col("_n") == 1).drop("_n")


def group_sum(df: DataFrame, keys: list[str], value: str, name: str, digits: int | None = None) -> DataFrame:
    """Sum per group, optionally rounded."""
    total = F.sum(value)
    return df.groupBy(*keys).agg((total if digits is None else F.round(total, digits)).alias(name))


def group_mean(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Average of the non-null values per group; no keys give one overall row."""
    return df.groupBy(*keys).agg(F.avg(value).alias(name))


def salted_sum(
    df: DataFrame, keys: list[str], value: str, spread_by: list[str], name: str, salts: int = 8
) -> DataFrame:
    """Sum per key in two steps, first per (key, salt).

    The salt is a hash of ``spread_by``, so a retried task puts each row where it was before.
    """
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts))
    partial = df.groupBy(*keys, salt.alias("_salt")).agg(F.sum(value).alias("_part"))
    return partial.groupBy(*keys).agg(F.sum("_part").alias(name))


def impute_mean(df: DataFrame, column: str) -> DataFrame:
    """Replace nulls by the mean of the other rows (a scalar subquery, no driver round trip)."""
    mean = df.agg(F.avg(column)).scalar()
    return df.withColumn(column, F.coalesce(F.col(column).cast("double"), mean))


def rows_at_minimum(df: DataFrame, column: str) -> DataFrame:
    """All rows whose value equals the overall minimum."""
    return df.filter(F.col(column) == df.agg(F.min(column)).scalar())


def pivot_sum(df: DataFrame, rows: str, column: str, values: list, measure: str) -> DataFrame:
    """One column per listed value; naming them saves the job that would look for them."""
    return df.groupBy(rows).pivot(column, values).agg(F.sum(measure))


def order_by_list(column: str, values: list) -> Column:
    """Sort key that follows a given list of values; others come last."""
    position = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column))
    return F.when(position > 0, position).otherwise(len(values) + 1)


def fold_sum(column: str) -> Column:
    """Sum that is zero, not null, when there is nothing to add."""
    return F.coalesce(F.sum(column), F.lit(0))
