"""Joins and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inner_on(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Matching rows with both key columns kept."""
    return left.join(right, left[left_key] == right[right_key], "inner")


def left_on(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """All left rows, right columns null where nothing matches."""
    return left.join(right, left[left_key] == right[right_key], "left")


def anti_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left rows without a match (rows with a null key have none)."""
    return left.join(right, left[left_key] == right[right_key], "left_anti")


def semi_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left rows with at least one match, never multiplied."""
    return left.join(right, left[left_key] == right[right_key], "left_semi")


def lookup_with_default(
    df: DataFrame, lookup: DataFrame, key: str, value: str, default: str
) -> DataFrame:
    """Add ``value`` from a lookup table with unique keys, ``default`` where it has none.

    Spark broadcasts the lookup where it knows its bytes to be few, before the run or during it; else both sides
    are shuffled.
    """
    found = df.join(lookup.select(key, value), key, "left")
    return found.withColumn(value, F.coalesce(value, F.lit(default)))


def total_per_left_row(
    left: DataFrame, facts: DataFrame, left_key: str, fact_key: str, measure: str, name: str
) -> DataFrame:
    """Sum of ``measure`` for each left row, zero where it has no facts.

    Facts are added up per key before the join, so a hot key meets it as one row.
    """
    totals = facts.groupBy(fact_key).agg(F.sum(measure).alias(name))
    return (
        left.join(totals, left[left_key] == totals[fact_key], "left")
        .drop(totals[fact_key])
        .fillna({name: 0})
    )


def other_side(first: str, second: str, one: Column) -> Column:
    """The member of a pair that is not ``one``."""
    return F.when(F.col(first) == one, F.col(second)).otherwise(F.col(first))


def filtered_join_count(
    df: DataFrame, lookup: DataFrame, key: str, keep: Column, group: str, name: str = "count"
) -> DataFrame:
    """Filter early, keep only needed columns, join, count per group.

    Lookup rows are counted per key first, so a key repeated on both sides does not multiply.
    """
    matches = lookup.groupBy(key).agg(F.count("*").alias("_matches"))
    rows = df.filter(keep).select(key, group)
    return rows.join(matches, key).groupBy(group).agg(F.sum("_matches").alias(name))
