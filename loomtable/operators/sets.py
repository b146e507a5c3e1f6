"""Set operations with the semantics of plain collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtable.operators.hotkeys import match


def union_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both, duplicates kept, columns matched by name."""
    return left.unionByName(right)


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows found in both, nulls being equal.

    One grouping over the tagged rows of both sides: a single shuffle, before which
    repeated rows are already combined.
    """
    names = left.columns

    def tagged(df: DataFrame, in_left: bool) -> DataFrame:
        return df.select(*names, F.lit(in_left).alias("_left"), F.lit(not in_left).alias("_right"))

    sides = tagged(left, True).unionByName(tagged(right, False)).groupBy(*names)
    both = sides.agg(F.max("_left").alias("_left"), F.max("_right").alias("_right"))
    return both.filter(F.col("_left") & F.col("_right")).select(*names)


def subtract(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left rows not found on the right; duplicates of kept rows are kept, nulls are equal."""
    return match(left, right.select(*left.columns).distinct(), left.columns, "left_anti")
