"""Connection counts from an adjacency text file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtable.functions.cleaning import strict_long
from loomtable.operators.aggregates import rows_at_minimum


def connections(lines: DataFrame) -> DataFrame:
    """Total connections per id; each line is an id followed by the ids it meets."""
    line = F.col("value")
    per_line = lines.select(
        strict_long(F.regexp_extract(line, r"^\s*(\S+)", 1)).alias("id"),
        (F.regexp_count(line, F.lit(r"\S+")) - 1).alias("connections"),
    )
    known = per_line.filter(F.col("id").isNotNull())
    return known.groupBy("id").agg(F.sum("connections").alias("connections"))


def most_connected(counts: DataFrame, names: DataFrame) -> DataFrame:
    """Name and count of the best connected id (the smaller id wins a tie)."""
    top = counts.orderBy(F.desc("connections"), "id").limit(1)
    return top.join(names, "id").select("name", "connections")


def least_connected(counts: DataFrame, names: DataFrame) -> DataFrame:
    """Names of all ids with the fewest connections."""
    return (
        rows_at_minimum(counts, "connections")
        .join(names, "id").select("name", "connections").orderBy("name")
    )
