"""In-memory inputs and session views."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def from_rows(spark: SparkSession, rows: list, schema, partitions: int | None = None) -> DataFrame:
    """Table from Python rows; ``schema`` is a StructType, a DDL string or column names."""
    df = spark.createDataFrame(rows, schema)
    return df.repartition(partitions) if partitions else df


def number_range(
    spark: SparkSession, start: int, stop: int, partitions: int | None = None
) -> DataFrame:
    """Integers ``start .. stop - 1`` as column ``value``."""
    return spark.range(start, stop, 1, partitions).withColumnRenamed("id", "value")


def from_pandas(spark: SparkSession, pdf: pd.DataFrame) -> DataFrame:
    """Spark table from a pandas frame that already lives on the driver."""
    return spark.createDataFrame(pdf)


def register_view(df: DataFrame, name: str, across_sessions: bool = False) -> str:
    """Register a view (replacing an older one) and return the name SQL should use."""
    if across_sessions:
        df.createOrReplaceGlobalTempView(name)
        return f"global_temp.{name}"
    df.createOrReplaceTempView(name)
    return name
