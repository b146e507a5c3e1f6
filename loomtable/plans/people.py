"""Cleaning of people records and the salary example."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtable.functions.cleaning import UNKNOWN
from loomtable.operators.aggregates import impute_mean


def clean_people(df: DataFrame, name: str = "name", age: str = "age") -> DataFrame:
    """Drop exact duplicates, fill ages with their mean and names with Unknown."""
    return impute_mean(df.dropDuplicates(), age).fillna({name: UNKNOWN})


def older_than(df: DataFrame, limit: float, age: str = "age") -> DataFrame:
    return df.filter(F.col(age) > limit)


def raise_salary(df: DataFrame, index: str, salary: str = "salary", factor: float = 1.1) -> DataFrame:
    """Salary after promotion, computed through the pandas API on Spark.

    ``index`` names a key column, which spares the pass that would number the rows.
    """
    frame = df.pandas_api(index_col=index)
    frame["salary_after_promotion"] = frame[salary] * factor
    return frame.to_spark(index_col=index)
