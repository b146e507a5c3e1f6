"""Registered queries over the test tables, each with the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODULES = ("relational", "grouping", "windowed", "scalars", "texts", "retail", "reports", "files")


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its reference SQL if there is one."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle.strip()
        return fn

    return register


def load() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(column: str | Column) -> Column:
    """Amounts as exact decimals, so that sums do not depend on their order."""
    col = F.col(column) if isinstance(column, str) else column
    return col.cast("decimal(12,2)")


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for comparison with other engines."""
    return df.select(*[
        F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType)
        else F.col(f.name)
        for f in df.schema.fields
    ])
