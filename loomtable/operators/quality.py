"""Counts, reconciliation and rule checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtable.operators.aggregates import duplicated_values
from loomtable.operators.joins import anti_join


def dataset_counts(datasets: dict[str, DataFrame], name: str) -> DataFrame:
    """One row per dataset with its row count, all in one job."""
    counts = [
        df.agg(F.count("*").alias(name)).select(F.lit(label).alias("dataset"), name)
        for label, df in datasets.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def count_summary(sources: dict[str, DataFrame], targets: dict[str, DataFrame]) -> DataFrame:
    """Source, target and removed rows per dataset."""
    before = dataset_counts(sources, "source_record_count")
    after = dataset_counts(targets, "target_record_count")
    removed = F.col("source_record_count") - F.col("target_record_count")
    return before.join(after, "dataset").withColumn("removed_record_count", removed)


def count_reconcile(expected: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Compare expected target counts with the rows actually stored: PASS or FAIL."""
    stored = dataset_counts(tables, "loaded_record_count")
    agrees = F.col("target_record_count") == F.col("loaded_record_count")
    return expected.join(stored, "dataset").select(
        "dataset", "target_record_count", "loaded_record_count",
        pass_fail(agrees).alias("validation_result"),
    )


def pass_fail(condition: Column) -> Column:
    return F.when(condition, "PASS").otherwise("FAIL")


def orphans(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Facts whose key is missing from the dimension; a null key is missing too."""
    return anti_join(facts, dimension.select(key), key, key)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return duplicated_values(df, keys, "duplicate_count")


def failing(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows breaking at least one rule, with the names of the broken ones.

    A rule is a condition that is true for a bad row; an unknown condition is not a breach.
    """
    broken = F.array_compact(F.array(*[F.when(bad, name) for name, bad in rules.items()]))
    return df.withColumn("broken_rules", broken).filter(F.size("broken_rules") > 0)
