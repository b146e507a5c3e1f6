"""Hot keys split into blocks of rows, and null-safe matching.

A key value may carry any share of all rows. Operators that look at a whole group work on the rows of hot keys block by
block: a block is a run of a key's rows in the group's own order, tie-break included. Spark's range partitioning by
keys and order makes the blocks: it samples the rows for its bounds and finds a row's block by bisection, so the work
grows with the rows, whatever the number of blocks. The rows are written once with their block, as bounds sampled
again would be others; nothing computed from them can then disagree, nor change when an executor is lost.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtable.session import scratch_path

#: Rows of a block on average.
BLOCK_ROWS = 500_000
#: Rows that a hash picks of each block to estimate which keys are hot.
PICKS = 16
BLOCK = "_block"


def same(left: str, right: str, names: list[str]) -> Column:
    """Null-safe equality of equally named columns of two aliased tables."""
    return reduce(
        lambda a, b: a & b,
        [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names],
    )


def match(left: DataFrame, right: DataFrame, names: list[str], how: str) -> DataFrame:
    """Join on equally named columns, treating nulls as equal; left columns come first.

    Columns of ``right`` other than the keys are appended.
    """
    joined = left.alias("l").join(right.alias("r"), same("l", "r", names), how)
    if how in ("left_semi", "left_anti"):
        return joined
    extra = [c for c in right.columns if c not in names]
    return joined.select("l.*", *[F.col(f"r.{c}") for c in extra])


def hot_keys(df: DataFrame, keys: list[str], order: list[str], step: int = BLOCK_ROWS) -> DataFrame | None:
    """Keys with about ``step`` rows or more, and an estimate of their ``_rows``; None if there are none.

    A hash of keys and order picks about PICKS rows in ``step``; a key is hot if it has that many picked rows. So only
    picked rows are counted, never all keys, and the same rows always give the same hot keys.
    """
    rate = max(1, step // PICKS)
    picked = df.filter(F.pmod(F.xxhash64(*keys, *order), F.lit(rate)) == 0)
    enough = math.ceil(step / rate)
    if len(picked.select(F.lit(1)).head(enough)) < enough:
        return None  # not even all rows together are enough
    counted = picked.groupBy(*keys).agg((F.count("*") * rate).alias("_rows")).filter(F.col("_rows") >= step)
    return counted if counted.select("_rows").head(1) else None


def in_blocks(
    df: DataFrame, keys: list[str], order: list[str], step: int = BLOCK_ROWS
) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the ordinary keys, and rows of the hot keys with their block in ``_block`` (None if no key is hot).

    All rows of a block come before all rows of the next in ascending ``order`` (nulls first); rows that agree in
    all of ``order`` share a block. One or two small jobs find out whether a key is hot; if so, the hot keys' rows are
    written to the scratch folder, dealt into blocks of about ``step`` rows.
    """
    hot = hot_keys(df, keys, order, step)
    if hot is None:
        return df, None
    spark = df.sparkSession
    names, path = scratch_path(spark, "hot-keys"), scratch_path(spark, "blocks")
    hot.write.parquet(names)
    hot = spark.read.parquet(names)
    rows = hot.agg(F.sum("_rows")).first()[0]
    hot = hot.select(*keys)
    dealt = match(df, hot, keys, "left_semi").repartitionByRange(math.ceil(rows / step), *keys, *order)
    # A task writes about BLOCK_ROWS rows, also where blocks are smaller.
    dealt.withColumn(BLOCK, F.spark_partition_id()).coalesce(math.ceil(rows / BLOCK_ROWS)).write.parquet(path)
    return match(df, hot, keys, "left_anti"), spark.read.parquet(path)
