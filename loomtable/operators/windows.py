"""Ranking, running, neighbouring, rolling and session calculations.

Operators that look at a whole group work on hot keys in blocks of rows (see ``hotkeys``): each block by itself, and
a small table with one row per (key, block) carries the state from block to block. Results are the same for any
``step``, the mean number of rows in a block, so it may be set freely (sums of floating-point numbers are added up
block by block and can differ in their last digits; decimals and integers can't). No task holds a whole hot group.
Hot keys are looked for when an operator is called; without any, the plan is that of the plain window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtable.functions.times import day_number, epoch_seconds
from loomtable.operators.hotkeys import BLOCK, BLOCK_ROWS, in_blocks, match


def _before(keys: list[str], order, upto: int = -1):
    """Window over the earlier rows of a key, up to ``upto`` rows before the current one."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, upto)


def _combine(plain: DataFrame, blocked: DataFrame) -> DataFrame:
    """Rows of ordinary and hot keys together, in the ordinary part's types."""
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in plain.schema.fields]
    return plain.unionByName(blocked.select(*typed))


def _by_key_or_block(
    df: DataFrame, keys: list[str], order: list[str], step: int,
    whole: Callable[[DataFrame], DataFrame], blocked: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """``whole`` of the ordinary keys' rows together with ``blocked`` of the hot keys' rows."""
    cold, hot = in_blocks(df, keys, order, step)
    return whole(cold) if hot is None else _combine(whole(cold), blocked(hot))


def top_n_per_group(
    df: DataFrame, keys: list[str], order: list[Column], n: int, position: str | None = None
) -> DataFrame:
    """First ``n`` rows per group. ``order`` must be total, so that the choice is fixed.

    Spark trims each group to ``n`` rows before the shuffle, so hot groups stay small.
    """
    rank = position or "_position"
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(rank) <= n)
    return kept if position else kept.drop(rank)


def top_with_ties(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """All rows that share the largest value of their group (nulls come last).

    The largest values are found with map-side combine and the rows matched with them, so ties are never gathered
    and a skewed partition of the join can be split.
    """
    best = df.groupBy(*keys).agg(F.max(value).alias(value))
    return match(df, best, [*keys, value], "left_semi")


def dedupe_by_key(df: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """One row per key: the first in ``order``, by default in the order of all columns (ascending, nulls first).

    Rows are sorted by their key; further columns are compared only between rows of one key. A grouped minimum of the
    whole row gives the same, but Spark interprets it: measured, it takes 1.3 to 2 times as long.
    """
    rest = order or [F.col(c).asc() for c in df.columns if c not in keys] or [F.lit(0)]
    return top_n_per_group(df, keys, rest, 1)


def _cumulative(
    df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], step: int
) -> DataFrame:
    """Sums from the first row of a key to the current one in ascending ``order``, as new name -> column added up."""

    def summed(rows: DataFrame, by: list[str]) -> DataFrame:
        frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        return rows.withColumns({name: F.sum(value).over(frame) for name, value in sums.items()})

    def blocked(hot: DataFrame) -> DataFrame:
        earlier = _before(keys, F.col(BLOCK))
        carry = (
            hot.groupBy(*keys, BLOCK)
            .agg(*[F.sum(value).alias(f"_total_{i}") for i, value in enumerate(sums.values())])
            .select(*keys, BLOCK,
                    *[F.sum(f"_total_{i}").over(earlier).alias(f"_carry_{i}") for i in range(len(sums))])
        )
        carried = match(summed(hot, keys + [BLOCK]), carry, keys + [BLOCK], "left")
        return carried.withColumns({
            name: F.coalesce(F.col(name) + F.col(f"_carry_{i}"), F.col(name), F.col(f"_carry_{i}"))
            for i, name in enumerate(sums)
        })

    return _by_key_or_block(df, keys, order, step, lambda cold: summed(cold, keys), blocked)


def rank_compare(
    df: DataFrame, keys: list[str], value: str, tiebreak: list[str], step: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``row_number``, ``rank`` and ``dense_rank`` by descending value.

    ``tiebreak`` columns order equal values for ``row_number``. Rows of a hot key are numbered upwards by block; what
    lies above a value follows from the counts per (key, block, value), as a value may go on over several blocks.
    """
    by_value = Window.partitionBy(*keys).orderBy(F.desc(value))
    by_row = Window.partitionBy(*keys).orderBy(F.desc(value), *tiebreak)
    return _by_key_or_block(
        df, keys, [value, *tiebreak], step,
        lambda cold: cold.withColumns({
            "row_number": F.row_number().over(by_row),
            "rank": F.rank().over(by_value),
            "dense_rank": F.dense_rank().over(by_value),
        }),
        lambda hot: _rank_blocks(hot, keys, value, tiebreak),
    )


def _rank_blocks(hot: DataFrame, keys: list[str], value: str, tiebreak: list[str]) -> DataFrame:
    inside = keys + [BLOCK]
    upwards = Window.partitionBy(*inside).orderBy(value)
    values = hot.groupBy(*inside, value).agg(F.count("*").alias("_n")).withColumns({
        "_upto": F.sum("_n").over(upwards), "_index": F.row_number().over(upwards),
    })
    key, along = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(BLOCK)
    earlier = _before(keys, F.col(BLOCK))
    place = F.struct(value)
    blocks = (
        values.groupBy(*inside)
        .agg(F.sum("_n").alias("_rows"), F.count("*").alias("_values"),
             F.min(place).alias("_first"), F.max(place).alias("_last"))
        # The first value may be the last one of the block before.
        .withColumn("_shared", F.coalesce(F.lag("_last").over(along) == F.col("_first"), F.lit(False)).cast("int"))
        .select(
            *inside,
            F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
            F.sum("_rows").over(key).alias("_all_rows"),
            (F.coalesce(F.sum(F.col("_values") - F.col("_shared")).over(earlier), F.lit(0))
             - F.col("_shared")).alias("_values_before"),
            F.sum(F.col("_values") - F.col("_shared")).over(key).alias("_all_values"),
        )
    )
    ranks = match(values, blocks, inside, "left").groupBy(*keys, value).agg(
        F.sum("_n").alias("_same"),
        (F.max("_all_rows") - F.max(F.col("_rows_before") + F.col("_upto"))).alias("_above"),
        (F.max("_all_values") - F.max(F.col("_values_before") + F.col("_index")) + 1).alias("dense_rank"),
    )
    numbered = hot.withColumn("_up", F.row_number().over(
        Window.partitionBy(*inside).orderBy(value, *tiebreak)))
    return match(match(numbered, blocks, inside, "left"), ranks, [*keys, value], "left").withColumns({
        # Rows before this one upwards, less those of smaller values, come after the rows above.
        "row_number": F.col("_above") + F.col("_rows_before") + F.col("_up")
        - (F.col("_all_rows") - F.col("_above") - F.col("_same")),
        "rank": F.col("_above") + 1,
    })


def running_total(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: str,
    name: str = "running_total",
    step: int = BLOCK_ROWS,
) -> DataFrame:
    """Cumulative sum per key in ascending ``order`` (which must be total)."""
    return _cumulative(df, keys, order, {name: value}, step)


def neighbours(
    df: DataFrame, keys: list[str], order: list[str], value: str, step: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``previous``, ``next`` and ``difference`` (value less previous) per key; ``order`` must be total."""

    def shifted(rows: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order)
        return rows.withColumns({
            "previous": F.lag(value, 1).over(w), "next": F.lead(value, 1).over(w),
        })

    def blocked(hot: DataFrame) -> DataFrame:
        place = F.struct(*order)
        along = Window.partitionBy(*keys).orderBy(BLOCK)
        ends = (
            hot.groupBy(*keys, BLOCK)
            .agg(
                F.min(place).alias("_first"), F.max(place).alias("_last"),
                F.min_by(value, place).alias("_first_value"),
                F.max_by(value, place).alias("_last_value"),
            )
            .withColumns({
                "_last_before": F.lag("_last_value").over(along),
                "_first_after": F.lead("_first_value").over(along),
            })
            .drop("_first_value", "_last_value")
        )
        inside = match(shifted(hot, keys + [BLOCK]), ends, keys + [BLOCK], "left")
        return inside.withColumns({
            "previous": F.when(place == F.col("_first"), F.col("_last_before"))
            .otherwise(F.col("previous")),
            "next": F.when(place == F.col("_last"), F.col("_first_after"))
            .otherwise(F.col("next")),
        })

    moved = _by_key_or_block(df, keys, order, step, lambda cold: shifted(cold, keys), blocked)
    return moved.withColumn("difference", F.col(value) - F.col("previous"))


def rolling_days(
    df: DataFrame, keys: list[str], date: str, value: str, days: int = 7, name: str = "rolling_average"
) -> DataFrame:
    """Average over the last ``days`` calendar days of a key, the current day included.

    All rows of a day share the result, so values are first added up per (key, day) with
    map-side combine; the window then sees at most one row per key and day.
    """
    dated = df.withColumn("_day", day_number(F.col(date)))
    daily = dated.groupBy(*keys, "_day").agg(
        F.sum(value).alias("_sum"), F.count(value).alias("_count")
    )
    frame = Window.partitionBy(*keys).orderBy("_day").rangeBetween(-(days - 1), 0)
    rolled = daily.select(
        *keys, "_day",
        (F.sum("_sum").over(frame).cast("double")
         / F.nullif(F.sum("_count").over(frame), F.lit(0))).alias(name),
    )
    return match(dated, rolled, keys + ["_day"], "left").drop("_day")


def sessionize(
    df: DataFrame, user: str, ts: str, gap_seconds: int = 1800, step: int = BLOCK_ROWS
) -> DataFrame:
    """Number each user's sessions; a gap longer than ``gap_seconds`` starts a new one.

    Gaps are measured in whole seconds. Adds ``session_number`` and ``session_id``
    (user, underscore, number padded to three digits). Rows of one second are ordered by a
    hash, so that even a single second can be worked on in blocks.
    """

    def numbered(rows: DataFrame, by: list[str]) -> DataFrame:
        # Breaks so far, not counting the start of the first row.
        w = Window.partitionBy(*by).orderBy("_sec")
        rows = rows.withColumn("_gap", F.col("_sec") - F.lag("_sec").over(w))
        breaks = F.sum(F.when(F.col("_gap") > gap_seconds, 1).otherwise(0))
        # Ties in the second have gap 0, so a peer-inclusive range frame is exact.
        return rows.withColumn("_breaks", breaks.over(w)).drop("_gap")

    timed = df.withColumns({"_sec": epoch_seconds(F.col(ts)), "_tie": F.xxhash64(*df.columns)})

    def blocked(hot: DataFrame) -> DataFrame:
        keys = [user, BLOCK]
        inside = numbered(hot, keys)
        along = Window.partitionBy(user).orderBy(BLOCK)
        apart = F.col("_start") - F.lag("_end").over(along) > gap_seconds
        carry = (
            inside.groupBy(*keys)
            .agg(F.min("_sec").alias("_start"), F.max("_sec").alias("_end"),
                 F.max("_breaks").alias("_inner"))
            .withColumn("_opens", F.when(F.coalesce(apart, F.lag(BLOCK).over(along).isNull()), 1).otherwise(0))
            .withColumn("_before", F.coalesce(
                F.sum(F.col("_opens") + F.col("_inner")).over(_before([user], F.col(BLOCK))),
                F.lit(0),
            ))
            .select(*keys, (F.col("_before") + F.col("_opens")).alias("_offset"))
        )
        return match(inside, carry, keys, "left").withColumn("session_number", F.col("_offset") + F.col("_breaks"))

    result = _by_key_or_block(
        timed, [user], ["_sec", "_tie"], step,
        lambda cold: numbered(cold, [user]).withColumn("session_number", F.col("_breaks") + 1), blocked)
    number = F.col("session_number").cast("string")
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    return result.withColumn(
        "session_id", F.concat_ws("_", F.col(user).cast("string"), padded)
    ).drop("_sec", "_tie", "_breaks")
