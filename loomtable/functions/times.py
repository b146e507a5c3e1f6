"""Dates and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since the epoch; accepts timestamps with or without zone."""
    return F.unix_seconds(ts.cast("timestamp"))


def day_number(date: Column) -> Column:
    """Days since the epoch, free of daylight-saving shifts."""
    return F.unix_date(date.cast("date"))


def month_start(date: Column) -> Column:
    return F.trunc(date.cast("date"), "month")


def month_key(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def days_between(start: Column, end: Column) -> Column:
    """Days from start to end; null when either is missing."""
    return F.datediff(end, start)
