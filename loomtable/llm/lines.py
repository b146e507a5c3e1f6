"""Removal of lines that a site repeats on a large share of its pages.

For each host, the pages that contain a line are divided by the host's page total; a line above the ratio, and on
``min_repeats`` pages or more, is boilerplate and goes from every page of that host. Pages with the same text count
once, in both numbers: copies of a page say nothing about boilerplate, and removing copies is another operator's work.

Counting moves hashes only. (host, line) counts combine map-side, so a hot line or host costs each task one row. A host
has at most (mean lines a page / ratio) boilerplate lines, whatever its size; they return to the pages as one array
per host, and that join deals the pages of every host over SALTS tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: Tasks over which the pages of one host are dealt.
SALTS = 64
#: Different pages that a boilerplate line is on at least. On a small host the ratio alone is met by one or two pages.
MIN_REPEATS = 5


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _blank(line: Column) -> Column:
    return ~line.rlike(r"[^\x09-\x0D\x20]")


def boilerplate(
    pages: DataFrame, host: str, text: str, ratio: float, min_pages: int, min_repeats: int = MIN_REPEATS,
) -> DataFrame:
    """(host, line_hash, n_pages, host_pages) of the lines on more than ``ratio`` of a host's different pages, of
    which there must be ``min_pages`` or more, and on ``min_repeats`` of them or more."""
    page = pages.select(F.col(f"`{host}`").alias("host"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    hashed = F.transform(F.filter(_lines(F.col("text")), lambda x: ~_blank(x)), lambda x: F.xxhash64(x))
    once = page.select("host", F.xxhash64("text").alias("page"), F.array_distinct(hashed).alias("lines")).groupBy(
        "host", "page").agg(F.first("lines").alias("lines"))
    once = materialize(once, "line-pages")
    totals = once.groupBy("host").agg(F.count("*").alias("host_pages")).filter(F.col("host_pages") >= min_pages)
    counts = once.select("host", F.explode("lines").alias("line_hash")).groupBy("host", "line_hash").agg(
        F.count("*").alias("n_pages"))
    same = counts["host"].eqNullSafe(totals["host"])
    often = (F.col("n_pages") > F.lit(ratio) * F.col("host_pages")) & (F.col("n_pages") >= min_repeats)
    return counts.join(totals, same).filter(often).select(
        counts["host"], "line_hash", "n_pages", "host_pages")


def drop_boilerplate(
    pages: DataFrame, host: str, text: str, ratio: float = 0.1, min_pages: int = 5,
    min_repeats: int = MIN_REPEATS,
) -> DataFrame:
    """Columns ``row`` (the whole page as a struct), ``kept_text``, ``n_lines`` and ``n_dropped``.

    ``kept_text`` joins the lines that stay by line breaks; blank lines always stay. A null text stays null and has no
    lines; an empty one stays empty. Pages of a null host form a host of their own. Repeated rows are all kept.
    Extra columns stay inside ``row``, so none can clash.
    """
    marked = boilerplate(pages, host, text, ratio, min_pages, min_repeats).groupBy("host").agg(
        F.collect_set("line_hash").alias("marked"))
    marked = materialize(marked, "boilerplate").select(
        F.col("host").alias("at"), "marked", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("on"))
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns])
    rows = pages.select(row.alias("row"), F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    met = rows.join(marked, rows["host"].eqNullSafe(marked["at"]) & (rows["salt"] == marked["on"]), "left")
    lines = _lines(F.col("text"))
    kept = F.filter(lines, lambda x: _blank(x) | ~F.array_contains(F.col("marked"), F.xxhash64(x)))
    kept = F.when(F.col("marked").isNull(), lines).otherwise(kept)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long")
    return met.select("row", "text", lines.alias("lines"), kept.alias("kept")).select(
        "row", F.when(F.col("text").isNotNull(), F.array_join("kept", "\n")).alias("kept_text"),
        n_lines.alias("n_lines"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"))
