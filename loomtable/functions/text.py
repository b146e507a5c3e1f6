"""Tokens, hashtags and log lines."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The token, hashtag and log-line patterns. ``(?U)`` gives the
# Unicode meaning of ``\w``; inside a word a backtick joins, an apostrophe splits.
WORD = r"(?U)\b\w+(?:`\w+)*\b"
HASHTAG = r"(?U)#\w+"
ACCESS_LINE = r'^(\S+) \S+ \S+ \[[^\]]+\] "(\S+) ([^ ]+) ([^"]+)" (\d{3})'


def words(text: Column) -> Column:
    """Lower-cased words of a text, by the word pattern."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def hashtags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(HASHTAG), F.lit(0))


def hashtag_count(text: Column) -> Column:
    """Number of hashtags as text; null for null or empty text."""
    return F.when(text != "", F.regexp_count(text, F.lit(HASHTAG)).cast("string"))


def tokens(text: Column) -> Column:
    """Blank-separated tokens, without empty ones at either end."""
    return F.array_remove(F.split(text, r"\s+"), "")


def token(text: Column, index: int, sep: str = " ", limit: int = -1) -> Column:
    """Token at a position, null when the line is too short."""
    return F.get(F.split(text, sep, limit), F.lit(index))


def access_fields(line: Column) -> Column:
    """An array that holds the five fields of an access-log line, each after a line break, or nothing.

    The pattern runs once a line: a line of another shape stays without a break at its start and is left out.
    """
    marked = F.regexp_replace(line, f"{ACCESS_LINE}.*$", "\n$1\n$2\n$3\n$4\n$5")
    return F.filter(F.array(marked), lambda x: x.startswith("\n"))


def register_functions(spark: SparkSession) -> None:
    """Make ``count_hashtags`` and the table function ``HashtagExtractor`` callable in SQL.

    Both are SQL-bodied functions, so the optimizer inlines them and no Python worker runs.
    """
    pattern = HASHTAG.replace("\\", "\\\\")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION count_hashtags(text STRING) RETURNS STRING "
        f"RETURN CASE WHEN text <> '' THEN CAST(regexp_count(text, '{pattern}') AS STRING) END"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION HashtagExtractor(text STRING) "
        "RETURNS TABLE(hashtag STRING) "
        f"RETURN SELECT explode(regexp_extract_all(text, '{pattern}', 0))"
    )
