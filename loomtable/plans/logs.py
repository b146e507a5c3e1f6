"""Access logs, application logs and web logs held as text lines in ``value``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtable.functions.text import access_fields, token, tokens


def parse_access_log(lines: DataFrame) -> DataFrame:
    """Fields of each access-log line; lines of another shape are dropped."""
    fields = F.split("fields", "\n")
    names = ("ip_address", "method", "endpoint", "protocol")
    return lines.select(F.explode(access_fields(F.col("value"))).alias("fields")).select(
        *[F.get(fields, F.lit(i)).alias(n) for i, n in enumerate(names, 1)],
        F.get(fields, F.lit(5)).try_cast("int").alias("status"),
    )


def requests_by(parsed: DataFrame, column: str, name: str) -> DataFrame:
    """Requests per value of a field, most frequent first."""
    counts = parsed.groupBy(column).agg(F.count("*").alias(name))
    return counts.orderBy(F.desc(name), column)


def parse_app_log(lines: DataFrame) -> DataFrame:
    """``date time LEVEL message`` lines as (level, message)."""
    line = F.col("value")
    return lines.select(
        token(line, 2, limit=4).alias("level"), token(line, 3, limit=4).alias("message")
    )


def messages(lines: DataFrame, level: str = "ERROR") -> DataFrame:
    """Messages of one log level."""
    return parse_app_log(lines).filter(F.col("level") == level).select("message")


def error_words(lines: DataFrame, prefix: str = "ERROR") -> DataFrame:
    """Upper-cased words of the lines that start with a prefix."""
    hit = lines.filter(F.col("value").startswith(prefix))
    return hit.select(F.explode(tokens(F.upper("value"))).alias("word"))


def successful_endpoints(lines: DataFrame, status: str = "200") -> DataFrame:
    """``ip method endpoint status time`` lines: requests per endpoint with a status."""
    line = F.col("value")
    fields = lines.select(token(line, 2).alias("endpoint"), token(line, 3).alias("_status"))
    return requests_by(fields.filter(F.col("_status") == status), "endpoint", "requests")
