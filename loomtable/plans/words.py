"""Word counts over a text column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtable.functions.text import words


def _counted(words_df: DataFrame) -> DataFrame:
    counts = words_df.groupBy("word").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "word")


def count_word_tokens(df: DataFrame, column: str = "value") -> DataFrame:
    """Count words found by the word pattern."""
    return _counted(df.select(F.explode(words(F.col(column))).alias("word")))


def count_split_words(df: DataFrame, column: str = "value") -> DataFrame:
    """Count what stands between runs of non-word characters, in lower case."""
    parts = df.select(F.explode(F.split(F.col(column), r"\W+")).alias("part"))
    return _counted(parts.filter(F.col("part") != "").select(F.lower("part").alias("word")))


def count_literal_words(df: DataFrame, column: str = "value") -> DataFrame:
    """Count whole values."""
    return _counted(df.select(F.col(column).alias("word")))
