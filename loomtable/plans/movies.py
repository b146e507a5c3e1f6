"""Rating counts and similar titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtable import schemas
from loomtable.functions.cleaning import strict_long
from loomtable.operators.joins import lookup_with_default
from loomtable.operators.similarity import similar_items
from loomtable.sources import read_with_ids


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated user, movie, rating, timestamp. An id beyond 64 bits is an error."""
    return read_with_ids(spark, path, schemas.RATINGS, ["user_id", "movie_id"], sep="\t")


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-separated, ISO-8859-1 titles: the first two fields are id and name. An id beyond 64 bits is an error."""
    raw = spark.read.csv(path, sep="|", encoding="ISO-8859-1")
    return raw.select(strict_long(F.col("_c0")).alias("movie_id"), F.col("_c1").alias("movie_name"))


def most_rated(ratings: DataFrame, titles: DataFrame) -> DataFrame:
    """Ratings per movie with its title, most rated first."""
    counts = ratings.groupBy("movie_id").agg(F.count("*").alias("rating_count"))
    named = lookup_with_default(counts, titles, "movie_id", "movie_name", "unknown")
    return named.orderBy(F.desc("rating_count"), "movie_id")


def similar_titles(
    ratings: DataFrame,
    titles: DataFrame,
    movie_id: int,
    min_pairs: int = 51,
    min_score: float = 0.97,
    n: int = 10,
) -> DataFrame:
    """Titles most similar to one movie: high score over enough common raters."""
    found = similar_items(ratings, "user_id", "movie_id", "rating", movie_id, min_pairs, min_score)
    best = [F.desc("score"), F.desc("num_pairs"), F.asc("similar_item")]
    return (
        found.join(titles, found.similar_item == titles.movie_id)
        .orderBy(*best).limit(n)
        .select("movie_name", "score", "num_pairs")
    )
