"""Item-to-item cosine similarity over shared users.

A user with n items makes n²/2 pairs, most of which miss a limit on shared users. With a limit of m, pairs are built
without each item's m - 1 busiest raters, as far as those are busy users: put a pair's shared users in order of their
items; the one with the fewest has at least m - 1 shared users above it, so it is none of the m - 1 busiest raters of
either item and still finds the pair. What the busy raters left out add to a pair is looked up for the pairs found.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtable.operators.hotkeys import hot_keys
from loomtable.operators.windows import top_n_per_group
from loomtable.session import scratch_path

#: Mean number of items in a bucket. Pairs are built between two buckets of a user at a time.
BUCKET_ITEMS = 500
#: Ratings whose pairs one task builds, and the share of them that a hash picks to estimate how many there are.
TASK_RATINGS, PICKED = 250_000, 256


def _pair_sums(pairs: DataFrame) -> DataFrame:
    """Products of the two ratings added up per item pair."""
    x, y = F.col("x"), F.col("y")
    return pairs.groupBy("item1", "item2").agg(
        F.count("*").alias("num_pairs"),
        F.sum(x * x).alias("sum_xx"), F.sum(y * y).alias("sum_yy"), F.sum(x * y).alias("sum_xy"),
    )


def cosine() -> Column:
    """Cosine from the sums; zero when a side has no weight."""
    weight = F.sqrt("sum_xx") * F.sqrt("sum_yy")
    return F.when(weight != 0, F.col("sum_xy") / weight).otherwise(0.0)


def _scored(sums: DataFrame, min_pairs: int, min_score: float | None) -> DataFrame:
    scored = sums.filter(F.col("num_pairs") >= min_pairs).select(
        "item1", "item2", cosine().alias("score"), "num_pairs"
    )
    return scored if min_score is None else scored.filter(F.col("score") > min_score)


def _sized(ratings: DataFrame) -> DataFrame:
    """Ratings with the number of their user's items."""
    return ratings.join(ratings.groupBy("_user").agg(F.count("*").alias("_items")), "_user")


def _in_units(sized: DataFrame, bucket: int) -> DataFrame:
    """Each rating once for every unit it takes part in: a unit is a user and two of the user's buckets.

    A user has one bucket for each ``bucket`` items, so users with fewer have one unit and their rows stay single.
    """
    buckets = F.ceil(F.col("_items") / bucket)
    placed = sized.withColumn("_own", F.pmod(F.xxhash64("_item"), buckets))
    others = F.explode(F.sequence(F.lit(0).cast("bigint"), buckets - 1))
    return placed.select("*", others.alias("_other")).select(
        "_user", F.least("_own", "_other").alias("_low"), F.greatest("_own", "_other").alias("_high"),
        "_own", "_item", "_rating",
    )


def _tasks(ratings: DataFrame) -> int | None:
    """Tasks to build pairs in, so that what one holds does not grow with the ratings; None where these are few."""
    picked = ratings.filter(F.pmod(F.xxhash64("_user", "_item"), F.lit(PICKED)) == 0).count()
    wanted = math.ceil(picked * PICKED / TASK_RATINGS)
    return max(wanted, ratings.sparkSession.sparkContext.defaultParallelism) if wanted > 1 else None


def _same_user_pairs(sized: DataFrame, bucket: int, tasks: int | None = None) -> DataFrame:
    """Unordered item pairs of each user, as (item1 < item2, x, y), each built in one unit."""
    unit = ["_user", "_low", "_high"]
    rows = _in_units(sized, bucket)
    if tasks:
        rows = rows.repartition(tasks, *unit)
    a = rows.select(*unit, F.col("_own").alias("_own1"), F.col("_item").alias("item1"), F.col("_rating").alias("x"))
    b = rows.select(*unit, F.col("_own").alias("_own2"), F.col("_item").alias("item2"), F.col("_rating").alias("y"))
    # In a unit of two buckets only pairs across them count; pairs within one have a unit of their own.
    here = (F.col("_low") == F.col("_high")) | (F.col("_own1") != F.col("_own2"))
    return a.join(b, unit).filter((F.col("item1") < F.col("item2")) & here)


def _without_busiest(sized: DataFrame, min_pairs: int, bucket: int) -> tuple[DataFrame, DataFrame]:
    """Sized ratings less those left out, and the ratings left out: those of each item's ``min_pairs`` - 1 busiest
    raters that have more than ``bucket`` items. The latter are written once, as both need them."""
    busiest = [F.desc("_items"), F.desc("_user")]
    path = scratch_path(sized.sparkSession, "busiest")
    top_n_per_group(sized.filter(F.col("_items") > bucket), ["_item"], busiest, min_pairs - 1).write.parquet(path)
    left_out = sized.sparkSession.read.parquet(path)
    return sized.join(left_out.select("_item", "_user"), ["_item", "_user"], "left_anti"), left_out


def _pruned_sums(ratings: DataFrame, min_pairs: int, bucket: int) -> DataFrame:
    """The sums of all pairs that can have ``min_pairs`` shared users."""
    known = ratings.groupBy("_item").agg(F.count("*").alias("_raters")).filter(F.col("_raters") >= min_pairs)
    sized = _sized(ratings).join(known.select("_item"), "_item", "left_semi")
    if hot_keys(ratings, ["_user"], ["_item"], bucket) is None:
        return _pair_sums(_same_user_pairs(sized, bucket, _tasks(ratings)))  # hardly anybody to leave out
    kept, left_out = _without_busiest(sized, min_pairs, bucket)
    # Written once: the pairs found are needed for their sums and for what the busiest raters add.
    path = scratch_path(ratings.sparkSession, "pairs")
    _pair_sums(_same_user_pairs(kept, bucket, _tasks(ratings))).write.parquet(path)
    found = ratings.sparkSession.read.parquet(path)

    def side(rows: DataFrame, item: str, value: str) -> DataFrame:
        return rows.select(F.col("_item").alias(item), "_user", F.col("_rating").alias(value))

    pairs = found.select("item1", "item2")
    first = pairs.join(side(left_out, "item1", "x"), "item1").join(side(ratings, "item2", "y"), ["item2", "_user"])
    second = pairs.join(side(left_out, "item2", "y"), "item2").join(side(kept, "item1", "x"), ["item1", "_user"])
    more = _pair_sums(first.select("item1", "item2", "x", "y").unionByName(
        second.select("item1", "item2", "x", "y")))
    sums = [c for c in found.columns if c not in ("item1", "item2")]
    return found.unionByName(more).groupBy("item1", "item2").agg(*[F.sum(c).alias(c) for c in sums])


def item_similarity(
    df: DataFrame,
    user: str,
    item: str,
    rating: str,
    min_pairs: int = 1,
    min_score: float | None = None,
    bucket: int = BUCKET_ITEMS,
) -> DataFrame:
    """Cosine of the ratings of two items over the users who rated both.

    Expects one row per (user, item). Returns ``item1 < item2``, ``score`` and
    ``num_pairs`` for pairs with at least ``min_pairs`` common users and, if given, a
    score above ``min_score``.

    A user's items are cut into buckets of about ``bucket`` items and paired bucket with bucket, so that no key of
    the join has more than about twice as many rows, whatever the user's size. Pairs are added up map-side, in more
    tasks the more ratings there are for ``min_pairs`` above 1 (a small job estimates how many). For
    ``min_pairs`` above 1, items with fewer raters go first. If there are busy users, which a small job finds out, each
    item's busiest raters take no part in building pairs, and the pairs found are written to the scratch folder.
    """
    ratings = df.select(
        F.col(user).alias("_user"), F.col(item).alias("_item"),
        F.col(rating).cast("double").alias("_rating"),
    ).filter(F.col("_user").isNotNull() & F.col("_item").isNotNull())
    if min_pairs > 1:
        return _scored(_pruned_sums(ratings, min_pairs, bucket), min_pairs, min_score)
    return _scored(_pair_sums(_same_user_pairs(_sized(ratings), bucket)), min_pairs, min_score)


def similar_items(
    df: DataFrame,
    user: str,
    item: str,
    rating: str,
    target,
    min_pairs: int = 1,
    min_score: float | None = None,
) -> DataFrame:
    """Items similar to one target item: ``similar_item``, ``score``, ``num_pairs``.

    Only the target's users are paired, so the work is linear in their ratings.
    """
    ratings = df.select(
        F.col(user).alias("_user"), F.col(item).alias("_item"),
        F.col(rating).cast("double").alias("_rating"),
    )
    mine = ratings.filter(F.col("_item") == target).select("_user", F.col("_rating").alias("x"))
    others = ratings.filter(F.col("_item") != target).select(
        "_user", F.col("_item").alias("item2"), F.col("_rating").alias("y")
    )
    pairs = others.join(mine, "_user").withColumn("item1", F.lit(target))
    return _scored(_pair_sums(pairs), min_pairs, min_score).select(
        F.col("item2").alias("similar_item"), "score", "num_pairs"
    )
