"""Hot keys worked on in blocks must give what the plain operators give."""

import random
from collections import defaultdict
from datetime import datetime, timedelta
from itertools import combinations
from math import sqrt

import pytest
from pyspark.sql import functions as F

from loomtable.operators import similarity, windows
from loomtable.operators.hotkeys import BLOCK, in_blocks
from loomtable.operators.similarity import item_similarity, similar_items


@pytest.fixture(scope="module")
def events(spark):
    """A third of all rows belong to user 1, another third to the null user."""
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    data = []
    for i in range(600):
        user = (1, None, rng.randint(2, 40))[i % 3]
        ts = start + timedelta(seconds=rng.randrange(0, 5 * 86400, 240))
        value = None if i % 11 == 0 else rng.randint(-50, 50)
        data.append((i, user, ts, value))
    return spark.createDataFrame(data, "id INT, user INT, ts TIMESTAMP, value INT").cache()


def check(events, rows, operator, columns):
    """The operator with a bound at every row, with some blocks per hot user, and without blocks."""
    plain = rows(operator(10**9), *columns)
    assert rows(operator(40), *columns) == plain
    assert rows(operator(1), *columns) == plain
    assert len(plain) == events.count()
    return plain


def test_blocks(spark, events):
    cold, hot = in_blocks(events, ["user"], ["ts", "id"], 25)
    assert cold.count() + hot.count() == events.count()
    for user in (1, None):
        got = [(r[BLOCK], r.ts, r.id) for r in hot.filter(F.col("user").eqNullSafe(user)).collect()]
        assert len({b for b, _, _ in got}) > 3
        by_place = sorted(got, key=lambda g: g[1:])
        assert [b for b, _, _ in by_place] == sorted(b for b, _, _ in by_place)
    assert in_blocks(events, ["user"], ["ts", "id"], 10**9)[1] is None


def test_no_block_holds_a_whole_hot_group(spark):
    """One user, one second, one value: the tie-break splits it."""
    same = spark.range(20_000).select(F.lit(1).alias("user"), F.lit(5).alias("value"), "id")
    _, hot = in_blocks(same, ["user"], ["value", "id"], 100)
    largest = hot.groupBy(BLOCK).count().agg(F.max("count")).first()[0]
    assert hot.count() == 20_000
    assert largest < 2_000
    ranked = windows.rank_compare(same, ["user"], "value", ["id"], 100)
    assert ranked.filter((F.col("rank") == 1) & (F.col("dense_rank") == 1)
                         & (F.col("row_number") == F.col("id") + 1)).count() == 20_000


def test_jobs_while_a_query_is_built(spark, events):
    """Looking for hot keys is a small job; the others build a plan only."""
    tracker = spark.sparkContext.statusTracker()

    def jobs(name, build):
        spark.sparkContext.setJobGroup(name, "")
        build()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(name))

    assert jobs("ties", lambda: windows.top_with_ties(events, ["user"], "value")) == 0
    rated = events.withColumn("rating", F.lit(1.0))
    assert jobs("similar", lambda: item_similarity(rated, "user", "id", "rating")) == 0
    assert jobs("total", lambda: windows.running_total(events, ["user"], ["ts", "id"], "value")) <= 4  # head() looks at some partitions first


def test_plan_without_hot_keys_is_the_plain_window(spark, events):
    text = windows.running_total(events, ["user"], ["ts", "id"], "value")._jdf.queryExecution().toString()
    assert "Window" in text and "Join" not in text and "Union" not in text


def test_many_blocks_of_one_key(spark):
    """Two thousand blocks give what one window gives."""
    same = spark.range(40_000).select(F.lit(1).alias("user"), (F.col("id") * 7919 % 40_000).alias("at"),
                                      (F.col("id") % 101).alias("value"))
    totals = windows.running_total(same, ["user"], ["at"], "value", step=20)
    plain = windows.running_total(same, ["user"], ["at"], "value")
    assert totals.exceptAll(plain).isEmpty() and totals.count() == 40_000
    _, hot = in_blocks(same, ["user"], ["at"], 20)
    assert 1000 < hot.select(BLOCK).distinct().count() < 4000


def test_running_total(events, rows):
    got = check(events, rows, lambda hot: windows.running_total(
        events, ["user"], ["ts", "id"], "value", step=hot), ["id", "running_total"])
    totals, want = defaultdict(lambda: None), []
    for r in sorted(events.collect(), key=lambda r: (r.ts, r.id)):
        if r.value is not None:
            totals[r.user] = (totals[r.user] or 0) + r.value
        want.append((r.id, totals[r.user]))
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_neighbours(events, rows):
    got = check(events, rows, lambda hot: windows.neighbours(
        events, ["user"], ["ts", "id"], "value", step=hot), ["id", "previous", "next", "difference"])
    per_user, want = defaultdict(list), []
    for r in sorted(events.collect(), key=lambda r: (r.ts, r.id)):
        per_user[r.user].append(r)
    for group in per_user.values():
        for i, r in enumerate(group):
            before = group[i - 1].value if i else None
            after = group[i + 1].value if i + 1 < len(group) else None
            gap = None if None in (r.value, before) else r.value - before
            want.append((r.id, before, after, gap))
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_sessions(events, rows):
    got = check(events, rows, lambda hot: windows.sessionize(
        events, "user", "ts", step=hot), ["id", "session_number", "session_id"])
    last, number, want = {}, defaultdict(int), {}
    for r in sorted(events.collect(), key=lambda r: (r.ts, r.id)):
        if r.user not in last or (r.ts - last[r.user]).total_seconds() > 1800:
            number[r.user] += 1
        last[r.user] = r.ts
        want[r.id] = number[r.user]
    assert {i: n for i, n, _ in got} == want


def test_session_gap_across_blocks(spark, rows):
    """A session that runs over midnight stays one session."""
    at = [datetime(2024, 1, 1, 23, 50), datetime(2024, 1, 2, 0, 20), datetime(2024, 1, 2, 0, 50, 1)]
    df = spark.createDataFrame([(1, t) for t in at], "user INT, ts TIMESTAMP")
    for hot in (1, 100):
        assert rows(windows.sessionize(df, "user", "ts", step=hot), "session_number") == [(1,), (1,), (2,)]


def test_ranks(events, rows):
    df = events.withColumn("amount", F.col("value"))
    check(events, rows, lambda hot: windows.rank_compare(
        df, ["user"], "amount", ["id"], step=hot),
        ["id", "row_number", "rank", "dense_rank"])


def test_ties(events, rows):
    want = []
    for user in {r.user for r in events.collect()}:
        group = [r for r in events.collect() if r.user == user]
        top = max((r.value for r in group if r.value is not None), default=None)
        want += [(r.id, r.value) for r in group if r.value == top]
    got = rows(windows.top_with_ties(events, ["user"], "value"), "id", "value")
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_rolling(events, rows):
    got = {r.id: r.rolling_average for r in windows.rolling_days(events, ["user"], "ts", "value", 3).collect()}
    data = events.collect()
    for r in data:
        span = [o.value for o in data if o.user == r.user and o.value is not None
                and 0 <= (r.ts.date() - o.ts.date()).days <= 2]
        assert got[r.id] == (sum(span) / len(span) if span else None)


def brute_similarity(data, min_pairs, min_score):
    by_user = defaultdict(dict)
    for u, i, r in data:
        by_user[u][i] = r
    sums = defaultdict(lambda: [0, 0.0, 0.0, 0.0])
    for items in by_user.values():
        for a, b in combinations(sorted(items), 2):
            s, x, y = sums[a, b], items[a], items[b]
            s[0] += 1
            s[1] += x * x
            s[2] += y * y
            s[3] += x * y
    out = {}
    for pair, (n, xx, yy, xy) in sums.items():
        weight = sqrt(xx) * sqrt(yy)
        score = xy / weight if weight else 0.0
        if n >= min_pairs and (min_score is None or score > min_score):
            out[pair] = (round(score, 9), n)
    return out


@pytest.fixture(scope="module")
def skewed_ratings():
    """Users 0..3 rated nearly everything, the others a handful."""
    rng = random.Random(3)
    data = [(u, i, float(rng.randint(0, 5))) for u in range(4) for i in range(40) if rng.random() < 0.8]
    data += [(u, i, float(rng.randint(0, 5))) for u in range(4, 40) for i in rng.sample(range(40), 4)]
    return data


@pytest.mark.parametrize("min_pairs", [1, 2, 3, 5])
@pytest.mark.parametrize("min_score", [None, 0.8])
def test_similarity_with_busy_users(spark, skewed_ratings, min_pairs, min_score):
    df = spark.createDataFrame(skewed_ratings, "u INT, i INT, r DOUBLE")
    want = brute_similarity(skewed_ratings, min_pairs, min_score)
    for bucket in (3, 10, 1000):
        got = item_similarity(df, "u", "i", "r", min_pairs, min_score, bucket)
        assert {(p.item1, p.item2): (round(p.score, 9), p.num_pairs) for p in got.collect()} == want


def test_similar_to_one_item(spark, skewed_ratings):
    df = spark.createDataFrame(skewed_ratings, "u INT, i INT, r DOUBLE")
    want = {a + b - 7: v for (a, b), v in brute_similarity(skewed_ratings, 2, 0.5).items() if 7 in (a, b)}
    got = similar_items(df, "u", "i", "r", 7, min_pairs=2, min_score=0.5)
    assert {p.similar_item: (round(p.score, 9), p.num_pairs) for p in got.collect()} == want


def test_a_hot_user_makes_no_pairs_that_the_limit_rules_out(spark):
    """One user rated 400 items, which two others rated a few of: 79,800 pairs, of which few can have two raters."""
    rng = random.Random(4)
    data = [(0, i, 1.0) for i in range(400)]
    data += [(u, i, 2.0) for u in range(1, 30) for i in rng.sample(range(400), 6)]
    df = spark.createDataFrame(data, "_user INT, _item INT, _rating DOUBLE")
    everything = similarity._same_user_pairs(similarity._sized(df), 50).count()
    kept, left_out = similarity._without_busiest(similarity._sized(df), 2, 50)
    built = similarity._same_user_pairs(kept, 50).count()
    assert everything > 79_800 and built < 500
    assert left_out.select("_user").distinct().collect() == [(0,)]
    got = item_similarity(df, "_user", "_item", "_rating", min_pairs=2, bucket=50)
    assert {(p.item1, p.item2): (round(p.score, 9), p.num_pairs) for p in got.collect()} == brute_similarity(data, 2, None)


def test_pairs_are_built_in_more_tasks_the_more_ratings_there_are(spark, monkeypatch):
    from loomtable.operators import similarity

    monkeypatch.setattr(similarity, "TASK_RATINGS", 100)
    monkeypatch.setattr(similarity, "PICKED", 4)
    made = spark.range(12_000).selectExpr("id div 4 AS u", "(id * 7919) % 997 AS i", "id % 5 AS r").distinct()
    ratings = made.selectExpr("u AS _user", "i AS _item", "r AS _rating")
    tasks = similarity._tasks(ratings)
    assert 90 < tasks < 150 and similarity._tasks(ratings.limit(0)) is None
    pairs = similarity._same_user_pairs(similarity._sized(ratings), 500, tasks)
    assert pairs.rdd.getNumPartitions() == tasks
    want = made.alias("a").join(made.alias("b"), "u").filter("a.i < b.i").groupBy("a.i", "b.i").count().count()
    assert similarity.item_similarity(made, "u", "i", "r").count() == want
