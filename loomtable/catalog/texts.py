"""Word counts, logs and hashtags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtable.catalog import query, table
from loomtable.functions.text import hashtag_count as tag_count
from loomtable.functions.text import hashtags, register_functions
from loomtable.plans import logs, words
from loomtable.sources import register_view


@query(r"""
SELECT word, count(*) AS count FROM (
  SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}\p{Pc}]+(?:`[\p{L}\p{M}\p{Nd}\p{Pc}]+)*')) AS word
  FROM documents)
GROUP BY word
""")
def word_count_tokens(spark, sf):
    return words.count_word_tokens(table(spark, sf, "documents"), "text")


@query(r"""
SELECT word, count(*) AS count FROM (
  SELECT lower(unnest(regexp_split_to_array(text, '[^0-9A-Za-z_]+'))) AS word FROM documents)
WHERE word <> '' GROUP BY word
""")
def word_count_split(spark, sf):
    return words.count_split_words(table(spark, sf, "documents"), "text")


@query("SELECT p_type AS word, count(*) AS count FROM part GROUP BY p_type")
def word_count_literal(spark, sf):
    return words.count_literal_words(table(spark, sf, "part"), "p_type")


IP = "'10.0.' || (user_id // 256) || '.' || (user_id % 256)"
STATUS = "CASE WHEN event_type = 'error' THEN 500 WHEN value > 200 THEN 404 ELSE 200 END"
ENDPOINT = "'/' || event_type || '/' || CAST(floor(value / 100) AS BIGINT)"


def _event_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Events with the address, endpoint and status that the log lines show."""
    user, value = F.col("user_id"), F.col("value")
    return table(spark, sf, "events").select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.concat_ws(".", F.lit("10.0"), F.floor(user / 256), F.pmod(user, F.lit(256))).alias("ip"),
        F.concat_ws("/", F.lit(""), "event_type", F.floor(value / 100)).alias("endpoint"),
        F.when(F.col("event_type") == "error", "500").when(value > 200, "404").otherwise("200").alias("status"),
    )


def access_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Access-log lines of the events; sign-ups are written as lines of another shape."""
    line = F.format_string(
        '%s - - [%s] "GET %s HTTP/1.1" %s 512', "ip",
        F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss +0000"), "endpoint", "status",
    )
    junk = F.concat(F.lit("-- rotated by "), F.col("user_id").cast("string"))
    return _event_fields(spark, sf).select(
        F.when(F.col("event_type") == "signup", junk).otherwise(line).alias("value")
    )


@query(f"""
SELECT {IP} AS ip_address, count(*) AS request_count FROM events WHERE event_type <> 'signup' GROUP BY 1
""")
def access_log_ip(spark, sf):
    return logs.requests_by(logs.parse_access_log(access_lines(spark, sf)), "ip_address", "request_count")


@query(f"""
SELECT {ENDPOINT} AS endpoint, count(*) AS endpoint_count FROM events WHERE event_type <> 'signup' GROUP BY 1
""")
def access_log_endpoint(spark, sf):
    return logs.requests_by(logs.parse_access_log(access_lines(spark, sf)), "endpoint", "endpoint_count")


@query(f"""
SELECT CAST({STATUS} AS INTEGER) AS status, count(*) AS status_count
FROM events WHERE event_type <> 'signup' GROUP BY 1
""")
def access_log_status(spark, sf):
    return logs.requests_by(logs.parse_access_log(access_lines(spark, sf)), "status", "status_count")


LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END"


def app_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``date time LEVEL message`` lines."""
    kind = F.col("event_type")
    level = (
        F.when(kind == "error", "ERROR").when(kind == "signup", "WARN")
        .when(kind == "view", "DEBUG").otherwise("INFO")
    )
    return _event_fields(spark, sf).select(F.concat_ws(
        " ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), level, F.lit("User"), "user_id", F.lit("did"), kind
    ).alias("value"))


@query(f"SELECT {LEVEL} AS level, count(*) AS lines FROM events GROUP BY 1")
def log_levels(spark, sf):
    return logs.parse_app_log(app_lines(spark, sf)).groupBy("level").agg(F.count("*").alias("lines"))


@query("SELECT 'User ' || user_id || ' did error' AS message FROM events WHERE event_type = 'error'")
def error_messages(spark, sf):
    return logs.messages(app_lines(spark, sf), "ERROR")


@query("""
SELECT word, count(*) AS n FROM (
  SELECT unnest(['ERROR:', 'USER', CAST(user_id AS VARCHAR), 'FAILED']) AS word
  FROM events WHERE event_type = 'error')
GROUP BY word
""")
def error_words(spark, sf):
    label = F.concat(F.upper("event_type"), F.lit(":"))
    lines = table(spark, sf, "events").select(
        F.concat_ws(" ", label, F.lit("User"), F.lit(""), "user_id", F.lit("failed")).alias("value")
    )
    return logs.error_words(lines).groupBy("word").agg(F.count("*").alias("n"))


@query(f"""
SELECT {ENDPOINT} AS endpoint, count(*) AS requests FROM events WHERE {STATUS} = 200 GROUP BY 1
""")
def web_log_endpoints(spark, sf):
    lines = _event_fields(spark, sf).select(
        F.concat_ws(" ", "ip", F.lit("GET"), "endpoint", "status", F.lit("120ms")).alias("value")
    )
    return logs.successful_endpoints(lines)


TWEETS = """
tweets AS (
  SELECT event_id, CASE WHEN value < 5 THEN 'nothing to see' WHEN event_type = 'signup' THEN NULL
         ELSE 'saw #' || event_type || ' by #u' || user_id || ' (#é' || event_id || ')' END AS text
  FROM events)
"""
TAGS = r"regexp_extract_all(text, '#[\p{L}\p{M}\p{Nd}\p{Pc}]+')"


def tweets(spark: SparkSession, sf: str) -> DataFrame:
    """Short texts with two or three hashtags, some without, some missing."""
    kind = F.col("event_type")
    tagged = F.concat(
        F.lit("saw #"), kind, F.lit(" by #u"), F.col("user_id").cast("string"),
        F.lit(" (#é"), F.col("event_id").cast("string"), F.lit(")"),
    )
    text = F.when(F.col("value") < 5, "nothing to see").when(kind == "signup", None).otherwise(tagged)
    return table(spark, sf, "events").select("event_id", text.alias("text"))


@query(f"WITH {TWEETS} SELECT event_id, CAST(len({TAGS}) AS VARCHAR) AS num_hashtags FROM tweets")
def hashtag_count(spark, sf):
    return tweets(spark, sf).select("event_id", tag_count(F.col("text")).alias("num_hashtags"))


@query(f"WITH {TWEETS} SELECT event_id, unnest({TAGS}) AS hashtag FROM tweets")
def hashtag_explode(spark, sf):
    return tweets(spark, sf).select("event_id", F.explode(hashtags(F.col("text"))).alias("hashtag"))


@query(f"WITH {TWEETS} SELECT text, CAST(len({TAGS}) AS VARCHAR) AS num_hashtags FROM tweets")
def udf_registered(spark, sf):
    register_functions(spark)
    return tweets(spark, sf).selectExpr("text", "count_hashtags(text) AS num_hashtags")


@query(f"WITH {TWEETS} SELECT text, unnest({TAGS}) AS hashtag FROM tweets")
def udtf_lateral(spark, sf):
    register_functions(spark)
    view = register_view(tweets(spark, sf), "tweets")
    found = spark.sql(f"SELECT text, hashtag FROM {view}, LATERAL HashtagExtractor(text)")
    spark.catalog.dropTempView(view)  # the rows don't need it any more
    return found
