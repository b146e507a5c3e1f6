"""The registered queries: each operator with production parameters over its whole table, in the agreed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontamination,
    filter_audit,
    language_model,
    lines,
    packing,
    pages,
    pii,
    repetition,
    secret_scan,
    sharding,
    simhash,
    spelling,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Names of the shards that documents are placed on.
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(key: Column) -> Column:
    """crc32 of an id written as text."""
    return F.crc32(key.cast("string").cast("binary"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'"


@query(rf"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {A_TO_Z}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n,
         array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {A_TO_Z}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
spot AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT spot.doc_id, spot.i, spot.n, win.item_id FROM spot JOIN win ON spot.n = win.n AND spot.k = win.k),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                 sha256(string_agg(DISTINCT item_id::varchar, ',' ORDER BY item_id::varchar)) AS s
          FROM hit GROUP BY doc_id)
SELECT doc.doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit,
       coalesce(n_items, 0)::bigint AS n_items, coalesce(s, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.overlaps(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "text", "item_id", "text", 10, ["doc_id"])
    n_hit = F.aggregate("out.hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select("row.doc_id", "out.n_words", n_hit.alias("n_hit"), F.col("out.items").alias("items")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query()
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), "text", ["doc_id"], tokenizer_path())
    return packed.select("row.doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32",
                         "sequence_id", "offset")


@query()
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), ["doc_id"], SHARDS)
    return placed.select("row.doc_id", "row.source", "row.n_chars", "slot", "shard")


@query()
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), "text", "doc_id", keep=["doc_id"])
    return found.select("row.doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


@query()
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.personal_data(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    counts = [F.size(F.array_remove(F.transform("base", lambda x: x["kind"]), i)) for i in range(len(pii.KINDS))]
    counts = [(F.size("base") - n).cast("long").alias(f"n_{k}") for n, k in zip(counts, pii.KINDS, strict=True)]
    return out.select("row.doc_id", *counts, F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"),
                      pii.written(F.col("spans")).alias("spans"))


@query()
def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = language_model.score_texts(docs, "text", id_crc(F.col("doc_id")) % 10 == 0, ["doc_id"])
    return out.select("row.doc_id", "held_out", *[f"out.{c}" for c in (
        "n_tokens", "n_known", "train_tokens", "base_score", "score")])


@query()
def op7_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repetition.repetition_rules(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    return out.select("row.doc_id", *[f"out.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


@query(r"""
WITH page AS (SELECT DISTINCT source, coalesce(text, '') AS t FROM documents),
total AS (SELECT source, count(*) AS n FROM page GROUP BY source),
line AS (SELECT DISTINCT source, t, unnest(string_split(t, chr(10))) AS l FROM page),
marked AS (
  SELECT line.source, l FROM line JOIN total ON line.source IS NOT DISTINCT FROM total.source
  WHERE regexp_matches(l, '[^\x09-\x0D\x20]')
  GROUP BY line.source, l, n HAVING count(*) > 0.1 * n AND count(*) >= 5),
doc AS (SELECT row_number() OVER () AS r, * FROM documents),
parts AS (SELECT r, source, unnest(string_split(text, chr(10))) AS l,
                 unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM doc),
kept AS (SELECT parts.r, count(*) AS n_lines, count(*) FILTER (m.l IS NOT NULL) AS n_dropped,
                coalesce(string_agg(parts.l, chr(10) ORDER BY i) FILTER (m.l IS NULL), '') AS t
         FROM parts LEFT JOIN marked m ON parts.source IS NOT DISTINCT FROM m.source AND parts.l = m.l GROUP BY parts.r)
SELECT doc_id, t AS text, coalesce(n_lines, 0)::bigint AS n_lines, coalesce(n_dropped, 0)::bigint AS n_dropped
FROM doc LEFT JOIN kept USING (r)
""")
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return lines.drop_boilerplate(docs, "source", "text").select(
        "row.doc_id", F.col("kept_text").alias("text"), "n_lines", "n_dropped")


@query()
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pages.main_texts(table(spark, sf_dir, "pages"), "url", "html", ["page_id", "url"])
    return out.select("row.page_id", "row.url", "text", "n_chars")


@query()
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), "text", "doc_id", "toxic", id_crc(F.col("k")) % 4 != 2)
    return toxicity.score_texts(docs, "text", model, ["doc_id"]).select(
        "row.doc_id", (id_crc(F.col("row.doc_id")) % 4 == 2).alias("held_out"), "out.score",
        (F.col("out.score") >= 0.3).cast("int").alias("predicted"), F.size("out.segments").alias("n_segments"))


@query(r"""
WITH one AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
first AS (SELECT t, min(doc_id) AS first_id FROM one GROUP BY t),
label AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS tox
          FROM labels GROUP BY doc_id),
doc AS (
  SELECT part, coalesce(good, false) AS good, coalesce(tox, false) AS tox,
         (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int
         + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t))::int
         + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > first_id, false)::int AS fails
  FROM (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM one) JOIN first USING (t)
  LEFT JOIN label USING (doc_id)),
counts AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (tox) AS n_tox
           FROM doc GROUP BY part, fails),
subsets AS (
  SELECT part, s, coalesce(sum(n) FILTER (fails & s = 0), 0)::bigint AS n,
         coalesce(sum(n_good) FILTER (fails & s = 0), 0)::bigint AS g,
         coalesce(sum(n_tox) FILTER (fails & s = 0), 0)::bigint AS x
  FROM counts, (SELECT unnest(range(32)) AS s) GROUP BY part, s),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS o
           FROM letter a, letter b, letter c, letter d, letter e
           WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (
  SELECT o, step, (1 << (ascii(o[step]) - 65)) AS bit,
         list_sum([0] || list_transform(range(1, step), lambda i: 1 << (ascii(o[i]) - 65)))::bigint AS prior
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
walk AS (
  SELECT a.part, o AS filter_order, step, bit, b.n AS kept, a.n - b.n AS removed, z.n - y.n - (a.n - b.n) AS redundant,
         u.n - v.n AS unique_fails, a.g - b.g AS good_lost, a.x - b.x AS toxic_lost
  FROM steps JOIN subsets a ON a.s = prior JOIN subsets b ON b.part = a.part AND b.s = prior + bit
  JOIN subsets z ON z.part = a.part AND z.s = 0 JOIN subsets y ON y.part = a.part AND y.s = bit
  JOIN subsets u ON u.part = a.part AND u.s = 31 - bit JOIN subsets v ON v.part = a.part AND v.s = 31)
SELECT part, filter_order, step::int AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::bigint AS shapley
FROM walk
""")
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = filter_audit.text_failures(table(spark, sf_dir, "documents"), "text", "doc_id", "lang")
    marked = filter_audit.with_labels(failed, table(spark, sf_dir, "labels"), "doc_id", good="quality", toxic="toxic")
    return filter_audit.interactions(filter_audit.survivors(marked))


@query()
def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.find_secrets(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    counts = [F.size(F.filter("out.base", _of_kind(i))).cast("long").alias(f"n_{k}")
              for i, k in enumerate(secret_scan.KINDS[:secret_scan.BASE_KINDS])]
    return out.select("row.doc_id", *counts, F.sha2(secret_scan.written(F.col("out.base")), 256).alias("base_sha256"),
                      secret_scan.written(F.col("out.spans")).alias("spans"))


def _of_kind(i: int) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == i


@query(rf"""
WITH RECURSIVE run AS (
  SELECT doc_id, r, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {A_TO_Z}), '[a-zÀ-ÿ]+')) AS r
        FROM documents)
  WHERE length(r) >= 7 GROUP BY doc_id, r),
coded AS (SELECT r, c, hex(encode(coalesce(doc_id::varchar, '') || ':' || r)) AS x FROM run),
-- crc32 as one fold: each byte is followed by eight shifts, written as -1.
hashed AS (
  SELECT r, c, xor(list_reduce([4294967295] || flatten(list_transform(range(1, length(x), 2), lambda i:
      [16 * (instr('0123456789ABCDEF', x[i]) - 1) + instr('0123456789ABCDEF', x[i + 1]) - 1,
       -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END),
    4294967295) AS h
  FROM coded),
word AS (
  SELECT word, sum(c)::bigint AS n
  FROM (SELECT c, CASE WHEN h % 31 = 0 THEN r[1:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
cut AS (SELECT word, n, i, word[1:i] || word[i + 2:] AS d
        FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM word)),
pair AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT word.word, cut.word, cut.n FROM word JOIN cut ON word.word = d
  UNION SELECT cut.word, word.word, word.n FROM word JOIN cut ON word.word = d),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS m FROM pair GROUP BY word),
top AS (SELECT word, min(near) AS near FROM pair JOIN best USING (word) WHERE near_n = m GROUP BY word),
out AS (SELECT word.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN near END AS form,
               CASE WHEN m >= 10 * n THEN m END AS form_n
        FROM word LEFT JOIN best ON word.word = best.word LEFT JOIN top ON word.word = top.word),
walk AS (SELECT word, word AS last FROM out
         UNION ALL SELECT walk.word, form FROM walk JOIN out ON walk.last = out.word WHERE form IS NOT NULL)
SELECT out.word, out.form, last AS root, out.n, out.n_near, out.form_n
FROM out JOIN walk ON out.word = walk.word JOIN out other ON other.word = last WHERE other.form IS NULL
""")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), "text", "doc_id").select(
        "word", "form", "root", "n", "n_near", "form_n")
