"""Spelling variants: words that differ by one letter, found by PartEnum signatures of their letter multisets.

A multiset is a binary vector with one dimension for each (letter, how often so far). A replaced letter changes two
dimensions, an inserted or deleted one changes one. Dimensions are dealt to a few partitions by a hash. Vectors at
distance two agree on all partitions but two, so words of one length share a signature for some choice of two
partitions left out; words whose lengths differ by one agree on all partitions but one. Each signature is a hash of the
length, the choice and the dimensions outside it. It also holds one half of the word: one edit leaves the first half or
the last half as it was, so each choice is made twice, once with each. That loses no pair and keeps words apart that
share most letters in another order: on real vocabularies it takes nine of ten candidates away.

Signatures meet in an equi-join of the table with itself, and the join's condition is the exact check, so candidates
are never written. A word's signatures number SAME + NEXT, whatever the text. Words above LONG code points go by a
digest there, so that a long word isn't copied with each; they are checked by a join of the few pairs left.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, slices

#: A run of letters, once A-Z are in lower case.
RUN = re.compile("[a-zÀ-ÿ]+")
MIN_POINTS, MIN_COUNT, TIMES = 7, 2, 10
#: One of so many (document, run) pairs is misspelt on purpose.
MISSPELT = 31
#: Partitions of dimensions for words of one length (two are left out) and for lengths that differ by one (one is).
SAME, NEXT = 5, 3
LONG = 64
#: Words (and their letters) that a task counts before it hands the counts on.
MAX_WORDS, MAX_LETTERS = 200_000, 16_000_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def runs_of(key, raw: bytes | None) -> Iterator[tuple[str, int]]:
    """Words of MIN_POINTS code points or more of a text, and how often; some runs lose a letter by their hash."""
    if not raw:
        return
    seed = zlib.crc32(f"{'' if key is None else key}:".encode())
    for run, n in Counter(RUN.findall(raw.translate(_LOWER).decode())).items():
        if len(run) < MIN_POINTS:
            continue
        h = zlib.crc32(run.encode(), seed)
        if h % MISSPELT == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < MIN_POINTS:
                continue
        yield run, n


def word_counts(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``word`` and ``n``: the words of all texts, counted. Null and empty texts have none, a null key reads as an
    empty one."""
    src = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def handed_on():
            return pa.RecordBatch.from_arrays(
                [pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

        size = 0
        for batch in batches:
            for piece in slices(batch, "text"):
                for key, raw in zip(piece.column("key").to_pylist(), piece.column("text").to_pylist(), strict=True):
                    for word, n in runs_of(key, raw):
                        size += 0 if word in found else len(word)
                        found[word] += n
                    if len(found) > MAX_WORDS or size > MAX_LETTERS:
                        yield handed_on()
                        found, size = Counter(), 0
        yield handed_on()

    return src.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _added(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    np.add.at(out, at, values)
    return out


def signatures(words: list[str]) -> np.ndarray:
    """The signatures of each word, one row of hashes for a word. Words at edit distance one share one at least."""
    n = len(words)
    lengths = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    own = np.repeat(np.arange(n), lengths)
    pos = np.arange(points.size) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    back = np.repeat(lengths, lengths) - 1 - pos

    # How often a letter came before in its word makes it a dimension of its own.
    order = np.lexsort((points, own))
    fresh = np.ones(points.size, bool)
    fresh[1:] = (own[order][1:] != own[order][:-1]) | (points[order][1:] != points[order][:-1])
    since = np.arange(points.size)
    times = np.empty(points.size, np.int64)
    times[order] = since - np.maximum.accumulate(np.where(fresh, since, 0))
    dimension = _mix(_mix(points) + times.astype(np.uint64))
    placed = {False: _mix(_mix(points) ^ _mix(pos + 1)), True: _mix(_mix(points) ^ _mix(-1 - back))}

    def half(short: np.ndarray, last: bool) -> np.ndarray:
        """Hash of the first or the last half of the words, cut as for words of length ``short``."""
        size = (short + 1) // 2 if last else short // 2
        inside = (back if last else pos) < np.repeat(size, lengths)
        return _added(placed[last][inside], own[inside], n)

    def left_out(parts: int, out: int, tag: int) -> Iterator[np.ndarray]:
        part = (_mix(dimension + np.uint64(tag)) % np.uint64(parts)).astype(np.int64)
        sums = _added(dimension, own * parts + part, n * parts).reshape(n, parts)
        whole = sums.sum(axis=1, dtype=np.uint64)
        for i, choice in enumerate(itertools.combinations(range(parts), out)):
            yield _mix(whole - sums[:, choice].sum(axis=1, dtype=np.uint64) + _mix(np.uint64(1000 * tag + i)[None]))

    found = []
    for parts, out, shorter in ((SAME, 2, lengths), (NEXT, 1, lengths), (NEXT, 1, lengths - 1)):
        ends = [_mix(half(shorter, last) ^ _mix(2 * shorter + last)) for last in (False, True)]
        found += [_mix(rest ^ end) for rest in left_out(parts, out, out) for end in ends]
    return np.stack(found, axis=1) if n else np.zeros((0, 0), np.uint64)


def _signed(vocabulary: DataFrame) -> DataFrame:
    """(sig, id) for each signature of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "word"):
                if not piece.num_rows:
                    continue
                found = signatures(piece.column("word").cast(pa.string()).to_pylist())
                at = np.repeat(np.arange(piece.num_rows), found.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.ravel().view(np.int64)), piece.column("id").take(pa.array(at))], ["sig", "id"])

    return vocabulary.select(F.col("word").cast("binary").alias("word"), "id").mapInArrow(run, "sig bigint, id string")


def _one_apart(a: Column | str, b: Column | str) -> Column:
    return F.levenshtein(a, b, 1) == 1


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``id``, ``near`` and ``near_n``: each word with each word at distance one, both ways. ``vocabulary`` has word,
    n and id."""
    signed = _signed(vocabulary)
    a, b = signed.alias("a"), signed.alias("b")
    by_digest = F.col("a.id").startswith("#") | F.col("b.id").startswith("#")
    pairs = a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.id") < F.col("b.id")) & (
        by_digest | _one_apart("a.id", "b.id"))).select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).distinct()
    pairs = materialize(pairs, "spelling-pairs")
    both = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    word = vocabulary.select("id", "word")
    other = vocabulary.select(F.col("id").alias("y"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = both.withColumnRenamed("x", "id").join(word, "id").join(other, "y")
    return met.filter(_one_apart("word", "near")).select("id", "near", "near_n")


def _followed(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``: where the forms of a word end. Each round follows twice as many; as a form is at least
    TIMES as frequent as its word, a chain has fewer than twenty words and six rounds follow all."""
    reached = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("on")), "spelling-forms")
    for _ in range(6):
        step = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        reached = materialize(reached.join(step, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")), "spelling-forms")
        if reached.filter("on").isEmpty():
            break
    return reached.select("word", "root")


def variants(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of every word of the texts that has MIN_POINTS
    code points or more and occurs MIN_COUNT times or more.

    Near words differ by one inserted, deleted or replaced code point. A word's form is its most frequent near word,
    the first in code-point order among equals, where that is TIMES as frequent as the word or more. The root is where
    the forms end. Null and empty texts have no words and an empty table has no rows; repeated rows count each. Only
    the text and the key are read, so no other column's name can clash.
    """
    counted = word_counts(docs, text, key).filter(F.col("n") >= MIN_COUNT)
    short = F.length("word") <= LONG
    known = materialize(counted.withColumn(
        "id", F.when(short, F.col("word")).otherwise(F.concat(F.lit("#"), F.sha2("word", 256)))), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = near_words(known).groupBy("id").agg(F.count("*").alias("n_near"), best.alias("best"))
    has_form = -F.col("best.less") >= TIMES * F.col("n")
    out = known.join(near, "id", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has_form, F.col("best.form")).alias("form"), F.when(has_form, -F.col("best.less")).alias("form_n"))
    out = materialize(out, "spelling-variants")
    return out.join(_followed(out.filter("form IS NOT NULL")), "word", "left").withColumn(
        "root", F.coalesce("root", "word"))
