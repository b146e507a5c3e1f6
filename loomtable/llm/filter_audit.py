"""How filters interact: which rows each subset and each order of up to five filters would keep.

A row's failures select a 32-bit truth table: bit s is set if the row survives the subset s of filters. All questions
about order and interaction are sums of such bits. In each task the words of a batch are put by part and label, and
carry-save adders turn three words into a sum and a carry word until a few words of each weight are left, whose bits
are counted. What leaves a task is 32 counts for each part and label it met, so a hot part costs a task one row more.

That a text repeats an earlier one is found by a digest: the smallest key of each digest is a grouped minimum, combined
map-side, and it meets its row again by (key, digest). So copies are never gathered and the join has no hot key.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, slices

#: The text filters: too short, repetitive, shouting, symbols, a copy of an earlier text. Limits are fixed values.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PCT, MAX_UPPER_PCT = 200, 50, 3
UPPER, SYMBOLS = bytes(range(65, 91)), b"#$%&*|"
#: Bytes of UTF-8 that go on with a character.
GOES_ON = bytes(range(0x80, 0xC0))

SUBSETS = 32
#: Parts and labels that a task counts side by side before it hands them on.
MAX_GROUPS = 4096

#: For each set of failed filters, the truth table of the subsets it survives.
SURVIVES = np.array([sum(1 << s for s in range(SUBSETS) if not s & f) for f in range(SUBSETS)], np.uint32)


def failures_of(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()
    n, points = len(words), len(text.translate(None, GOES_ON))
    return (
        (n < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT_PCT * n) << 1
        | (100 * (len(text) - len(text.translate(None, UPPER))) > MAX_UPPER_PCT * points) << 2
        | (len(text.translate(None, SYMBOLS)) < len(text)) << 3
    )


def text_failures(docs: DataFrame, text: str, key: str, part: str) -> DataFrame:
    """``key``, ``part`` (null as empty), ``fails`` (bits of FILTERS) for each row of ``docs``.

    A null text is an empty one. A row fails E if any smaller key has the same text; rows of a null key never do, nor
    rows that repeat a key with its text. Other columns are not read, so none can clash.
    """
    src = docs.select(
        F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("part"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                texts = piece.column("text").to_pylist()
                yield pa.RecordBatch.from_arrays([
                    piece.column("key"), piece.column("part"),
                    pa.array([failures_of(t) for t in texts], pa.int32()),
                    pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary()),
                ], ["key", "part", "fails", "digest"])

    kind = src.schema["key"].dataType.simpleString()
    slim = materialize(src.mapInArrow(run, f"key {kind}, part string, fails int, digest binary"), "filter-failures")
    first = slim.filter("key IS NOT NULL").groupBy("digest").agg(F.min("key").alias("key"))
    keyed = slim.filter("key IS NOT NULL").join(first.withColumn("first", F.lit(True)), ["key", "digest"], "left")
    copy = F.when(F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    return keyed.select("key", "part", (F.col("fails") + copy).alias("fails")).unionByName(
        slim.filter("key IS NULL").select("key", "part", "fails"))


def with_labels(rows: DataFrame, labels: DataFrame, key: str, **marks: str) -> DataFrame:
    """Adds a boolean for each of ``marks`` (name=label column): whether any label row of the key has a one there."""
    known = labels.filter(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("key")).agg(
        *[F.max(F.coalesce(F.col(f"`{c}`") == 1, F.lit(False))).alias(name) for name, c in marks.items()])
    # Rows without a key have no label; they stay out of the join, where they would meet in one task.
    out = rows.filter("key IS NOT NULL").join(known, "key", "left").unionByName(
        rows.filter("key IS NULL").withColumns(dict.fromkeys(marks, F.lit(False))))
    return out.fillna(False, list(marks))


def positional_popcounts(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit set."""
    counts, places = np.zeros(32, np.int64), np.arange(32, dtype=np.uint32)
    weight = 1
    while words.size:
        carries = [words[:0]]
        while words.size > 2:
            m = words.size // 3
            a, b, c = words[:m], words[m:2 * m], words[2 * m:3 * m]
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate((half ^ c, words[3 * m:]))
        counts += weight * ((words[:, None] >> places) & np.uint32(1)).sum(axis=0, dtype=np.int64)
        words, weight = np.concatenate(carries), 2 * weight
    return counts


def _count_batch(batch: pa.RecordBatch, found: dict[tuple[str, int], np.ndarray]) -> None:
    parts = batch.column("part").dictionary_encode()
    names, code = parts.dictionary.to_pylist(), parts.indices.to_numpy(zero_copy_only=False)
    group = code.astype(np.int64) * 4 + batch.column("label").to_numpy(zero_copy_only=False)
    words = SURVIVES[batch.column("fails").to_numpy(zero_copy_only=False)]
    order = np.argsort(group, kind="stable")
    group, words = group[order], words[order]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if group.size else ()
    for start, end in zip(starts, [*starts[1:], group.size], strict=True):
        at = (names[group[start] // 4], int(group[start] % 4))
        found[at] = found.get(at, 0) + positional_popcounts(words[start:end])


def survivors(rows: DataFrame) -> DataFrame:
    """``part``, ``subset`` (bits of filters, 0 to 31), ``kept``, ``good`` and ``toxic``: how many of a part's rows,
    of those marked good and of those marked toxic, no filter of the subset removes. ``rows`` has part, fails, good,
    toxic. Every part that occurs has all 32 subsets; an empty table gives no rows."""
    label = F.col("good").cast("int") + 2 * F.col("toxic").cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed_on(found):
            n = len(found)
            return pa.RecordBatch.from_arrays([
                pa.array([p for p, _ in found], pa.string()), pa.array([k for _, k in found], pa.int32()),
                pa.array([c.tolist() for c in found.values()] if n else [], pa.list_(pa.int64())),
            ], ["part", "label", "counts"])

        found: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            _count_batch(batch, found)
            if len(found) > MAX_GROUPS:
                yield handed_on(found)
                found = {}
        yield handed_on(found)

    counted = rows.select("part", "fails", label.alias("label")).mapInArrow(
        run, "part string, label int, counts array<bigint>")
    each = counted.select("part", "label", F.posexplode("counts").alias("subset", "n"))
    marked = lambda bit: F.sum(F.when(F.col("label").bitwiseAND(bit) > 0, F.col("n")).otherwise(0))
    return each.groupBy("part", "subset").agg(
        F.sum("n").alias("kept"), marked(1).alias("good"), marked(2).alias("toxic"))


def _passed(n: Column | int) -> Column:
    """Bits of the filters that come before place ``n`` (from 0) of ``filter_order``."""
    bits = [F.when(F.instr(F.col("filter_order"), f) <= n, 1 << i).otherwise(0) for i, f in enumerate(FILTERS)]
    return sum(bits[1:], bits[0])


def interactions(subsets: DataFrame) -> DataFrame:
    """For each part, order of the filters and step: what that step keeps and removes, what of its failures was gone
    before (``redundant``), what fails its filter alone, which good and toxic rows it removes, and ``shapley``: the
    rows its filter removes, summed over all orders."""
    one = F.struct("subset", "kept", "good", "toxic")
    # A part has 32 subsets, whatever its rows.
    parts = subsets.groupBy("part").agg(F.sort_array(F.collect_list(one)).alias("s"))
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(FILTERS)])
    steps = parts.select("part", "s", F.explode(orders).alias("filter_order")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    steps = steps.select("*", F.get("s", _passed(F.col("step") - 1)).alias("before"),
                         F.get("s", _passed(F.col("step"))).alias("after"))
    bit = F.col("after.subset") - F.col("before.subset")
    kept = lambda subset: F.get("s", subset)["kept"]
    removed = F.col("before.kept") - F.col("after.kept")
    out = steps.select(
        "part", "filter_order", "step", bit.alias("bit"), F.col("after.kept").alias("kept"), removed.alias("removed"),
        (kept(F.lit(0)) - kept(bit) - removed).alias("redundant"),
        (kept(F.lit(SUBSETS - 1) - bit) - kept(F.lit(SUBSETS - 1))).alias("unique_fails"),
        (F.col("before.good") - F.col("after.good")).alias("good_lost"),
        (F.col("before.toxic") - F.col("after.toxic")).alias("toxic_lost"))
    total = out.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return out.join(total, ["part", "bit"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
        "shapley")
