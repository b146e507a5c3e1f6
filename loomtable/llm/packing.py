"""Best-fit packing of token sequences by bin completion with branch and bound.

Only the number of pieces of each length matters for how well they pack, so the plan is made on that histogram: it has
at most ``capacity`` entries however many documents there are. Around the largest piece that is left, the undominated
fillings of the rest of the sequence are enumerated; the fullest goes first and is applied to as many sequences as the
counts allow. The first descent (always best fit) is the incumbent. If it needs more sequences than the bound (total
length / capacity) asks for, other fillings are tried; a branch is cut when its waste exceeds what a better solution
may waste in all. The search is bounded (WORK): it is not exhaustive, and a plan may need more sequences than the best.

The plan, a few rows for each length, goes back to the pieces: numbered within their length (a counter per task and
length, plus the counts of the tasks before), each looks up its sequence and offset. So no task ever holds a length's
pieces, and a hot length is no heavier than others.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, combinations, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType
from pyspark.sql.window import Window

from .shared import materialize, slices

CAPACITY = 4096
#: Lengths tried for one place of a sequence, places looked at for one sequence and for a whole plan, and descents
#: tried after the first.
MAX_TRIED, MAX_NODES, WORK, MAX_DESCENTS = 6, 4000, 600_000, 24
#: Chunks of text (between blanks) whose ids a worker remembers.
MAX_CHUNKS = 450_000
#: Chunks that are encoded in one call.
PARTS_A_CALL = 5_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MARKS = re.compile(r"(?<=[A-Za-zà-öø-ÿ])([.,])(?=\s)")


@dataclass
class Plan:
    """Patterns: (number of sequences, ((length, copies), ...))."""

    capacity: int
    patterns: list[tuple[int, tuple[tuple[int, int], ...]]] = field(default_factory=list)

    @property
    def sequences(self) -> int:
        return sum(n for n, _ in self.patterns)


class Search:
    """Pieces that are left, by length, and the work that may still be spent on finding fillings for them."""

    def __init__(self, histogram: dict[int, int], work: int):
        self.counts, self.held, self.work = dict(histogram), sorted(histogram), work

    def take(self, need: dict[int, int], times: int) -> None:
        for v, k in need.items():
            self.counts[v] -= k * times
            if not self.counts[v]:
                del self.held[bisect_left(self.held, v)]

    def best_fit(self, room: int) -> tuple[int, ...]:
        """The largest that fits, again and again."""
        chosen: tuple[int, ...] = ()
        at = bisect_right(self.held, room) - 1
        while at >= 0:
            length = self.held[at]
            if self.counts[length] > chosen.count(length):
                chosen, room = (*chosen, length), room - length
                at = min(at, bisect_right(self.held, room) - 1)
            else:
                at -= 1
        return chosen

    def dominated(self, one: tuple[int, ...], waste: int) -> bool:
        """Whether a longer piece that is left fits in place of one piece, or any in place of two."""
        def stands_for(least: int, most: int) -> bool:
            at = bisect_left(self.held, least)
            return at < len(self.held) and (u := self.held[at]) <= most and self.counts[u] > one.count(u)

        return any(stands_for(v + 1, v + waste) for v in set(one)) or any(
            stands_for(v + w, v + w + waste) for v, w in set(combinations(one, 2)))

    def fillings(self, room: int, spare: int, keep: int) -> list[tuple[int, ...]]:
        """Undominated fillings of ``room``, fullest first, at most ``keep``; each with at most ``spare`` waste if any
        is. At most MAX_TRIED lengths are tried for a place and MAX_NODES places in all; without work left there is
        the best fit alone."""
        if self.work <= 0:
            return [self.best_fit(room)]
        held, counts = self.held, self.counts
        found: list[tuple[int, tuple[int, ...]]] = []
        nodes = 0

        def go(rest: int, chosen: tuple[int, ...], most: int) -> bool:
            """True when enough fillings without waste, or too many places, were seen."""
            nonlocal nodes
            nodes += 1
            if rest and counts.get(rest, 0) > chosen.count(rest):
                found.append((0, (*chosen, rest)))
                return len(found) >= keep
            if nodes > MAX_NODES:
                found.append((rest, chosen))
                return True
            at, leaf, tried = bisect_right(held, min(rest, most)) - 1, True, 0
            while at >= 0 and tried < MAX_TRIED:
                length = held[at]
                at -= 1
                if counts[length] <= chosen.count(length):
                    continue
                leaf, tried = False, tried + 1
                if go(rest - length, (*chosen, length), length):
                    return True
            if leaf:
                found.append((rest, chosen))
                return rest == 0 and len(found) >= keep
            return False

        go(room, (), room)
        self.work -= nodes
        found.sort(key=lambda x: (x[0], [-v for v in x[1]]))
        out: list[tuple[int, ...]] = []
        for waste, one in found:
            if out and (one in out or waste > spare or waste and self.dominated(one, waste)):
                continue
            out.append(one)
            if len(out) >= keep:
                break
        return out


def _descend(search: Search, capacity: int, allowed: int, turns: dict[int, int]) -> Plan | None:
    """One descent. ``turns`` says at which step another filling than the best is taken; None if waste exceeds what
    is ``allowed``."""
    plan, wasted = Plan(capacity), 0
    while search.held:
        first = search.held[-1]
        want = turns.get(len(plan.patterns), 0)
        search.counts[first] -= 1
        options = search.fillings(capacity - first, max(0, allowed - wasted), want + 1)
        search.counts[first] += 1
        need = Counter({first: 1})
        need.update(options[min(want, len(options) - 1)] if options else ())
        times = min(search.counts[v] // k for v, k in need.items())
        search.take(need, times)
        plan.patterns.append((times, tuple(sorted(need.items(), reverse=True))))
        wasted += times * (capacity - sum(v * k for v, k in need.items()))
        # The last sequence may be part full: its waste is within the bound's own slack.
        if wasted > allowed and search.held:
            return None
    return plan


def bin_completion(histogram: dict[int, int], capacity: int = CAPACITY, work: int = WORK) -> Plan:
    """A plan for ``histogram`` (length: number of pieces), each length from 1 to ``capacity``.

    Where the first descent misses the bound, up to MAX_DESCENTS others each take another filling at one step, the steps
    spread over the whole plan; what saves a sequence is kept for the next. ``work`` bounds the places looked at in
    all, half of them in the first descent, and so the time; every piece is planned in any case.
    """
    if any(not 0 < v <= capacity for v in histogram):
        raise ValueError("a piece has a length between 1 and the capacity")
    histogram = {v: n for v, n in histogram.items() if n > 0}
    total = sum(v * n for v, n in histogram.items())
    # Pieces over half the capacity never share a sequence.
    bound = max(-(-total // capacity), sum(n for v, n in histogram.items() if 2 * v > capacity))
    best = _descend(Search(histogram, work // 2), capacity, 1 << 62, {})
    kept: dict[int, int] = {}
    work //= 2
    for i in range(MAX_DESCENTS):
        if best.sequences <= bound or work <= 0:
            break
        turns = kept | {len(best.patterns) * i // MAX_DESCENTS: 1 + i % 2}
        search = Search(histogram, work)
        other = _descend(search, capacity, (best.sequences - 1) * capacity - total, turns)
        work = search.work
        if other is not None and other.sequences < best.sequences:
            best, kept = other, turns
    return best


def lookup(plan: Plan) -> dict[str, np.ndarray]:
    """For ranks within a length: sorted starts (length * 2^44 + rank) with first sequence, copies and offset.

    There is one entry for each length of each pattern, whatever the number of pieces.
    """
    done: dict[int, int] = {}
    rows, sequence = [], 0
    for times, need in plan.patterns:
        at = 0
        for length, copies in need:
            start = done.get(length, 0)
            rows.append(((length << 44) + start, sequence, copies, at))
            done[length] = start + times * copies
            at += length * copies
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return dict(zip(("start", "sequence", "copies", "offset"), table.T, strict=True))


class Encoder:
    """Token ids of texts. A tokenizer that drops white space gives the ids of the parts between blanks one after
    another, so each different part is encoded once and remembered.

    Fewer parts differ without case and punctuation: where the tokenizer has A-Z in lower case, so have the parts, and
    where it takes a point or comma behind a letter and before a blank apart, it is a part by itself. A call for each
    part would cost as much as its encoding, so parts of letters alone go into one call together; if the tokenizer's
    own words are not just these parts, they are encoded one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        words = "A", "Bc", "word", "Ünique", "xqzjk", "tokenization"
        self.folds = all(self._one(w) == self._one(w.encode().translate(_LOWER).decode()) for w in words)
        self.separates = all(
            self._one(f"{w}{c} {v}") == self._one(w) + self._one(c) + self._one(v)
            for w in words for v in words for c in ".,")

    def _one(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, new: list[str]) -> None:
        letters = [w for w in new if w.isalpha()]
        for i in range(0, len(letters), PARTS_A_CALL):
            some = letters[i: i + PARTS_A_CALL]
            made = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            word = np.array(made.word_ids, float)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else word
            if len(starts) == len(some):
                raw, at = np.array(made.ids, "<u4").tobytes(), [*(4 * starts).tolist(), 4 * len(word)]
                self.known.update((w, raw[x:y]) for w, x, y in zip(some, at, at[1:], strict=False))
        rest = [w for w in new if w not in self.known]
        for i in range(0, len(rest), PARTS_A_CALL):
            some = rest[i: i + PARTS_A_CALL]
            for w, made in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                ids = made.ids
                self.known[w] = struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, texts: list[bytes | str], end: int) -> list[np.ndarray]:
        """The ids of texts (UTF-8 where they are bytes), each with ``end`` behind them."""
        parts = []
        for raw in texts:
            raw = raw.encode() if isinstance(raw, str) else raw
            text = (raw.translate(_LOWER) if self.folds else raw).decode("utf-8", "replace")
            if self.separates:
                text = _MARKS.sub(r" \1", text)
            parts.append(text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))
        if len(self.known) > MAX_CHUNKS:
            # The newer half stays.
            self.known = dict(islice(self.known.items(), len(self.known) // 2, None))
        known = self.known
        self._learn(list(set(chain.from_iterable(parts)).difference(known)))
        last = np.array([end], "<u4").tobytes()
        return [np.frombuffer(b"".join(map(known.__getitem__, p)) + last, "<u4") for p in parts]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(
    docs: DataFrame, text: str, keep: list[str], tokenizer: str, capacity: int = CAPACITY, end: int = 1,
    tokens: bool = False,
) -> DataFrame:
    """The pieces of every document: ``row``, piece, start, length, ids_crc32, and where it was counted (part, nth).

    Only a sequence longer than ``capacity`` is cut. With ``tokens`` the ids are returned as well.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    src = docs.select(row, F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    names = ["piece", "start", "length", "ids_crc32", "part", "nth"]
    schema = StructType([src.schema["row"], *[StructField(n, LongType()) for n in names],
                         *([StructField("ids", ArrayType(LongType()))] if tokens else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encoder, part, seen = _encoder(tokenizer), TaskContext.get().partitionId(), {}
        for batch in batches:
            for some in slices(batch, "text"):
                take, out, ids = [], [], []
                for i, all_ids in enumerate(encoder.ids(some.column("text").to_pylist(), end)):
                    for k, start in enumerate(range(0, len(all_ids), capacity)):
                        cut = all_ids[start: start + capacity]
                        nth = seen.get(len(cut), 0)
                        seen[len(cut)] = nth + 1
                        take.append(i)
                        out.append((k, start, len(cut), zlib.crc32(cut.tobytes()), part, nth))
                        if tokens:
                            ids.append(cut.astype(np.int64))
                columns = np.array(out, np.int64).reshape(-1, 6).T
                yield pa.RecordBatch.from_arrays([
                    some.column("row").take(pa.array(take, pa.int64())), *[pa.array(c) for c in columns],
                    *([pa.array(ids, pa.list_(pa.int64()))] if tokens else [])], schema.names)

    return src.mapInArrow(run, schema)


def pack(
    docs: DataFrame, text: str, keep: list[str], tokenizer: str, capacity: int = CAPACITY, end: int = 1,
    tokens: bool = False,
) -> DataFrame:
    """Every piece with ``sequence_id`` and ``offset``; the pieces of a sequence fill it gapless from 0.

    A null text is an empty one: the end token alone. Repeated rows are packed each. An empty table gives no piece.
    The columns in ``keep`` stay inside ``row``, so no name can clash.
    """
    spark = docs.sparkSession
    made = materialize(pieces(docs, text, keep, tokenizer, capacity, end, tokens), "pieces")
    counts = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = materialize(counts, "piece-counts")
    # At most ``capacity`` rows come to the driver.
    plan = bin_completion({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()},
                          capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(counts.select(F.col("part").alias("p"), F.col("length").alias("l"), F.coalesce(
        F.sum("n").over(before), F.lit(0)).alias("base")), "piece-bases")
    ranked = made.join(bases, (made["part"] == bases["p"]) & (made["length"] == bases["l"]))
    ranked = ranked.select(*[c for c in made.columns if c not in ("part", "nth")],
                           (F.col("base") + F.col("nth")).alias("rank"))
    held = spark.sparkContext.broadcast(lookup(plan))
    schema = StructType([*[f for f in ranked.schema if f.name != "rank"], StructField("sequence_id", LongType()),
                         StructField("offset", LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            key = (length << 44) + batch.column("rank").to_numpy()
            at = np.searchsorted(table["start"], key, "right") - 1
            nth = key - table["start"][at]
            copies = table["copies"][at]
            sequence = table["sequence"][at] + nth // copies
            offset = table["offset"][at] + nth % copies * length
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(sequence), pa.array(offset)],
                [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)
