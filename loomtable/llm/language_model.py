"""Language-model scores from a weighted backoff automaton over all n-grams of the training documents.

States are the empty context and one per training token. A state has an arc for every bigram seen after its token, with
the smoothed probability as weight, and a failure arc to the empty state with what is left; the empty state has an arc
for every token, and one for unknown ones. A text is read once from left to right: the state is the last token,
unseen arcs go over the failure arc first, and the logarithms add up. With c counts and K the smoothing mass,

    seen arc   (c(u,v) + K p(v)) / (c(u) + K)        failure arc   K / (c(u) + K)        p(v) = (c(v) + a) / (N + a (V + 1))

so each state's weights sum to one.

The automaton grows with the corpus, so no task gets it whole. Documents are dealt to blocks of about BLOCK_BYTES by a
hash. A block asks for the n-grams it holds: their 64-bit keys, sorted and cut into ranges, with the block's own
training counts. The task of a range adds up all blocks' counts and answers every block with the totals in the order
asked. Each block then builds its part of the automaton and reads its documents. Keys are hashes, so a frequent word
weighs no more than others, and a range's work is the number of distinct n-grams of each block, not of tokens.
Keys are 61 bits of a hash: among a billion different n-grams some 0.2 pairs are expected to share one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .shared import SLICE_BYTES, _arrow_type

BLOCK_BYTES, RANGE_BYTES = 8_000_000, 6_000_000
#: Added to each token's count, and the mass that smoothing takes from a state's arcs.
ALPHA, MASS = 0.1, 20.0

FIELDS = ("n_tokens long, n_known long, train_tokens long, train_types long, base_score double, score double")

_END, _START = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b" end", b" start"))
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


class _Hashes(dict):
    """Word hashes, worked out on first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


_HASHES = _Hashes()


#: Words whose hashes a worker remembers.
MAX_HASHES = 300_000


def token_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (words, then one end for each text) and the number of each text's tokens."""
    if len(_HASHES) > MAX_HASHES:
        _HASHES.clear()
    get, parts, sizes = _HASHES.__getitem__, [], []
    end = np.array([_END], np.uint64)
    for text in texts:
        w = (text or b"").lower().split()
        parts += [np.fromiter(map(get, w), np.uint64, len(w)), end]
        sizes.append(len(w) + 1)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.array(sizes, np.int64)


def contexts(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each token; the start for a text's first."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(sizes) - sizes] = _START
    return before


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _C
    return x ^ (x >> np.uint64(29))


def keys_of(tokens: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unigram and bigram keys: 61 bits of hash, then the order, then room for a flag."""
    one = (_mixed(tokens * _A) >> np.uint64(3)) << np.uint64(2)
    two = (_mixed(before * _A + tokens * _B) >> np.uint64(3)) << np.uint64(2)
    return one, two | np.uint64(2)


def _pack(x: np.ndarray) -> bytes:
    """Numbers as bytes, the first bytes of all together, for the shuffle's compression."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unpack(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _parts(table: pa.Table) -> Iterator[tuple[list[bytes | None], list[bool], pa.Table]]:
    """Rows of a block in parts of bounded text size."""
    texts = table.column("text").to_pylist()
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size > SLICE_BYTES or i + 1 == len(texts):
            yield texts[start: i + 1], table.column("held_out").slice(start, i + 1 - start).to_pylist(), table.slice(
                start, i + 1 - start)
            start, size = i + 1, 0


def _ask(ranges: int):
    """The n-gram keys of a block and its training counts, cut into ranges."""
    edges = (np.arange(1, ranges, dtype=object) * (1 << 63) // ranges).astype(np.uint64)

    def run(table: pa.Table) -> pa.Table:
        flagged = []
        for texts, held, _ in _parts(table):
            tokens, sizes = token_hashes(texts)
            train = np.repeat(~np.array(held, bool), sizes).astype(np.uint64)
            one, two = keys_of(tokens, contexts(tokens, sizes))
            flagged += [one | train, two | train]
        x = np.sort(np.concatenate(flagged)) if flagged else np.zeros(0, np.uint64)
        keys = x >> np.uint64(1)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(x) else np.zeros(0, np.int64)
        counts = np.add.reduceat((x & np.uint64(1)).astype(np.int64), first) if len(x) else np.zeros(0, np.int64)
        keys = keys[first]
        cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
        block = table.column("block")[0].as_py()
        rows = [{"range": r, "block": block, "keys": _pack(np.diff(keys[a:b], prepend=np.uint64(0))),
                 "counts": _pack(counts[a:b])} for r, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
        return pa.Table.from_pylist(rows, _ASKED)

    return run


_ASKED = pa.schema([("range", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_ANSWERED = pa.schema([("range", pa.int64()), ("block", pa.int64()), ("totals", pa.binary()),
                       ("tokens", pa.int64()), ("types", pa.int64())])


def _answer(table: pa.Table) -> pa.Table:
    """The totals of one range over all blocks, for each block in the order it asked."""
    keys = [np.cumsum(_unpack(x, np.uint64), dtype=np.uint64) for x in table.column("keys").to_pylist()]
    counts = np.concatenate([_unpack(x, np.int64) for x in table.column("counts").to_pylist()])
    every = np.sort(np.concatenate(keys))
    every = every[np.r_[True, every[1:] != every[:-1]]]
    places = [np.searchsorted(every, k) for k in keys]
    # Sums of whole numbers below 2^53 are exact.
    totals = np.bincount(np.concatenate(places), weights=counts, minlength=len(every)).astype(np.int64)
    unigram = (every & np.uint64(1)) == 0
    r = table.column("range")[0].as_py()
    rows = [{"range": r, "block": b, "totals": _pack(totals[p]), "tokens": 0, "types": 0}
            for b, p in zip(table.column("block").to_pylist(), places, strict=True)]
    rows.append({"range": r, "block": -1, "totals": b"", "tokens": int(totals[unigram].sum()),
                 "types": int((totals[unigram] > 0).sum())})
    return pa.Table.from_pylist(rows, _ANSWERED)


class Automaton:
    """The part of the automaton that a block needs: totals for the n-grams it holds."""

    def __init__(self, keys: np.ndarray, totals: np.ndarray, train_tokens: int, train_types: int, mass: float = MASS):
        self.keys, self.totals, self.mass = keys, totals, mass
        self.n, self.v = train_tokens, train_types

    def count(self, keys: np.ndarray) -> np.ndarray:
        return self.totals[np.searchsorted(self.keys, keys >> np.uint64(1))]

    def read(self, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, log10 of the unigram and of the automaton's probability of each text."""
        before = contexts(tokens, sizes)
        one, two = keys_of(tokens, before)
        c, arc = self.count(one), self.count(two)
        # The state's own count; a text starts as often as one ends.
        state = np.empty_like(c)
        state[1:] = c[:-1]
        starts = np.cumsum(sizes) - sizes
        state[starts] = c[starts + sizes - 1]
        p = (c + ALPHA) / (self.n + ALPHA * (self.v + 1))
        failure = self.mass / (state + self.mass)
        weight = np.where(arc > 0, (arc + self.mass * p) / (state + self.mass), failure * p)
        return (np.add.reduceat((c > 0).astype(np.int64), starts), np.add.reduceat(np.log10(p), starts),
                np.add.reduceat(np.log10(weight), starts))


def score_texts(docs: DataFrame, text: str, held_out: Column, keep: list[str], mass: float = MASS) -> DataFrame:
    """Columns ``row`` (the columns in ``keep``), ``held_out`` and ``out`` (see FIELDS), one row per row of ``docs``.

    The model learns from the rows whose ``held_out`` is false (null counts as false) and scores all. A null or empty
    text is an end alone. Repeated rows each count and are each scored. Without training rows every token is unknown.
    Extra columns are not read and names can't clash, as kept ones stay in ``row``.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    src = docs.select(row, F.col(f"`{text}`").cast("binary").alias("text"),
                      F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = src.select(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, ranges = int(size // BLOCK_BYTES) + 1, int(size // RANGE_BYTES) + 8
    src = src.withColumn("block", F.pmod(F.xxhash64("row", "text"), F.lit(blocks)))
    # The documents by block are needed twice, by the same exchange, which Spark reuses.
    asked = src.groupBy("block").applyInArrow(_ask(ranges), "range long, block long, keys binary, counts binary")
    answered = asked.groupBy("range").applyInArrow(
        _answer, "range long, block long, totals binary, tokens long, types long")
    sums = answered.filter("block < 0").agg(F.struct(
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("types"), F.lit(0)).alias("types"))).scalar()
    answers = answered.filter("block >= 0").select("range", "block", "totals", sums.alias("all"))
    schema = StructType([src.schema["row"], src.schema["held_out"], StructField("out", _parse_datatype_string(FIELDS))])
    kind = _arrow_type(schema["out"].dataType)

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("range").to_numpy())
        totals = right.column("totals").to_pylist()
        n, v = right.column("all")[0].as_py().values()
        totals = [_unpack(totals[i], np.int64) for i in order]
        out, held, rows, keys = [], [], [], []
        for texts, _, _ in _parts(left):
            tokens, sizes = token_hashes(texts)
            keys += keys_of(tokens, contexts(tokens, sizes))
        x = np.sort(np.concatenate(keys)) >> np.uint64(1)
        automaton = Automaton(x[np.r_[True, x[1:] != x[:-1]]], np.concatenate(totals), n, v, mass)
        for texts, flags, part in _parts(left):
            tokens, sizes = token_hashes(texts)
            known, base, score = automaton.read(tokens, sizes)
            out += [{"n_tokens": a, "n_known": b, "train_tokens": n, "train_types": v, "base_score": c, "score": d}
                    for a, b, c, d in zip(sizes.tolist(), known.tolist(), base.tolist(), score.tolist(), strict=True)]
            held += flags
            rows.append(part.column("row"))
        chunks = [c for r in rows for c in r.chunks]
        return pa.Table.from_arrays([pa.chunked_array(chunks), pa.array(held), pa.array(out, kind)],
                                    ["row", "held_out", "out"])

    return src.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(read, schema)
