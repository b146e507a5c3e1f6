"""Toxic passages as maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

Learning: documents that hold a token, or a word beginning of 4 to 6 letters, are counted by label; near copies count
once. Log-odds with an informative Dirichlet prior (the pooled counts) and their z-scores choose the features that
speak for the toxic class; a word without an own one takes that of its longest chosen beginning. All other words get
a small negative score, so that chance hits far apart don't join.

Scoring: one linear scan finds every maximal segment (Ruzzo and Tompa). Under the clean class, segments of score S or
more in n tokens are expected K n exp(-lambda S) times; lambda solves sum p_i exp(lambda s_i) = 1 over the clean token
scores, K fits the number of clean segments. The surprise (-log of that expectation) of the best segment, the sum
of the scaled scores of all, their number and the length go through a logistic curve, fitted on the same labelled rows.

The labelled rows learnt from are at most SAMPLE (the lowest hashes of their ids), so the model, which is what tasks
receive, is bounded; scoring reads every whole text once, without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, rows_with

#: Labelled rows to learn from, at most.
SAMPLE = 40_000
#: Pseudo-documents of the Dirichlet prior, and the z-score and documents that a feature needs.
PRIOR, MIN_Z, MIN_DOCS = 50.0, 4.0, 4
#: Score of a word that no feature speaks for.
DRIFT = -0.05
BEGINNINGS = (6, 5, 4)

FIELDS = ("score double, n_tokens long, best_surprise double, "
          "segments array<struct<start:long,end:long,score:double,p_value:double>>")

_TABLE = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256))


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-case runs of ASCII letters, digits and all other characters."""
    return (text or b"").decode("utf-8", "replace").lower().encode().translate(_TABLE).split()


def features(token: bytes) -> list[bytes]:
    """The token itself, then its beginnings (marked by a *), longest first."""
    word = token.decode("utf-8", "replace")
    return [token, *(word[:n].encode() + b"*" for n in BEGINNINGS if len(word) >= n)]


def maximal_segments(scores: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of (start, end, score) items in text order, in linear time."""
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    back: list[int] = []  # the nearest earlier segment with a smaller sum before it
    total = 0.0
    for start, end, score in scores:
        before, total = total, total + score
        if score <= 0:
            continue
        new = (start, end, before, total)
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = back[j]
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                back.append(j)
                break
            new = (found[j][0], new[1], found[j][2], new[3])
            del found[j:], back[j:]
    return [(a, b, y - x) for a, b, x, y in found]


@dataclass
class Model:
    weights: dict[bytes, float]
    rate: float = 1.0  # lambda
    k: float = 0.01
    bias: tuple[float, ...] = (0.0, 1.0, 0.0, 0.0, 0.0)

    def token_score(self, token: bytes) -> float:
        for f in features(token):
            if f in self.weights:
                return self.weights[f]
        return DRIFT

    def segments(self, words: list[bytes], cache: dict) -> list[tuple[int, int, float]]:
        hits = [i for i, w in enumerate(words) if cache[w] > 0]
        items, at = [], 0
        for i in hits:
            if i > at:
                items.append((at, i, DRIFT * (i - at)))
            items.append((i, i + 1, cache[words[i]]))
            at = i + 1
        return maximal_segments(items)

    def summary(self, n: int, segments: list[tuple[int, int, float]]) -> tuple[float, ...]:
        """1, surprise of the best segment, sum of the scaled scores, number of segments (log), length (log)."""
        length = math.log(self.k * max(n, 1))
        best = self.rate * max((s for _, _, s in segments), default=0.0) - length
        total = sum(self.rate * s for _, _, s in segments)
        return 1.0, max(-15.0, min(40.0, best)), min(total, 60.0), math.log1p(len(segments)), math.log1p(n)

    def probability(self, x: tuple[float, ...]) -> float:
        z = sum(a * b for a, b in zip(self.bias, x, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


class _Scores(dict):
    """Token scores, worked out on first use; emptied when large."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, token: bytes) -> float:
        if len(self) > 500_000:
            self.clear()
        self[token] = out = self.model.token_score(token)
        return out


def labelled(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, train: Column) -> DataFrame:
    """(sketch, text, y) of the labelled rows to learn from: at most SAMPLE, one for texts of the same sketch."""
    chosen = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).filter(
        train & F.col("k").isNotNull() & F.col("y").isin(0, 1)).orderBy(F.xxhash64("k"), "k", "y").limit(SAMPLE)
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("text")).join(
        F.broadcast(chosen), "k").select("y", "text")
    sketched = rows_with(rows, "text", lambda texts: [{"sketch": _sketch(t)} for t in texts], "sketch long")
    one = sketched.select("row.y", "row.text", "out.sketch").groupBy("y", "sketch").agg(F.min("text").alias("text"))
    return materialize(one, "labelled")


def _sketch(text: bytes | None) -> int:
    """The least hash of the five-word shingles: near copies mostly share it."""
    w = tokens(text)
    shingles = [b" ".join(z) for z in zip(*(w[i:] for i in range(5)), strict=False)] or [b" ".join(w)]
    return min(map(xxhash.xxh64_intdigest, shingles)) - (1 << 63)


def learn(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, train: Column) -> Model:
    """A model from the labelled rows; ``train`` (over a column k, the key) says which may be used.

    Without rows of both classes every score is the share of toxic rows (0.0 without any).
    """
    sample = labelled(docs, labels, text, key, label, train)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}
        parts: dict[bytes, list[bytes]] = {}
        for batch in batches:
            for y, t in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                have: set[bytes] = set()
                for w in set(tokens(t)):
                    if w not in parts:
                        parts[w] = features(w)
                    have.update(parts[w])
                for f in have:
                    seen.setdefault(f, [0, 0])[y] += 1
            if len(seen) > 300_000:
                yield out(seen)
                seen, parts = {}, {}
        yield out(seen)

    def out(seen: dict[bytes, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array(list(seen), pa.binary()), pa.array([v[0] for v in seen.values()], pa.int64()),
            pa.array([v[1] for v in seen.values()], pa.int64())], ["feature", "n0", "n1"])

    source = sample.select("y", F.col("text").cast("binary").alias("text"))
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    d0, d1 = sizes.get(0, 0), sizes.get(1, 0)
    if not d0 or not d1:
        share = d1 / (d0 + d1) if d0 + d1 else 0.0
        edge = 30.0 if share >= 1 else -30.0
        return Model({}, bias=(edge, 0.0, 0.0, 0.0, 0.0))
    counts = source.mapInArrow(count, "feature binary, n0 long, n1 long").groupBy("feature").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    prior = (F.col("n0") + F.col("n1")) * (PRIOR / (d0 + d1))
    a, b = F.col("n1") + prior, F.col("n0") + prior
    odds = F.log(a / (d1 + PRIOR - a)) - F.log(b / (d0 + PRIOR - b))
    chosen = counts.filter(F.col("n1") >= MIN_DOCS).select(
        "feature", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("z")).filter(
        (F.col("z") >= MIN_Z) & (F.col("odds") > 1.0))
    model = Model({bytes(r["feature"]): float(r["odds"]) for r in chosen.collect()})
    _calibrate(model, source)
    return model


def _calibrate(model: Model, source: DataFrame) -> None:
    """Lambda and K from the clean rows' segments, then the logistic curve over all sampled rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Scores(model)
        for batch in batches:
            rows = []
            for y, t in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                w = tokens(t)
                found = model.segments(w, cache)
                single = [cache[x] for x in w if cache[x] > 0]
                rows.append({"y": y, "n": len(w), "segments": [s for _, _, s in found], "hits": single})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([
                ("y", pa.int32()), ("n", pa.int64()), ("segments", pa.list_(pa.float64())),
                ("hits", pa.list_(pa.float64()))]))

    seen = source.mapInArrow(scan, "y int, n long, segments array<double>, hits array<double>")
    # At most SAMPLE rows: the few numbers of each come to the driver.
    rows = seen.collect()
    clean = [r for r in rows if r["y"] == 0]
    n = sum(r["n"] for r in clean) + 1
    hits = np.array([h for r in clean for h in r["hits"]] + [3.0])
    low, high = 1e-3, 5.0
    for _ in range(60):
        mid = (low + high) / 2
        value = (np.exp(mid * hits).sum() + (n - len(hits)) * math.exp(mid * DRIFT)) / n
        low, high = (mid, high) if value < 1 else (low, mid)
    model.rate = max(low, 0.05)
    segments = np.array([s for r in clean for s in r["segments"]] + [1.0])
    model.k = float(np.exp(model.rate * np.minimum(segments, 20)).sum() / max(
        1.0, n * np.mean(model.rate * segments + 1)))
    model.k = min(1.0, max(1e-6, model.k))
    x = np.array([model.summary(r["n"], [(0, 0, s) for s in r["segments"]]) for r in rows])
    y = np.array([r["y"] for r in rows], float)
    ridge = np.diag([0.0, 1e-2, 1e-2, 1e-2, 1e-2])
    scale = np.array([1.0, 10.0, 10.0, 1.0, 5.0])
    x, w = x / scale, np.zeros(5)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge @ w
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + ridge + 1e-6 * np.eye(5), grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    model.bias = tuple(float(v) for v in w / scale)


def score_texts(docs: DataFrame, text: str, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Columns ``row`` (the columns in ``keep``, by default all) and ``out`` (see FIELDS), one row per row of ``docs``.

    ``segments`` are the significant passages, as token places. A null or empty text has no tokens and gets the
    score of no evidence. Extra columns stay inside ``row``, so none can clash.
    """

    def make(texts: list[bytes | None]) -> list[dict]:
        cache = _Scores(model)
        out = []
        for t in texts:
            w = tokens(t)
            found = model.segments(w, cache)
            x = model.summary(len(w), found)
            expect = [model.k * max(len(w), 1) * math.exp(-model.rate * s) for _, _, s in found]
            out.append({
                "score": model.probability(x), "n_tokens": len(w), "best_surprise": x[1],
                "segments": [{"start": a, "end": b, "score": s, "p_value": -math.expm1(-e)}
                             for (a, b, s), e in zip(found, expect, strict=True) if e < 1],
            })
        return out

    return rows_with(docs, text, make, FIELDS, keep)
