"""Near-duplicates by SimHash fingerprints and BK-trees.

Each bit of a fingerprint is the majority of that bit over the hashes of the text's shingles. Different fingerprints
are cut into shards: with ``bands`` parts of the 64 bits, two within ``radius`` bits agree on at least
``bands - radius`` parts, so for every choice of that many parts the fingerprints with equal bits there are a shard,
and each linked pair meets in one. A shard is a BK-tree (children keyed by integer Hamming distance to the parent;
a search follows only edges within the radius), held in one task. Shards above TREE_SIZE are cut into blocks: each
tree block is searched by the members of every block, one task for a pair of blocks, so no task grows with a shard.

One tree of all fingerprints sent everywhere would grow with the data and be searched by every row in full. Sending
each member only to the trees that can hold a neighbour loses nothing (pigeonhole).

Where a similarity is asked for (``alike``), the Jaccard index of the two texts' sets of longer shingles decides, counted
from the texts. A pair of that similarity may be many bits apart, so shards then hold what agrees in one of BANDS pieces
of a signature (the least values of SIGNATURE hash functions over the set): at 0.8 two texts miss each other in all
pieces once in four thousand times. In a shard the tree is searched within ``reach`` bits, signatures rule out what lies
far below (SLACK), and the rest is counted, in rounds: a task returns only pairs that span its members, the best
estimates first; those alike by count make classes; the next round asks for pairs between classes that were not counted
yet. So a group of copies costs few counts. Units that still have a refused pair after MAX_ROUNDS get the texts of their
members: the task itself counts what is left between classes and returns only links that join two of them. So no pair
between two classes stays uncounted, yet rows and texts grow with the members of a shard and not with its pairs.

Without ``alike``, a task returns links that span what it found, at most one per member; components come from rounds of
large-star and small-star steps on those links, each written to the shared folder.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, rows_with

#: Members of one BK-tree.
TREE_SIZE = 2048
#: Bytes of a signature, one for each hash function; the similarity read from it has a standard error of 0.05 at 0.8.
SIGNATURE = 64
#: A pair whose estimate is lower than asked for by more than this (three standard errors) is not counted.
SLACK = 0.15
#: Pieces of a signature, any of which brings two texts together, and how many are searched first.
BANDS, FIRST_BANDS = 16, 4
#: Larger units are first thinned: a member this similar to an earlier one is linked to that one alone.
SMALL_UNIT, SURE = 64, 0.85
#: Rounds over shards with a refused pair, before a task counts all that is left between their classes.
MAX_ROUNDS = 2

_MIX = np.random.default_rng(7).integers(0, 1 << 63, (2, SIGNATURE), np.uint64) | np.uint64(1)


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """The SimHash of the shingles of ``size`` words, repeats included (fewer words: one shingle; none: 0)."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    return fingerprints([text], size)[0]


def fingerprints(texts: list[bytes | None], size: int) -> list[int]:
    hashes: list[int] = []
    starts = []
    digest = xxhash.xxh64_intdigest
    for text in texts:
        words = (text or b"").lower().split()
        starts.append(len(hashes))
        if len(words) > size:
            hashes.extend([digest(b" ".join(z), 42) for z in zip(*(words[i:] for i in range(size)), strict=False)])
        elif words:
            hashes.append(digest(b" ".join(words), 42))
    starts.append(len(hashes))
    h = np.array(hashes, np.uint64)
    out = []
    for a, b in zip(starts, starts[1:], strict=False):
        ones = np.zeros(64, np.int64)
        for i in range(a, b, 100_000):
            part = np.unpackbits(h[i: min(b, i + 100_000)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones += part.sum(0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > b - a).tobytes(), "big"))
    return out


def signatures(texts: list[bytes | None], size: int) -> list[bytes]:
    """For each text the low bytes of the least values of SIGNATURE hash functions over its set of shingles of ``size``
    words (fewer words: one shingle; none: an empty one). The share of equal bytes estimates the sets' Jaccard index."""
    digest = xxhash.xxh64_intdigest
    out = []
    for text in texts:
        words = (text or b"").lower().split()
        n = max(len(words) - size + 1, 1)
        least = np.full(SIGNATURE, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, n, 10_000):
            block = (digest(b" ".join(words[j: j + size]), 42) for j in range(i, min(n, i + 10_000)))
            h = np.fromiter(block, np.uint64, min(n, i + 10_000) - i)
            h ^= h >> np.uint64(32)
            np.minimum(least, (h[:, None] * _MIX[0] + _MIX[1]).min(0), out=least)
        out.append((least >> np.uint64(24)).astype(np.uint8).tobytes())
    return out


def similarity(a: bytes, b: bytes) -> float:
    """The Jaccard index estimated from two signatures."""
    return float((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean())


def shingle_ids(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """For each text the numbers of its different shingles of ``size`` words (fewer words: one shingle), from 0 over all
    texts. Shingles are told apart by a 64-bit hash."""
    digest = xxhash.xxh64_intdigest
    sets = []
    for text in texts:
        words = (text or b"").lower().split()
        n = max(len(words) - size + 1, 1)
        sets.append(np.unique(np.fromiter((digest(b" ".join(words[j: j + size])) for j in range(n)), np.uint64, n)))
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    return np.split(ids, np.cumsum([len(x) for x in sets])[:-1])


class BKTree:
    """Different 64-bit numbers under the Hamming distance."""

    def __init__(self) -> None:
        self.root: int | None = None
        self.children: dict[int, dict[int, int]] = {}

    def add(self, value: int) -> None:
        if self.root is None:
            self.root, self.children[value] = value, {}
            return
        at = self.root
        while True:
            d = (at ^ value).bit_count()
            if d == 0:
                return
            nxt = self.children[at].get(d)
            if nxt is None:
                self.children[at][d] = value
                self.children[value] = {}
                return
            at = nxt

    def within(self, value: int, radius: int) -> list[int]:
        found, todo = [], [] if self.root is None else [self.root]
        while todo:
            at = todo.pop()
            d = (at ^ value).bit_count()
            if d <= radius:
                found.append(at)
            edges = self.children[at]
            if edges:
                if len(edges) <= 2 * radius + 1:
                    todo.extend(child for e, child in edges.items() if d - radius <= e <= d + radius)
                else:
                    todo.extend(edges[e] for e in range(d - radius, d + radius + 1) if e in edges)
        return found


def _root(parent: dict[int, int], x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def shard_links(
    tree: list[int], queries: list[int], radius: int,
) -> list[tuple[int, int]]:
    """Links that join what the queries find in the tree: pairs (member, lowest member linked to it)."""
    bk = BKTree()
    for v in tree:
        bk.add(v)
    parent: dict[int, int] = {}
    for v in queries:
        for u in bk.within(v, radius):
            a, b = _root(parent, u), _root(parent, v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [(x, r) for x in parent if (r := _root(parent, x)) != x]


@dataclass
class Unit:
    """Members of a shard, or of two of its blocks: ids, fingerprints, signatures, classes, and refused partners."""

    fp: list[int]
    print: list[int]
    sig: np.ndarray
    group: list[int]
    refused: list[set[int]]
    tree: list[int]
    query: list[int]
    reach: int
    floor: float

    def _near(self, bk: BKTree, at: dict[int, list[int]], i: int) -> tuple[np.ndarray, np.ndarray]:
        """Members of the tree that member ``i`` may be alike to, and the estimates."""
        found = [j for v in bk.within(self.print[i], self.reach) for j in at[v]
                 if self.group[j] != self.group[i] and self.fp[j] not in self.refused[i]]
        if not found:
            return np.array([], int), np.array([])
        near = np.array(found)
        estimate = (self.sig[near] == self.sig[i]).mean(1)
        keep = estimate >= self.floor
        return near[keep], estimate[keep]

    def _tree(self, members: list[int]) -> tuple[BKTree, dict[int, list[int]]]:
        bk, at = BKTree(), defaultdict(list)
        for i in members:
            bk.add(self.print[i])
            at[self.print[i]].append(i)
        return bk, at

    def thinned(self) -> list[tuple[int, int]]:
        """One pair for each member that is nearly the same as an earlier one; the others make up the tree."""
        bk, at = self._tree([])
        tree, out = set(self.tree), []
        for i in sorted({*self.tree, *self.query}, key=lambda i: self.fp[i]):
            near, estimate = self._near(bk, at, i)
            if len(near) and estimate.max() >= SURE:
                out.append((i, int(near[estimate.argmax()])))
            elif i in tree:
                bk.add(self.print[i])
                at[self.print[i]].append(i)
        return out

    def links(self, texts: list[bytes | None], band: int, size: int, alike: float) -> list[tuple[int, int]]:
        """Pairs alike by count that join two classes, at most one for each class but one; ``group`` is joined as well.

        All pairs between classes are counted that have not been refused, each in the unit of the first of the pieces
        that its signatures share.
        """
        members = defaultdict(list)
        for i, g in enumerate(self.group):
            members[g].append(i)
        largest = set(max(members.values(), key=len))
        alone = self.tree == self.query  # a block with itself: each member meets the earlier ones
        whole = self._tree([] if alone else self.tree)
        others = self._tree([] if alone else [i for i in self.tree if i not in largest])
        sets = shingle_ids(texts, size)
        here = np.zeros(max(int(x.max()) for x in sets) + 1, bool)
        out = []
        for i in self.query:
            near, estimate = self._near(*(others if i in largest else whole), i)
            if len(near):
                same = (self.sig[near] == self.sig[i]).reshape(len(near), BANDS, -1).all(2)
                first = same.argmax(1) == band
                near = near[first][np.argsort(-estimate[first], kind="stable")]
            here[sets[i]] = True
            for j in near.tolist():
                if self.group[i] == self.group[j]:
                    continue
                common = int(np.count_nonzero(here[sets[j]]))
                if common / (len(sets[i]) + len(sets[j]) - common) >= alike:
                    out.append((i, j))
                    more, less = sorted((self.group[i], self.group[j]), key=lambda g: -len(members[g]))
                    for k in members[less]:
                        self.group[k] = more
                    members[more] += members.pop(less)
            here[sets[i]] = False
            if alone:
                for bk, at in [whole] if i in largest else [whole, others]:
                    bk.add(self.print[i])
                    at[self.print[i]].append(i)
        return out

    def pairs(self) -> list[tuple[int, int]]:
        """Pairs between classes that may be alike and span them, best estimates first.

        A pair has an end outside the largest class. So that class's members are only searched for in the tree of
        the others, and a unit of one class costs nothing.
        """
        sizes = Counter(self.group)
        if len(sizes) < 2:
            return []
        largest = sizes.most_common(1)[0][0]
        whole = self._tree(self.tree)
        others = self._tree([i for i in self.tree if self.group[i] != largest])
        rows, cols, marks = [], [], []
        for i in self.query:
            trees = others if self.group[i] == largest else whole
            if trees[1]:
                near, estimate = self._near(*trees, i)
                rows.append(np.full(len(near), i))
                cols.append(near)
                marks.append(estimate)
        if not rows:
            return []
        a, b, mark = np.concatenate(rows), np.concatenate(cols), np.concatenate(marks)
        parent: dict[int, int] = {}
        out, left = [], len(sizes) - 1
        values = np.array(self.fp, np.uint64)
        for k in np.lexsort((np.maximum(values[a], values[b]), np.minimum(values[a], values[b]), -mark)).tolist():
            x, y = _root(parent, self.group[a[k]]), _root(parent, self.group[b[k]])
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(a[k]), int(b[k])))
                left -= 1
                if not left:
                    break
        return out


def jaccard(a: bytes | None, b: bytes | None, size: int) -> float:
    """The Jaccard index of the sets of shingles of ``size`` words (fewer words: one shingle)."""
    x, y = (set(zip(*(w[i:] for i in range(size)), strict=False)) or {tuple(w)}
            for w in ((t or b"").lower().split() for t in (a, b)))
    return len(x & y) / len(x | y)


def _members(heads: DataFrame) -> DataFrame:
    """The members of all units: fp, print, sig, band, unit, shard, t, q, in_tree, in_query; shards of one member are left out."""
    width = SIGNATURE // BANDS
    pieces = F.array(*[F.struct(F.lit(i).alias("band"),
                                F.xxhash64(F.lit(i), F.substring("sig", i * width + 1, width)).alias("shard"))
                       for i in range(BANDS)])
    placed = heads.select("fp", F.explode(pieces).alias("p")).select("fp", "p.*")
    sizes = materialize(placed.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1"), "shards")
    met = _in_units(placed.join(sizes, "shard"), ["fp", "band"])
    return materialize(met.join(heads, "fp"), "members")


def _search(members: DataFrame, reach: int, floor: float, pairs_of: Callable[[Unit, pd.DataFrame], list]) -> DataFrame:
    """(a, b, unit) pairs of each unit of two classes or more, by ``pairs_of`` a unit and its rows."""
    more = [c for c in ("band", "text") if c in members.columns]
    flat = members.repartition("unit").sortWithinPartitions("unit", "shard", "t", "q").select(
        "fp", "print", "sig", "group", "refused", "unit", "shard", "t", "q", "in_tree", "in_query", *more)

    def found(frame: pd.DataFrame, cut: np.ndarray) -> pd.DataFrame:
        fp = frame["fp"].to_numpy().view(np.uint64).tolist()
        prints, group = (frame[c].to_numpy().view(np.uint64).tolist() for c in ("print", "group"))
        tree, query, units = frame["in_tree"].to_numpy(), frame["in_query"].to_numpy(), frame["unit"].to_numpy()
        sig, refused = frame["sig"].tolist(), frame["refused"].tolist()
        out: list[tuple] = []
        ends = [0, *cut.tolist(), len(fp)]
        for x, y in zip(ends, ends[1:], strict=False):
            if len(set(group[x:y])) < 2:
                continue
            one = Unit(
                fp[x:y], prints[x:y], np.frombuffer(b"".join(sig[x:y]), np.uint8).reshape(-1, SIGNATURE), group[x:y],
                [set() if r is None else {v & (1 << 64) - 1 for v in r.tolist()} for r in refused[x:y]],
                np.flatnonzero(tree[x:y]).tolist(), np.flatnonzero(query[x:y]).tolist(), reach, floor)
            out.extend((max(one.fp[i], one.fp[j]), min(one.fp[i], one.fp[j]), units[x])
                       for i, j in pairs_of(one, frame.iloc[x:y]))
        ab = np.array([x[:2] for x in out], np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": ab[:, 0], "b": ab[:, 1], "unit": np.array([x[2] for x in out], np.int64)})

    return flat.mapInPandas(lambda frames: _each_unit(frames, ["unit", "shard", "t", "q"], found),
                            "a long, b long, unit long").distinct()


def alike_links(
    heads: DataFrame, texts_of: Callable[[DataFrame], DataFrame], reach: int, alike: float, size: int,
) -> DataFrame:
    """(a, b) links that connect all of ``heads`` (fp, print, sig) whose texts are ``alike``. ``fp`` names a text,
    ``print`` is its fingerprint; ``texts_of`` gives the texts (fp, text) for a table of fp."""
    spark = heads.sparkSession
    members = _members(heads)
    texts = materialize(texts_of(members.select("fp").distinct()), "texts")
    refused = spark.createDataFrame([], "a long, b long")
    classes = spark.createDataFrame([], "node long, component long")
    small = SMALL_UNIT  # goes with the functions to the tasks

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = [jaccard(x, y, size) >= alike for x, y in zip(frame["text_a"], frame["text_b"], strict=True)]
            yield frame[["a", "b"]].assign(good=np.array(keep, bool))

    def thin(unit: Unit, rows: pd.DataFrame) -> list[tuple[int, int]]:
        return unit.thinned() if len(rows) > small else []

    def span(unit: Unit, rows: pd.DataFrame) -> list[tuple[int, int]]:
        return unit.pairs()

    def count(unit: Unit, rows: pd.DataFrame) -> list[tuple[int, int]]:
        return unit.links(rows["text"].tolist(), int(rows["band"].iloc[0]), size, alike)

    def search(part: DataFrame, pairs_of: Callable, label: str) -> DataFrame:
        """The pairs (a, b, unit) of each unit, which knows the classes and the refused pairs."""
        both = refused.union(refused.select("b", "a"))
        known = both.groupBy(F.col("a").alias("fp")).agg(F.collect_set("b").alias("refused"))
        part = part.join(classes.withColumnRenamed("node", "fp"), "fp", "left").join(known, "fp", "left")
        part = part.withColumn("group", F.coalesce("component", "fp"))
        return materialize(_search(part, reach, alike - SLACK, pairs_of), label)

    def join_classes(good: DataFrame) -> None:
        nonlocal classes
        if not good.isEmpty():
            classes = materialize(components(classes.toDF("a", "b").union(good)), "classes")

    def judge(found: DataFrame) -> DataFrame:
        """The pairs found, with whether they are alike by count; they are taken in."""
        nonlocal refused
        both = found.select("a", "b").distinct()
        for c in ("a", "b"):
            both = both.join(texts.select(F.col("fp").alias(c), F.col("text").alias(f"text_{c}")), c)
        judged = both.mapInPandas(run, "a long, b long, good boolean")
        judged = materialize(found.join(judged, ["a", "b"]), "counted")
        refused = refused.union(judged.filter("not good").select("a", "b").distinct())
        join_classes(judged.filter("good").select("a", "b").distinct())
        return judged

    first = F.col("band") < FIRST_BANDS
    judge(search(members.filter(first), thin, "candidates"))
    for chosen in (first, ~first):
        part = members.filter(chosen)
        for _ in range(MAX_ROUNDS):
            judged = judge(search(part, span, "candidates"))
            again = judged.filter("not good").select("unit").distinct()
            if again.isEmpty():
                break
            part = members.join(again, "unit", "left_semi")
        else:
            join_classes(search(part.join(texts, "fp"), count, "linked").select("a", "b"))
    return classes.select(F.col("node").alias("a"), F.col("component").alias("b"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _in_units(met: DataFrame, carried: list[str]) -> DataFrame:
    """Members of shards (``fp``, ``shard`` and its size ``n``) once for each unit they take part in. A unit is a tree
    block ``t`` and a query block ``q`` of a shard; ``unit`` names it in one long."""
    blocks = F.ceil(F.col("n") / TREE_SIZE)
    own = F.pmod(F.xxhash64("fp"), blocks)
    met = met.select(*carried, "shard", blocks.alias("blocks"), own.alias("own"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        F.least("own", j).alias("t"), F.greatest("own", j).alias("q")))
    sent = met.select(*carried, "shard", "own", F.explode(pairs).alias("at"))
    return sent.select(*carried, F.xxhash64("shard", "at").alias("unit"), "shard", "at.*",
                       (F.col("own") == F.col("at.t")).alias("in_tree"),
                       (F.col("own") == F.col("at.q")).alias("in_query"))


def _each_unit(
    frames: Iterator[pd.DataFrame], keys: list[str], found: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame],
) -> Iterator[pd.DataFrame]:
    """``found`` of whole units, of rows sorted by unit: the last unit of a frame may go on in the next one."""
    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        key = frame[keys].to_numpy()
        cut = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        last = int(cut[-1]) if len(cut) else 0
        if last:
            yield found(frame.iloc[:last], cut[:-1])
        rest = frame.iloc[last:]
    if rest is not None:
        yield found(rest, np.array([], int))


def links(prints: DataFrame, radius: int, bands: int) -> DataFrame:
    """(a, b) links between the different fingerprints ``fp`` (signed longs): they span what lies within the radius."""
    if not radius < bands <= 64:
        raise ValueError("there must be more bands than the radius")
    edges = np.linspace(0, 64, bands + 1).astype(int)
    masks = []
    for parts in combinations(range(bands), bands - radius):
        mask = sum(((1 << int(edges[p + 1])) - (1 << int(edges[p]))) for p in parts)
        masks.append(_signed(mask))
    keys = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits"))
                     for i, m in enumerate(masks)])
    members = prints.select("fp", F.explode(keys).alias("shard"))
    sizes = members.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = materialize(sizes, "shards").withColumnRenamed("shard", "big")
    met = members.join(sizes, members["shard"] == sizes["big"])
    # Tasks read the units in order.
    sent = _in_units(met, ["fp"]).repartition("unit").sortWithinPartitions("unit", "shard", "t", "q")
    flat = sent.select("fp", F.col("shard.mask").alias("m"), F.col("shard.bits").alias("s"), "t", "q",
                       "in_tree", "in_query")

    def found(frame: pd.DataFrame, cut: np.ndarray) -> pd.DataFrame:
        fp = frame["fp"].to_numpy().view(np.uint64).tolist()
        tree, query = frame["in_tree"].tolist(), frame["in_query"].tolist()
        out: list[tuple] = []
        ends = [0, *cut.tolist(), len(fp)]
        for a, b in zip(ends, ends[1:], strict=False):
            if b - a == 2 and tree[a] and tree[a + 1] and query[a]:
                if (fp[a] ^ fp[a + 1]).bit_count() <= radius:
                    out.append((fp[a], fp[a + 1]))
            elif b - a > 1:
                out.extend(shard_links([fp[i] for i in range(a, b) if tree[i]],
                                       [fp[i] for i in range(a, b) if query[i]], radius))
        pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return flat.mapInPandas(lambda frames: _each_unit(frames, ["m", "s", "t", "q"], found),
                            "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable over (a, b) edges, for every node that has one.

    Large-star joins each node's larger neighbours to its least one, small-star the smaller ones; both are a
    grouped minimum and a join. They repeat until no edge changes.
    """
    edges = materialize(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(edges)
    for _ in range(rounds):
        if state[0] == 0:
            break
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "n")
        large = edges.join(least, edges["b"] == least["n"]).select("a", F.col("m").alias("b"))
        large = materialize(large.filter("a <> b").distinct(), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(least, large["a"] == least["n"]).select("a", "b", "m")
        small = small.select(F.explode(F.array(
            F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")),
            F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = materialize(small.filter("a <> b").distinct(), "links")
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def near_duplicates(
    docs: DataFrame, text: str, key: str, size: int = 3, radius: int = 2, bands: int = 4,
    keep: list[str] | None = None, reach: int | None = None, alike: float | None = None, alike_words: int = 5,
) -> DataFrame:
    """Columns ``row`` (the columns in ``keep``, by default all), ``fp`` (signed), ``component`` and ``first``.

    ``component`` is the least ``key`` over all rows whose fingerprints are reachable by links of at most ``radius``
    differing bits. With ``alike`` a link is that similarity of the sets of shingles of ``alike_words`` words, between
    texts that share a piece of their signatures and have fingerprints within ``reach`` bits; texts of the same words
    are always linked, and ``radius`` and ``bands`` play no part. ``first`` is true for one row of each component: the
    one with that key, and among repeated rows with that key one of them. Rows without key count, but give no name: a component of such rows only has a null name.
    A null or empty text has no words: its fingerprint is zero, linked like any other. Names in ``row`` can't clash.
    """
    def make(texts: list[bytes | None]) -> list[dict]:
        found = [_signed(f) for f in fingerprints(texts, size)]
        if alike is None:
            return [{"fp": f} for f in found]
        # Different texts may have one fingerprint, so here a hash of the words names a text.
        names = [_signed(xxhash.xxh64_intdigest(b" ".join((t or b"").lower().split()), 7)) for t in texts]
        return [{"fp": n, "print": f, "sig": s}
                for n, f, s in zip(names, found, signatures(texts, alike_words), strict=True)]

    names = docs.columns if keep is None else keep
    carried = [*names, *[c for c in [key, *([] if alike is None else [text])] if c not in names]]
    carried = list(dict.fromkeys(carried))
    fields = "fp long" if alike is None else "fp long, print long, sig binary"
    prints = rows_with(docs, text, make, fields, carried).select("row", "out.*")
    prints = materialize(prints.select("*", F.xxhash64("row", F.monotonically_increasing_id()).alias("tie")),
                         "fingerprints")
    k = F.col(f"row.`{key}`")
    # The first row of a fingerprint: the least key, nulls last, then the least tie number.
    order = F.struct(k.isNull().alias("none"), k.alias("key"), F.col("tie"))
    made = [F.min(order).alias("head")] if alike is None else [
        F.min(order).alias("head"), F.first("print").alias("print"), F.first("sig").alias("sig")]
    heads = materialize(prints.groupBy("fp").agg(*made), "heads")
    if alike is None:
        found = links(heads.drop("head"), radius, bands)
    else:
        def texts_of(wanted: DataFrame) -> DataFrame:
            at = heads.join(wanted, "fp", "left_semi").select(F.col("fp").alias("f"), F.col("head.tie").alias("t"))
            return prints.join(at, (prints["fp"] == at["f"]) & (prints["tie"] == at["t"])).select(
                "fp", F.col(f"row.`{text}`").cast("binary").alias("text"))

        found = alike_links(heads.select("fp", "print", "sig"), texts_of, radius if reach is None else reach, alike, alike_words)
    joined = components(found)
    named = heads.join(joined, heads["fp"] == joined["node"], "left").select(
        "fp", "head", F.coalesce("component", "fp").alias("group"))
    best = materialize(named.groupBy("group").agg(F.min("head").alias("best")).withColumnRenamed("group", "g"), "best")
    named = materialize(named.join(best, named["group"] == best["g"]).select(
        F.col("fp").alias("f"), "best"), "components")
    out = prints.join(named, prints["fp"] == named["f"])
    row = F.struct(*[F.col(f"row.`{c}`") for c in names]).alias("row")
    return out.select(row, F.col("fp" if alike is None else "print").alias("fp"), F.col("best.key").alias("component"), (F.col("tie") == F.col("best.tie")).alias("first"))


def one_of_each(
    docs: DataFrame, text: str, key: str, size: int = 3, radius: int = 2, bands: int = 4, reach: int | None = None,
    alike: float | None = None,
) -> DataFrame:
    """The rows of ``docs``, columns unchanged, that are the first of their component."""
    found = near_duplicates(docs, text, key, size, radius, bands, reach=reach, alike=alike)
    return found.filter("first").select("row.*")
