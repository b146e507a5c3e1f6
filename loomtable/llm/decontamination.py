"""Benchmark decontamination with suffix arrays over the training texts.

The training words of a task's slice form one array of word numbers, texts kept apart by a zero. Its suffix array holds
the suffixes in the order of their first ``window`` words. Every test suffix (each place of each item from which a
window starts) is searched in it by bisection: the suffixes that begin with the window are a range of the array and
give all places of that verbatim match. Runs of matching neighbours give the longest match.

Words that no item has are numbered zero, and only suffixes that start ``shortest window`` or more known words in a row
are put in the array: no other can match, so none is lost, and the array stays small beside the texts. Texts are
read once for each block of items, without a shuffle. A block of items is bounded (BLOCK_BYTES), so is what is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import rows_with

#: Bytes of benchmark text that are broadcast at once; more items make more passes over the texts.
BLOCK_BYTES = 8_000_000

FIELDS = ("n_words long, hits array<struct<start:long,end:long>>, items array<string>, longest long")

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z in lower case."""
    return (text or b"").translate(_TABLE).split()


class TestSuffixes:
    """The windows of a block of items, as sortable keys."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.window = window
        self.number: dict[bytes, int] = {}
        item, place, width, rows = [], [], [], []
        self.names = [name for name, _ in items]
        for at, (_, text) in enumerate(items):
            w = [self.number.setdefault(x, len(self.number) + 1) for x in words(text.encode())]
            if not w:
                continue
            size = min(window, len(w))
            for i in range(len(w) - size + 1):
                item.append(at)
                place.append(i)
                width.append(size)
                rows.append(w[i: i + size] + [0] * (window - size))
        self.item, self.place = np.array(item, np.int64), np.array(place, np.int64)
        self.width = np.array(width, np.int64)
        self.shortest = min(width, default=window)
        table = np.array(rows, np.uint32).reshape(len(rows), window)
        self.low = _keys(table)
        high = table.copy()
        high[np.arange(window)[None, :] >= self.width[:, None]] = 0xFFFFFFFF
        self.high = _keys(high)

    def search(self, texts: list[bytes | None]) -> list[dict]:
        numbers, sizes = [], []
        get = self.number.get
        for text in texts:
            w = words(text)
            sizes.append(len(w))
            one = np.zeros(len(w) + self.window, np.uint32)
            one[: len(w)] = np.fromiter((get(x, 0) for x in w), np.uint32, len(w))
            numbers.append(one)
        starts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) for x in numbers], out=starts[1:])
        out = [{"n_words": n, "hits": [], "items": [], "longest": 0} for n in sizes]
        if not len(self.item) or not numbers:
            return out
        line = np.concatenate(numbers)
        suffixes = _suffix_array(line, self.shortest, self.window)
        keys = _keys(line[suffixes[:, None] + np.arange(self.window)])
        order = np.argsort(keys, kind="stable")
        suffixes, keys = suffixes[order], keys[order]
        low = np.searchsorted(keys, self.low, "left")
        high = np.searchsorted(keys, self.high, "right")
        count = high - low
        which = np.repeat(np.arange(len(count)), count)
        if not len(which):
            return out
        spot = suffixes[np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]]
        doc = np.searchsorted(starts, spot, "right") - 1
        self._gather(out, doc, spot - starts[doc], which)
        return out

    def _gather(self, out: list[dict], doc: np.ndarray, spot: np.ndarray, which: np.ndarray) -> None:
        """Hit ranges, items and the longest match of each text, from its (place, window) pairs."""
        by = np.argsort(doc, kind="stable")
        doc, spot, which = doc[by], spot[by], which[by]
        cuts = np.flatnonzero(np.diff(doc)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(doc)], strict=True):
            s, w = spot[a:b], which[a:b]
            row = out[doc[a]]
            end = s + self.width[w]
            o = np.argsort(s, kind="stable")
            row["hits"] = merge(list(zip(s[o].tolist(), end[o].tolist(), strict=True)))
            row["items"] = sorted({str(self.names[i]) for i in np.unique(self.item[w]) if self.names[i] is not None})
            # Matches of one item on one diagonal with successive places are one longer match.
            o = np.lexsort((s, s - self.place[w], self.item[w]))
            item, diagonal, at = self.item[w][o], (s - self.place[w])[o], s[o]
            new = np.flatnonzero((np.diff(item) != 0) | (np.diff(diagonal) != 0) | (np.diff(at) != 1)) + 1
            first, last = np.r_[0, new], np.r_[new, len(o)] - 1
            row["longest"] = int((at[last] - at[first] + self.width[w][o][last]).max())


def merge(ranges: list[tuple[int, int]]) -> list[dict]:
    """Sorted ranges, those that touch or overlap joined."""
    out: list[list[int]] = []
    for a, b in ranges:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


def _keys(table: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort the same way."""
    wide = np.ascontiguousarray(table.astype(">u4"))
    return wide.view(f"S{4 * table.shape[1]}").ravel()


def _suffix_array(line: np.ndarray, shortest: int, window: int) -> np.ndarray:
    """Places from which at least ``shortest`` known words follow one another (not yet sorted)."""
    known = np.r_[0, np.cumsum(line > 0)]
    n = len(line) - window + 1
    return np.flatnonzero(known[shortest: shortest + n] - known[:n] == shortest)


def _blocks(items: DataFrame, item: str, text: str) -> Iterator[list[tuple[str | None, str]]]:
    """Items with words, in blocks of bounded size; one block is on the driver at a time."""
    block, size = [], 0
    rows = items.select(F.col(f"`{item}`").cast("string").alias("i"), F.col(f"`{text}`").alias("t"))
    for r in rows.filter(F.col("t").isNotNull()).toLocalIterator():
        n = len(r["t"].encode())
        if block and size + n > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += n
    if block:
        yield block


def overlaps(
    docs: DataFrame, items: DataFrame, text: str, item: str, item_text: str, window: int = 10,
    keep: list[str] | None = None,
) -> DataFrame:
    """Columns ``row`` (the columns in ``keep``, by default all) and ``out`` (see FIELDS), one row per row of ``docs``.

    ``hits`` are the merged ranges of words inside an occurrence of any window of any item, ``items`` the ids (as text,
    sorted) of the items with occurring windows, ``longest`` the words of the longest verbatim match. An item shorter
    than the window is one window; an item without words, or a null one, has none. A null or empty text has no words.
    An item without id marks words but is not listed. Without items nothing is hit. Names can't clash: see ``row``.
    """
    sc = docs.sparkSession.sparkContext
    blocks = [sc.broadcast(TestSuffixes(b, window)) for b in _blocks(items, item, item_text)]
    blocks = blocks or [sc.broadcast(TestSuffixes([], window))]
    made = None
    for block in blocks:
        def search(texts: list[bytes | None], held=block) -> list[dict]:
            return held.value.search(texts)

        if made is None:
            made = rows_with(docs, text, search, FIELDS, keep if len(blocks) == 1 or keep is None else [
                *keep, *[c for c in [text] if c not in keep]])
            continue
        again = made.select("row", "out", F.col(f"row.`{text}`").alias("text"))
        again = rows_with(again, "text", search, FIELDS, ["row", "out"])
        both = F.array_sort(F.concat("row.out.hits", "out.hits"))
        made = again.select(F.col("row.row").alias("row"), F.struct(
            F.col("out.n_words"), _merged(both).alias("hits"),
            F.array_sort(F.array_union("row.out.items", "out.items")).alias("items"),
            F.greatest("row.out.longest", "out.longest").alias("longest")).alias("out"))
    if len(blocks) > 1 and keep is not None:
        made = made.select(F.struct(*[F.col(f"row.`{c}`") for c in keep]).alias("row"), "out")
    return made


def _merged(ranges):
    """Sorted ranges of an array column, those that touch or overlap joined."""

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        head = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        meets = F.coalesce(last["end"] >= x["start"], F.lit(False))
        return F.when(meets, F.concat(head, F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(ranges, F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"), step)


def clean_documents(
    docs: DataFrame, items: DataFrame, text: str, item: str, item_text: str, window: int = 10,
) -> DataFrame:
    """The rows of ``docs``, columns unchanged, in which no window of any item occurs."""
    return overlaps(docs, items, text, item, item_text, window).filter(F.size("out.hits") == 0).select("row.*")
