"""Quality rules on repetition: the share of a text inside repeated n-grams and lines.

Words become 64-bit hashes, one per distinct word of a text. For each n-gram length a rolling polynomial hash over
them gives every window in one vectorised pass; windows whose hash is found twice mark their words, first
occurrence included, and the marked words' characters are divided by all word characters. Windows of three words are
compared exactly, as three word numbers packed in one integer. Work on a text is linear but for the sort of its hashes.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from .shared import rows_with

#: Highest share of word characters inside repeated n-grams, by n, for a text to be kept. The first occurrence counts
#: too, so the limits are twice those usual for the later ones alone.
LIMITS = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
#: Most symbols for each word.
SYMBOL_LIMIT = 0.2
#: Highest share of lines, and of their characters, that equal an earlier line.
LINE_LIMIT, LINE_CHAR_LIMIT = 0.30, 0.20

FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, "
          "dup_line_chars long, coverage map<int,double>, base_failed boolean, kept boolean")

_SYMBOLS = bytes(b"#*$%&|<>")
_NOT_SYMBOLS = bytes(sorted(set(range(256)) - set(_SYMBOLS)))
_LINE_WORD = re.compile(rb"[^\x20\x09-\x0D]")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _code_points(data: bytes) -> int:
    return len(data) if data.isascii() else len(data.decode("utf-8", "replace"))


def repeated_words(keys: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in a window of ``n`` words whose key is found twice or more; ``keys`` has one per window."""
    marked = np.zeros(len(keys) + n - 1, bool)
    _, place, count = np.unique(keys, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[place] > 1)
    if len(starts):
        steps = np.zeros(len(marked) + 1, np.int64)
        np.add.at(steps, starts, 1)
        np.add.at(steps, starts + n, -1)
        marked = np.cumsum(steps)[:-1] > 0
    return marked


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes, modulo 2^64, of all windows of ``n``: each from the window one shorter."""
    out = hashes[: len(hashes) - n + 1].copy()
    for i in range(1, n):
        out *= _BASE
        out += hashes[i: len(hashes) - n + 1 + i]
    return out


def measure(text: bytes | None, lengths: tuple[int, ...] = tuple(LIMITS)) -> dict:
    """The counts and shares of one text."""
    data = text or b""
    words = data.split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    sizes = [_code_points(w) for w in number]
    chars = np.array(sizes, np.int64)[ids] if words else np.zeros(0, np.int64)
    total = int(chars.sum())
    if len(words) >= 3:
        if len(number) < 1 << 21:
            keys = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
        else:
            keys = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True)[1].ravel()
        repeats = int(repeated_words(keys, 3).sum())
    else:
        repeats = 0
    coverage = {}
    if len(words) > min(lengths, default=0):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        distinct = len(number)
        for n in lengths:
            if len(words) <= n:
                break
            # With all words different no window can repeat.
            share = 0.0 if distinct == len(words) else float(
                chars[repeated_words(rolling(mixed, n), n)].sum()) / max(total, 1)
            coverage[n] = share
    lines = [x for x in data.split(b"\n") if _LINE_WORD.search(x)]
    seen: set[bytes] = set()
    dup = dup_chars = line_chars = 0
    for line in lines:
        size = _code_points(line)
        line_chars += size
        if line in seen:
            dup += 1
            dup_chars += size
        seen.add(line)
    n_words = len(words)
    failed = n_words < 50 or 100 * repeats > 50 * n_words
    symbols = len(data.translate(None, _NOT_SYMBOLS))
    kept = not failed and symbols <= SYMBOL_LIMIT * n_words and all(
        coverage.get(n, 0.0) <= LIMITS.get(n, 1.0) for n in lengths)
    kept = kept and dup <= LINE_LIMIT * len(lines) and dup_chars <= LINE_CHAR_LIMIT * line_chars
    return {
        "n_words": n_words, "word_chars": total, "n_symbols": symbols,
        "n_dup_lines": dup, "n_repeat_words": repeats, "n_lines": len(lines), "dup_line_chars": dup_chars,
        "coverage": list(coverage.items()), "base_failed": failed, "kept": kept,
    }


def repetition_rules(docs: DataFrame, text: str, keep: list[str] | None = None) -> DataFrame:
    """Columns ``row`` (the columns in ``keep``, by default all) and ``out`` (see FIELDS), one row per row of ``docs``.

    Words are maximal runs without ASCII white space. A null or empty text has no words and fails the base rule.
    ``coverage`` has a share for each n-gram length below the number of words. Names in ``row`` and ``out`` can't clash.
    """
    return rows_with(docs, text, lambda texts: [measure(t) for t in texts], FIELDS, keep)
