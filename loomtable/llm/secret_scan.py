"""Secrets in texts: keywords by an Aho-Corasick automaton, anchored patterns at their hits, checksums where there are.

One pass of the automaton over a text in lower case gives the places of all keywords. Only there are patterns tried,
each anchored at its keyword, so the patterns' cost grows with the hits. Three base rules (assignments, access keys,
long hex numbers) give spans that always stay; hex numbers have no keyword and are found by their length. Tokens with
an embedded checksum are added where the checksum holds, which a random text passes once in a billion times or less:

* ``github``, ``npm``: a prefix, 30 characters and their CRC-32 in base 62;
* ``xprv``: Base58Check, the double SHA-256 of an extended private key;
* ``age``, ``nsec``: Bech32, a BCH code over prefix and data.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import rows_with

KINDS = ("assign", "access", "hex", "github", "npm", "xprv", "age", "nsec")
BASE_KINDS = 3

# Fixed values of the rules and formats.
ASSIGN = r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]{24,}"
MIN_VALUE, MIN_ACCESS = 6, 20
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_STEPS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
XPRV_HEADS, XPRV_BYTES = {0x0488ADE4, 0x04358394}, 82


def crc_holds(token: str) -> bool:
    """Whether the last six characters are the base-62 CRC-32 of those between the prefix and them."""
    body, check = token[-36:-6], 0
    for c in token[-6:]:
        check = check * 62 + BASE62.index(c)
    return check == zlib.crc32(body.encode())


def base58_holds(token: str) -> bool:
    """Whether a token is an extended private key in Base58Check."""
    number = 0
    for c in token:
        number = number * 58 + BASE58.index(c)
    if number.bit_length() > 8 * XPRV_BYTES:
        return False
    raw = number.to_bytes(XPRV_BYTES, "big")
    check = hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4]
    return int.from_bytes(raw[:4], "big") in XPRV_HEADS and check == raw[-4:]


def bech32_holds(token: str) -> bool:
    """Whether a token's Bech32 checksum holds; mixed case never does."""
    if token != token.lower() and token != token.upper():
        return False
    prefix, _, data = token.lower().rpartition("1")
    values = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [BECH32.index(c) for c in data]
    state = 1
    for v in values:
        top, state = state >> 25, (state & 0x1FFFFFF) << 5 ^ v
        for i, step in enumerate(BECH32_STEPS):
            state ^= step if top >> i & 1 else 0
    return state == 1


def _assigned(match: re.Match) -> bool:
    return len(match[2]) >= MIN_VALUE


def _checked(holds):
    return lambda match: holds(match[0])


_END58, _END62 = f"(?![{BASE58}])", "(?![A-Za-z0-9])"
#: For each keyword (in lower case) the kind, the pattern tried at its place, and what the match must fulfil.
RULES = {
    **dict.fromkeys(("password", "passwd", "secret", "token", "apikey", "api_key"),
                    (0, re.compile(ASSIGN), _assigned)),
    "akia": (1, re.compile(ACCESS), lambda m: len(m[0]) >= MIN_ACCESS),
    **{f"gh{c}_": (3, re.compile(f"gh{c}_[A-Za-z0-9]{{36}}{_END62}"), _checked(crc_holds)) for c in "pousr"},
    "npm_": (4, re.compile(f"npm_[A-Za-z0-9]{{36}}{_END62}"), _checked(crc_holds)),
    **{p: (5, re.compile(f"{p}[{BASE58}]{{107}}{_END58}"), _checked(base58_holds)) for p in ("xprv", "tprv")},
    "age-secret-key-1": (6, re.compile(f"(?ai:age-secret-key-1[{BECH32}]{{58}}){_END62}"), _checked(bech32_holds)),
    "nsec1": (7, re.compile(f"(?ai:nsec1[{BECH32}]{{58}}){_END62}"), _checked(bech32_holds)),
}
_HEX = re.compile(HEX)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_AUTOMATON = []


def automaton() -> ahocorasick.Automaton:
    """The keywords' automaton, built once in each Python worker."""
    if not _AUTOMATON:
        made = ahocorasick.Automaton()
        for word, (kind, pattern, fits) in RULES.items():
            made.add_word(word, (len(word), kind, pattern, fits))
        made.make_automaton()
        _AUTOMATON.append(made)
    return _AUTOMATON[0]


def find(raw: bytes | None) -> dict[str, list[dict[str, int]]]:
    """``base`` and ``spans`` of a UTF-8 text: (start, kind, end), sorted; places count code points.

    Matches of a kind are the leftmost ones that don't overlap. One that fails its length or checksum is dropped, and
    the search goes on behind it. No keyword holds another of its kind, so hits by end are hits by start as well.
    """
    if not raw:
        return {"base": [], "spans": []}
    text = raw.decode()
    spans, done = [], [0] * len(KINDS)
    for last, (length, kind, pattern, fits) in automaton().iter(raw.translate(_LOWER).decode()):
        start = last + 1 - length
        match = pattern.match(text, start) if start >= done[kind] else None
        if match:
            done[kind] = match.end()
            if fits(match):
                spans.append((start, kind, match.end()))
    spans += [(m.start(), KINDS.index("hex"), m.end()) for m in _HEX.finditer(text)]
    rows = [{"start": s, "kind": k, "end": e} for s, k, e in sorted(spans)]
    return {"base": [r for r in rows if r["kind"] < BASE_KINDS], "spans": rows}


def find_secrets(docs: DataFrame, text: str, keep: list[str] | None = None) -> DataFrame:
    """``row`` with the columns in ``keep`` (default all) and ``out``: ``base`` and ``spans``, arrays of (start, kind,
    end) with the kind's place in KINDS.

    A null or empty text has none. Repeated rows are searched each; rows stay structs, so no name can clash. A text's
    time is linear in its length, as no pattern looks further than its own match.
    """
    one = "array<struct<start:int,kind:int,end:int>>"
    return rows_with(docs, text, lambda texts: [find(t) for t in texts], f"base {one}, spans {one}", keep)


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined in order."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(raw: bytes | None) -> str | None:
    """A UTF-8 text with every span (overlapping ones joined) replaced by its first kind in brackets; null stays."""
    if raw is None:
        return None
    text, pieces, pos = raw.decode(), [], 0
    for span in find(raw)["spans"]:
        if span["start"] >= pos:
            pieces += [text[pos:span["start"]], f"[{KINDS[span['kind']]}]"]
        pos = max(pos, span["end"])
    return "".join([*pieces, text[pos:]])


def redacted(docs: DataFrame, text: str) -> DataFrame:
    """``row`` and ``out.text``, the text without its secrets."""
    return rows_with(docs, text, lambda texts: [{"text": redact(t)} for t in texts], "text string")
