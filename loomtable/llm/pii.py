"""Personal data: candidate spans by wide generators, chosen by gradient boosted trees with calibrated thresholds.

All of it is DataFrame expressions. A pattern's matches are put between marks that no text holds and the text is split
at them, so one pass over the parts gives each match with its place (in code points) and what stands beside it.

Precise base rules (email, ip, card, phone) give spans that always stay. Wide generators propose more, overlapping
ones: obfuscated addresses, digit groups with other separators, numbers without a plus. Boosted trees over features of
format and context learn how base spans look; the features leave out what the base rules check (plus, check digit,
part sizes), so that the same look without the base form scores alike. Features have few values each: training
needs only a table of their combinations with counts, which Spark adds up over all candidates and whose size is
bounded by the bins (MAX_TABLE), whatever the input. For each kind, the threshold is the lowest one at which
PRECISION of the candidates of other documents than those trained on are base spans.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

#: Base rules. Matches are the leftmost ones; looks behind and possessive counts only avoid useless retries.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wide generators.
WIDE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\]|\{at\})\x20?"
             r"[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63}+)*+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\[?\.\]?[0-9]{1,3}+){3}+",
    "card": r"(?<![0-9])[0-9]{3,6}+(?:[\x20./_-]?[0-9]{2,6}+){2,5}+(?![0-9])",
    "phone": r"(?<![0-9])(?:00|\(|\+)?[0-9]{1,4}+\)?(?:[\x20./-]{0,2}+\(?[0-9]{2,4}+\)?){2,4}+(?![0-9])",
}
#: What a text must hold for a generator to find anything.
NEEDS = {"email": "@|(?i)[(\\[{]at[)\\]}]", "ip": "[0-9]\\]?[.]|[.]\\[?[0-9]", "card": "[0-9]{2}", "phone": "[0-9]{2}"}

CONTEXT = {
    "email": r"(?i)(mail|contact|write|from|to)\W*$", "ip": r"(?i)(ip|host|addr\w*|server|client)\W*$",
    "card": r"(?i)(card|visa|pay\w*|credit|account)\W*$", "phone": r"(?i)(tel\w*|phone|call|mobile|fax)\W*$",
}

PRECISION = 0.9
ROUNDS, RATE, MIN_WEIGHT = 25, 0.3, 5.0

#: Features and their numbers of values.
BINS = {"kind": 4, "digits": 7, "groups": 5, "marks": 4, "even": 2, "head": 3, "context": 2, "joined": 3}
MAX_TABLE = math.prod(BINS.values())

_MARK, _OTHER = "\ue000", "\ue001"
_SPAN = "struct<start:int,end:int,text:string,left:string,next:string>"


#: Parts of a text whose lengths are added up together.
CHUNK = 256


def _parts(text: Column, pattern: str) -> Column:
    """The text cut before and behind each leftmost non-overlapping match: matches have the odd places."""
    clean = F.translate(text, _MARK, _OTHER)
    return F.split(F.regexp_replace(clean, f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK, -1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _chunk_sums(lengths: str) -> Column:
    chunks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int"))
    return F.transform(chunks, lambda k: _sum(F.slice(lengths, k * CHUNK + 1, F.lit(CHUNK))))


def _matches(parts: str, lengths: str, sums: str) -> Column:
    """Matches as an array of (start, end, text, left, next), from columns of parts, their lengths and the sums of
    each CHUNK of lengths. Places count code points.

    What stands before a match is the sum of the chunks before its own and of the parts before it there: an array that
    grew match by match would be copied for each.
    """
    def span(i: Column) -> Column:
        start = _sum(F.slice(sums, F.lit(1), F.floor(i / CHUNK).cast("int"))) + _sum(
            F.slice(lengths, i - i % CHUNK + 1, i % CHUNK))
        return F.struct(
            start.alias("start"), (start + F.get(lengths, i)).alias("end"), F.get(parts, i).alias("text"),
            F.substring(F.get(parts, i - 1), -24, 24).alias("left"),
            F.substring(F.get(parts, i + 1), 1, 1).alias("next"))

    some = F.size(parts) > 2
    return F.when(some, F.transform(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)), span)).otherwise(_none())


def with_matches(rows: DataFrame, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """``row`` and, for each name, the matches in ``text`` of (pattern, what a text must hold for it to match)."""
    names = list(patterns)
    cut = rows.select("row", *[F.when(F.col("text").rlike(needs), _parts(F.col("text"), pattern)).alias(n)
                               for n, (pattern, needs) in patterns.items()])
    cut = cut.select("*", *[F.transform(n, F.length).alias(f"{n}_lengths") for n in names])
    cut = cut.select("*", *[_chunk_sums(f"{n}_lengths").alias(f"{n}_sums") for n in names])
    return cut.select("row", *[_matches(n, f"{n}_lengths", f"{n}_sums").alias(n) for n in names])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _valid(kind: str, span: Column) -> Column:
    digits = _digits(span["text"])
    if kind == "ip":
        return F.forall(F.split(span["text"], "[.]"), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _rule(kind: str) -> Callable[[Column], Column]:
    return lambda span: _valid(kind, span)


def _none() -> Column:
    return F.expr(f"cast(array() as array<{_SPAN}>)")


BASE_NEEDS = {"email": "@", "ip": "[0-9][.][0-9]", "card": "[0-9]", "phone": "[+][0-9]"}


def with_candidates(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``row``, the valid base spans and the wide generators' spans of each kind (columns base_* and wide_*)."""
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    out = with_matches(docs.select(row, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")), {
        **{f"all_{k}": (BASE[k], BASE_NEEDS[k]) for k in KINDS}, **{f"wide_{k}": (WIDE[k], NEEDS[k]) for k in KINDS}})
    return out.select("row", *[F.filter(f"all_{k}", _rule(k)).alias(f"base_{k}") for k in KINDS],
                      *[f"wide_{k}" for k in KINDS])


def _features(kind: str, x: Column) -> list[Column]:
    t = x["text"]
    n = F.length(_digits(t))
    groups = F.size(F.split(F.trim(F.regexp_replace(t, "[^0-9A-Za-z]+", " ")), " "))
    marks = F.length(F.regexp_replace(t, "[0-9A-Za-z+@]", ""))
    head = F.substring(_digits(t), 1, 1)
    return [
        F.lit(KINDS.index(kind)).alias("kind"),
        F.when(n < 4, 0).when(n < 8, 1).when(n < 10, 2).when(n < 12, 3).when(n < 14, 4).when(n < 17, 5).otherwise(6)
         .alias("digits"),
        F.least(groups - 1, F.lit(4)).alias("groups"),
        F.when(t.rlike("[\\[{/_]"), 3).otherwise(F.least(marks, F.lit(2))).alias("marks"),
        t.rlike("^[^0-9]*([0-9]+)([^0-9]+[0-9]{1,4})*$").cast("int").alias("even"),
        F.when(head.isin("3", "4", "5", "6"), 1).when(head.isin("1", "2"), 2).otherwise(0).alias("head"),
        x["left"].rlike(CONTEXT[kind]).cast("int").alias("context"),
        F.when(x["left"].rlike("[0-9A-Za-z.,=:/\"-]$"), 1).when(x["next"].rlike("[0-9A-Za-z/=-]"), 2).otherwise(0)
         .alias("joined"),
    ]


def candidates(kind: str) -> Column:
    """All spans of a kind with their features and whether they are base spans."""
    base = F.transform(f"base_{kind}", lambda b: F.struct(b["start"], b["end"]))
    every = F.array_union(f"base_{kind}", f"wide_{kind}")
    return F.transform(every, lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), *_features(kind, x),
        F.array_contains(base, F.struct(x["start"], x["end"])).alias("is_base")))


# Boosted trees over a table of feature combinations.

Tree = tuple  # (feature, value, left, right) or (score,)


def _leaf(rows: list[dict]) -> Tree:
    g, h = sum(r["g"] for r in rows), sum(r["h"] for r in rows)
    return (RATE * g / (h + 1.0),)


def _grow(rows: list[dict], depth: int) -> Tree:
    g, h = sum(r["g"] for r in rows), sum(r["h"] for r in rows)
    best, gain = None, 1e-6
    for f in BINS if depth else ():
        bins: dict[int, list[float]] = {}
        for r in rows:
            b = bins.setdefault(r[f], [0.0, 0.0, 0.0])
            b[0], b[1], b[2] = b[0] + r["g"], b[1] + r["h"], b[2] + r["n"]
        lg = lh = ln = 0.0
        total = sum(b[2] for b in bins.values())
        for v in sorted(bins)[:-1]:
            lg, lh, ln = lg + bins[v][0], lh + bins[v][1], ln + bins[v][2]
            if min(ln, total - ln) < MIN_WEIGHT:
                continue
            score = lg * lg / (lh + 1) + (g - lg) ** 2 / (h - lh + 1) - g * g / (h + 1)
            if score > gain:
                best, gain = (f, v), score
    if best is None:
        return _leaf(rows)
    f, v = best
    return (f, v, _grow([r for r in rows if r[f] <= v], depth - 1), _grow([r for r in rows if r[f] > v], depth - 1))


def _value(tree: Tree, row: dict) -> float:
    while len(tree) == 4:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def boost(table: list[dict], depth: int = 3) -> list[Tree]:
    """Trees fitted to rows of features with n (candidates) and pos (base spans among them), by logistic loss."""
    trees: list[Tree] = []
    for r in table:
        r["s"] = 0.0
    for _ in range(ROUNDS if table else 0):
        for r in table:
            p = 1 / (1 + math.exp(-r["s"]))
            r["g"], r["h"] = r["pos"] - r["n"] * p, r["n"] * p * (1 - p)
        tree = _grow(table, depth)
        trees.append(tree)
        for r in table:
            r["s"] += _value(tree, r)
    return trees


def thresholds(trees: list[Tree], table: list[dict]) -> dict[int, float]:
    """For each kind the lowest score at which PRECISION of the rows' candidates are base spans (infinite: none)."""
    out = {}
    for kind in range(len(KINDS)):
        rows = sorted(((sum(_value(t, r) for t in trees), r["n"], r["pos"]) for r in table if r["kind"] == kind),
                      reverse=True)
        n = pos = 0
        out[kind] = math.inf
        for i, (s, a, b) in enumerate(rows):
            n, pos = n + a, pos + b
            if pos >= PRECISION * n and (i + 1 == len(rows) or rows[i + 1][0] < s):
                out[kind] = s
    return out


def learn(found: DataFrame) -> tuple[list[Tree], dict[int, float]]:
    """Trees from the documents of even row hash, thresholds from the others; only the count table is collected."""
    fold = F.pmod(F.xxhash64("row"), F.lit(2)).alias("fold")
    names = list(BINS)
    every = F.concat(*[candidates(k) for k in KINDS])
    counts = found.select(fold, F.explode(every).alias("c")).groupBy("fold", *[f"c.{n}" for n in names]).agg(
        F.count("*").alias("n"), F.sum(F.col("c.is_base").cast("long")).alias("pos"))
    rows = [r.asDict() for r in counts.collect()]
    trees = boost([r for r in rows if r["fold"] == 0])
    return trees, thresholds(trees, [r for r in rows if r["fold"] == 1])


def _score(trees: list[Tree], x: Column) -> Column:
    def one(tree: Tree) -> Column:
        if len(tree) == 1:
            return F.lit(float(tree[0]))
        return F.when(x[tree[0]] <= tree[1], one(tree[2])).otherwise(one(tree[3]))

    total = F.lit(0.0)
    for t in trees:
        total = total + one(t)
    return total


def _placed(kind: int) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"))


def _above(trees: list[Tree], limit: float) -> Callable[[Column], Column]:
    return lambda x: _score(trees, x) >= F.lit(limit)


def personal_data(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``row`` with the columns in ``keep``, ``base`` and ``spans``: arrays of (start, kind, end), sorted; kind is a
    place in KINDS. ``spans`` has the base spans and the candidates that the trees choose.

    A null or empty text has no spans. Texts with nothing to learn from give base spans only. Repeated rows are
    treated each; names can't clash, as rows stay structs.
    """
    found = with_candidates(docs, text, keep)
    trees, limit = learn(found)
    arrays = [F.transform(f"base_{k}", _placed(i)) for i, k in enumerate(KINDS)]
    base = F.array_sort(F.concat(*arrays)).alias("base")
    chosen = []
    for i, k in enumerate(KINDS):
        if not trees or limit[i] == math.inf:
            continue
        good = F.filter(candidates(k), _above(trees, limit[i]))
        chosen.append(F.transform(good, _placed(i)))
    spans = F.array_sort(F.array_distinct(F.concat(*arrays, *chosen))).alias("spans")
    return found.select("row", base, spans)


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined in order."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span (overlapping ones joined) replaced by its kind in brackets."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])

    def step(acc: Column, x: Column) -> Column:
        new = x["start"] >= acc["pos"]
        gap = F.substring(text, acc["pos"] + 1, x["start"] - acc["pos"])
        return F.struct(
            F.greatest(acc["pos"], x["end"]).alias("pos"),
            F.when(new, F.concat(acc["out"], gap, F.element_at(names, x["kind"] + 1))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    done = F.aggregate(spans, start, step)
    return F.concat(done["out"], F.substring(text, done["pos"] + 1, F.length(text)))
