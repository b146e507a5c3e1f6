"""Main text of web pages with a site style tree.

The pages of a host are merged by the paths of their container elements (tags with classes). For every path the tree
holds how its presentation (the sequence of child tags) and its content vary over the pages. The larger of both
entropies, divided by that of all pages different, is the path's importance: only what looks and reads the same
everywhere is low, on a host of any size. Elements whose role is stated (nav, footer, forms, adverts, comments and so
on) have no importance from the start. A page's text is what is left of its article (or main part, or body) after the
branches of low importance are removed. A branch goes from a page only if it reads there as it does on MIN_PAGES and on
a COMMON share of the path's pages: what few pages alone have in a path is theirs. Pages with the same text count once
in all of this: copies of a page, or its other addresses, don't make its own text look like boilerplate.

A page moves as its hashes to be counted once; (host, path, variant) counts combine before the shuffle, so a large host
costs each task one row a variant. What is
common in a host's low paths (at most 1 / COMMON contents each) goes back as one array, on a join that deals the pages
of each host over SALTS tasks.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .shared import materialize, slices

SALTS = 64
#: A path of at least so many pages and at most this importance is noise.
MIN_PAGES, LOW_IMPORTANCE = 8, 0.2
#: Share of a noisy path's pages that must have a content for it to be removed.
COMMON = 0.01

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template iframe svg math textarea select object audio video canvas".split())
NOISE_TAGS = frozenset("nav footer aside form button dialog menu title head".split())
CONTAINERS = frozenset("div section ul ol dl table nav footer header aside form figure article main".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 "
                     "h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul dd dt td tr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
NOISE_WORDS = frozenset("ad ads advert advertisement adverts adsense banner breadcrumb breadcrumbs comment comments "
                        "consent cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar "
                        "navigation newsletter notice pager pagination popup promo promoted related respond share "
                        "sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu "
                        "menubar".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Node:
    __slots__ = ("tag", "names", "hidden", "parts", "parent")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.parent, self.parts = tag, parent, []
        self.names: tuple[str, ...] = ()
        self.hidden = False
        if attributes and not attributes.isspace():
            for m in _ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name in ("class", "id"):
                    self.names += tuple(value.split())
                elif name == "role" and value.strip().lower() in NOISE_ROLES:
                    self.hidden = True
                elif name == "hidden" or name == "aria-hidden" and value == "true":
                    self.hidden = True
                elif name == "style" and "display:none" in value.replace(" ", "").lower():
                    self.hidden = True

    def noise_words(self) -> bool:
        return any(w.lower() in NOISE_WORDS for n in self.names for w in _WORD.findall(n))


def parse(page: str) -> Node:
    """The page as a tree; elements left open end where HTML ends them."""
    root = at = Node("#page", "", None)
    place = 0
    lower = None
    while m := _TAG.search(page, place):
        if m.start() > place:
            at.parts.append(page[place: m.start()])
        place = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            up = at
            while up.parent is not None and up.tag != tag:
                if tag in INLINE and up.tag not in INLINE:
                    up = root
                    break
                up = up.parent
            if up.parent is not None:
                at = up.parent
            continue
        if tag in RAW or tag == "title":
            lower = page.lower() if lower is None and len(page.lower()) == len(page) else lower
            end = (lower or page).find(f"</{tag}", place)
            if not (m[3] or m[6] or "").endswith("/"):
                place = len(page) if end < 0 else end
            continue
        if tag in CLOSES_P:
            up = at
            while up.tag in INLINE:
                up = up.parent
            if up.tag == "p":
                at = up.parent
        if tag in CLOSES:
            up = at
            while up.parent is not None and up.tag not in CLOSES[tag] and up.tag not in SCOPES.get(tag, ()):
                up = up.parent
            while up.tag in CLOSES[tag]:
                at = up = up.parent
        node = Node(tag, m[3] or m[6] or "", at)
        at.parts.append(node)
        if tag not in VOID:
            at = node
    if place < len(page):
        at.parts.append(page[place:])
    return root


def nodes(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        at = todo.pop()
        yield at
        todo.extend(x for x in reversed(at.parts) if isinstance(x, Node))


def path_key(node: Node, above: int) -> int:
    name = f"{node.tag}.{'.'.join(sorted(node.names))}"
    return xxhash.xxh64_intdigest(name, above & 0xFFFFFFFF) >> 1


def keyed(root: Node) -> list[tuple[Node, int]]:
    """All elements with the keys of their paths."""
    keys = {id(root): 0}
    out = []
    for node in nodes(root):
        if node.parent is not None:
            keys[id(node)] = path_key(node, keys[id(node.parent)])
            out.append((node, keys[id(node)]))
    return out


def raw_text(node: Node) -> str:
    out, todo = [], [node]
    while todo:
        at = todo.pop()
        if isinstance(at, str):
            out.append(at)
        else:
            todo.extend(reversed(at.parts))
    return " ".join(" ".join(out).split())


def contents(every: list[tuple[Node, int]]) -> dict[int, int]:
    """A hash of what each element reads like, by its id; 0 where it holds no text. Each element's hash is made of its
    own texts and its children's hashes, so the time is linear in the page, however deep it is nested."""
    out: dict[int, int] = {}
    for node, _ in reversed(every):
        made, empty = xxhash.xxh64(), True
        for part in node.parts:
            read = " ".join(part.split()) if isinstance(part, str) else out[id(part)]
            if read:
                made.update(f"{read}\0")
                empty = False
        out[id(node)] = 0 if empty else made.intdigest() >> 1
    return out


def variants(every: list[tuple[Node, int]]) -> dict[int, tuple[int, int]]:
    """For each container path of a page: hashes of its presentation and of its content (path included)."""
    out: dict[int, tuple[int, int]] = {}
    reads = contents(every)
    for node, key in every:
        if node.tag not in CONTAINERS:
            continue
        tags = [x.tag for x in node.parts if isinstance(x, Node)]
        tags = [t for i, t in enumerate(tags) if not i or tags[i - 1] != t]
        look = xxhash.xxh64_intdigest(" ".join(tags)) >> 1
        content = reads[id(node)]
        before = out.get(key, (0, key))
        out[key] = ((before[0] * 31 + look) & (2**63 - 1), (before[1] * 31 + content) & (2**63 - 1))
    return out


def main_text(page: str, low: frozenset[int] = frozenset()) -> str:
    """The text of the article without branches of low importance; ``low`` has the hashes of their contents."""
    root = parse(page)
    every = keyed(root)
    low_paths = {key for key, (_, content) in variants(every).items() if content in low} if low else ()
    whole = {"article", "main"}
    holds: set[int] = set()  # elements that have an article or main part inside
    for node, _ in every:
        if node.tag in whole and not node.noise_words() and not node.hidden:
            up = node.parent
            while up is not None and id(up) not in holds:
                holds.add(id(up))
                up = up.parent
    inside: set[int] = set()
    noise: set[int] = set()
    roots: dict[str, list[Node]] = {"article": [], "main": []}
    for node, key in every:
        up = id(node.parent)
        if up in noise:
            noise.add(id(node))
            continue
        if up in inside or node.tag == "article":
            inside.add(id(node))
        body = node.tag in ("html", "body") or id(node) in holds
        bad = node.hidden or node.tag in NOISE_TAGS or node.tag == "header" and id(node) not in inside
        bad = bad or (node.tag not in INLINE or node.tag == "span") and node.noise_words()
        bad = bad or key in low_paths and node.tag not in whole
        if bad and not body:
            noise.add(id(node))
        elif node.tag in whole and (id(node) not in inside or up not in inside):
            roots[node.tag].append(node)
    chosen = roots["article"] or [n for n in roots["main"] if not _below(n, roots["main"])] or [root]
    blocks: list[str] = []
    for one in chosen:
        run: list[str] = []

        def flush(run=run) -> None:
            line = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if line:
                blocks.append(line)

        todo: list[Node | str | None] = [one]
        while todo:
            at = todo.pop()
            if at is None:
                flush()
            elif isinstance(at, str):
                run.append(at)
            elif id(at) in noise:
                if at.tag not in INLINE:
                    flush()
            elif at.tag == "br":
                run.append(" ")
            elif at.tag in INLINE:
                todo.extend(reversed(at.parts))
            else:
                flush()
                todo.append(None)
                todo.extend(reversed(at.parts))
        flush()
    return "\n".join(blocks)


def _below(node: Node, others: list[Node]) -> bool:
    marks = {id(x) for x in others}
    up = node.parent
    while up is not None and id(up) not in marks:
        up = up.parent
    return up is not None


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return found


def style_tree(pages: DataFrame, host: str, page: str) -> tuple[DataFrame, DataFrame]:
    """(host, path, n_pages, importance) of every container path of every host, of different pages, and (host, path, kind, variant, n) of
    the presentations (kind 0) and contents (1) there, written to the shared folder."""
    src = pages.select(F.col(f"`{host}`").alias("host"), F.col(f"`{page}`").cast("binary").alias("text"))
    kinds = pa.list_(pa.struct([("path", pa.int64()), ("look", pa.int64()), ("content", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hosts, texts, pages, found = part.column("host").to_pylist(), part.column("text").to_pylist(), [], []
                for t in texts:
                    every = keyed(parse((t or b"").decode("utf-8", "replace")))
                    pages.append(xxhash.xxh64_intdigest(raw_text(every[0][0].parent)) >> 1 if every else 0)
                    found.append([{"path": k, "look": x, "content": y} for k, (x, y) in variants(every).items()])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), pa.array(found, kinds)],
                    ["host", "page", "found"])

    each = src.mapInArrow(run, "host string, page long, found array<struct<path: long, look: long, content: long>>")
    each = each.groupBy("host", "page").agg(F.min("found").alias("found"))
    each = each.select("host", F.explode("found").alias("f")).select("host", "f.path", F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("f.look").alias("variant")),
        F.struct(F.lit(1).alias("kind"), F.col("f.content").alias("variant")))).alias("v"))
    each = each.groupBy("host", "path", "v.kind", "v.variant").agg(F.count("*").alias("n"))
    each = materialize(each, "variants")
    of = [F.col("kind") == k for k in (0, 1)]
    spread = [F.sum(F.when(c, F.col("n") * F.log("n")).otherwise(0.0)) for c in of]
    m = F.sum(F.when(of[0], F.col("n")).otherwise(0))
    sums = each.groupBy("host", "path").agg(m.alias("n_pages"), spread[0].alias("s0"), spread[1].alias("s1"))
    top = F.log("n_pages")
    entropy = [F.when(F.col("n_pages") > 1, (top - F.col(s) / F.col("n_pages")) / top).otherwise(1.0)
               for s in ("s0", "s1")]
    return sums.select("host", "path", "n_pages", F.greatest(*entropy).alias("importance")), each


def main_texts(pages: DataFrame, url: str, page: str, keep: list[str]) -> DataFrame:
    """Columns ``row`` (the columns in ``keep``), ``text`` and ``n_chars`` (code points), one row per row of ``pages``.

    A null or empty page has the text ''. Pages without a host in their url (or with a null one) are one site. A page
    without markup is its own text. Repeated pages are each extracted. Names can't clash, as kept columns stay in
    ``row``.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    src = pages.select(row, host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{page}`").cast("binary").alias("text"))
    tree, each = style_tree(src, "host", "text")
    low = tree.filter((F.col("n_pages") >= MIN_PAGES) & (F.col("importance") <= LOW_IMPORTANCE))
    often = each.filter((F.col("kind") == 1) & (F.col("n") >= MIN_PAGES)).join(low, ["host", "path"]).filter(
        F.col("n") >= COMMON * F.col("n_pages"))
    low = materialize(often.groupBy("host").agg(F.collect_list("variant").alias("low")), "style-tree").select(
        F.col("host").alias("site"), "low", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("on"))
    src = src.withColumn("salt", F.pmod(F.xxhash64("text", "row"), F.lit(SALTS)).cast("int"))
    met = src.join(low, (src["host"] == low["site"]) & (src["salt"] == low["on"]), "left").select("row", "text", "low")
    schema = StructType([met.schema["row"], *_TEXT.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                lows, texts = part.column("low").to_pylist(), part.column("text").to_pylist()
                out = [main_text((t or b"").decode("utf-8", "replace"), frozenset(x or ()))
                       for t, x in zip(texts, lows, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())],
                    ["row", "text", "n_chars"])

    return met.mapInArrow(run, schema)


_TEXT = StructType().add("text", "string").add("n_chars", LongType())
