"""The operators against brute force on small rows: nulls, empty and long texts, ties, repeated rows, clashing names."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtable.llm import (decontamination, language_model, lines, packing, pages, pii, repetition, sharding, simhash,
                           toxicity)
from loomtable.llm.queries import tokenizer_path
from loomtable.llm.shared import shared_folder

DOC = "doc_id long, text string, source string, out string, row string, n_words long"


def frame(spark, texts):
    rows = [(None if i == 3 else i, t, None if i == 4 else f"s{i % 3}", "x", "y", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def some_texts(seed=1, n=40):
    rng = random.Random(seed)
    words = ["la", "mer", "Été", "sun", "x1", "sea,", "of", "the", "sky", "-"]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 2, 9, 30, 80]))) for _ in range(n)]
    return [None, "", " \n\t ", *texts, texts[0], texts[0], "long " * 30_000]


def test_overlaps_equal_brute_force(spark, monkeypatch):
    texts = some_texts()
    items = [(1, texts[5]), (2, "the sky"), (None, "sun of la"), (4, ""), (5, None), (6, texts[8]), (6, texts[8])]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def words(t):
        low = (t or "").translate({c: c + 32 for c in range(65, 91)})
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    def expected(t):
        w, hit, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            n = min(10, len(v))
            for i in range(len(v) - n + 1 if v else 0):
                for j in range(len(w) - n + 1):
                    if w[j: j + n] == v[i: i + n]:
                        hit.update(range(j, j + n))
                        found |= {str(item)} if item is not None else set()
        return len(w), len(hit), sorted(found)

    docs = frame(spark, texts)
    for bound in (8_000_000, 40):
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", bound)
        got = decontamination.overlaps(docs, bench, "text", "item_id", "text", 10, ["doc_id"]).select("out.*").collect()
        seen = Counter((r["n_words"], sum(h["end"] - h["start"] for h in r["hits"]), tuple(r["items"])) for r in got)
        assert seen == Counter((a, b, tuple(c)) for a, b, c in map(expected, texts))
    clean = decontamination.clean_documents(docs, bench, "text", "item_id", "text")
    assert clean.columns == docs.columns
    assert clean.count() == sum(expected(t)[1] == 0 for t in texts)
    assert decontamination.clean_documents(docs, bench.limit(0), "text", "item_id", "text").count() == len(texts)
    assert decontamination.clean_documents(docs.limit(0), bench, "text", "item_id", "text").count() == 0


def test_longest_match_and_places():
    suffixes = decontamination.TestSuffixes([("7", " ".join(map(str, range(30))))], 10)
    text = "a b " + " ".join(map(str, range(5, 22))) + " c"
    (found,) = suffixes.search([text.encode()])
    assert found["longest"] == 17 and found["hits"] == [{"start": 2, "end": 19}] and found["items"] == ["7"]


def test_packing_is_gapless_whole_and_near_the_bound(spark):
    texts = [*some_texts(), "word " * 9000]
    docs = frame(spark, texts)
    rows = packing.pack(docs, "text", ["doc_id"], tokenizer_path(), tokens=True).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    want = Counter(tuple(tok.encode(t or "", add_special_tokens=False).ids + [1]) for t in texts)
    whole = Counter()
    for r in rows:
        if r["start"] == 0:
            more = [x for x in rows if x["piece"] > 0 and x["row"] == r["row"]] if r["length"] == 4096 else []
            whole[tuple(sum([x["ids"] for x in [r, *sorted(more, key=lambda x: x["piece"])]], []))] += 1
    assert whole == want
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
        assert at[r["sequence_id"]] <= 4096
    assert len(at) == math.ceil(sum(r["length"] for r in rows) / 4096)
    assert packing.pack(docs.limit(0), "text", ["doc_id"], tokenizer_path()).count() == 0


def sequences_of(histogram, capacity=4096):
    """The number of sequences of a plan that was seen to hold every piece once."""
    plan, held = packing.bin_completion(dict(histogram), capacity), Counter()
    for times, need in plan.patterns:
        assert sum(length * copies for length, copies in need) <= capacity
        for length, copies in need:
            held[length] += times * copies
    assert held == Counter(histogram)
    return plan.sequences


@pytest.mark.parametrize("pieces, most", [(3, 404), (4, 404)])
def test_plan_of_sequences_that_were_cut_up(pieces, most):
    rng = random.Random(pieces)
    cuts = [[0, *sorted(rng.sample(range(1, 4096), pieces - 1)), 4096] for _ in range(400)]
    assert 400 <= sequences_of(Counter(b - a for c in cuts for a, b in zip(c, c[1:], strict=False))) <= most


def test_plan_of_a_skewed_histogram_is_bounded_in_time():
    """A third of all pieces have one awkward length."""
    rng, histogram = random.Random(9), Counter({1500: 300_000})
    histogram.update(rng.randint(200, 2600) for _ in range(600_000))
    bound = math.ceil(sum(v * n for v, n in histogram.items()) / 4096)
    start = time.process_time()
    assert sequences_of(histogram) <= 1.02 * bound
    assert time.process_time() - start < 60


def test_dominated_fillings():
    search = packing.Search(Counter({5: 1, 4: 2, 3: 1, 9: 1}), 1000)
    assert search.dominated((4, 3), 1)  # 5 for 4
    assert search.dominated((4, 4), 1)  # 9 for both
    assert not search.dominated((5, 3), 0) and not search.dominated((9,), 3)


@pytest.mark.parametrize("texts", [
    ["ab.\ncd", "ab, cd.. ef). g.h ", "á, b., ß. É, xⅠ. ǆ, ª. _. 1. a1, ", "İ, I. İ. ſ. K, Σ. ΑΣ ", ""],
    ["\x01", "a\x01b | ~ c", "é e\u0301 ́x", "x\u00a0y\u2003z\u3000", "'S it's don't", "\r\n\t \x0b\x0c a", "日本語 テスト 12 ٣"],
])
def test_remembered_parts_give_the_tokenizers_ids(texts, monkeypatch):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    for limit in (450_000, 2):
        monkeypatch.setattr(packing, "MAX_CHUNKS", limit)
        encoder = packing.Encoder(tokenizer_path())
        for _ in range(2):
            got = encoder.ids([t.encode() for t in texts], 1)
            assert [g.tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids + [1] for t in texts]


@pytest.mark.parametrize("seed", range(6))
def test_bin_completion_matches_exhaustive_search(seed):
    rng = random.Random(seed)
    items = [rng.randint(1, 12) for _ in range(9)]

    def best(left, bins):
        if not left:
            return len(bins)
        out = 99
        for i in range(len(bins) + 1):
            if i == len(bins) or bins[i] + left[0] <= 12:
                new = [*bins[:i], (bins[i] if i < len(bins) else 0) + left[0], *bins[i + 1:]]
                out = min(out, best(left[1:], new))
        return out

    plan = packing.bin_completion(Counter(items), 12)
    assert Counter({v: sum(n * dict(p).get(v, 0) for n, p in plan.patterns) for v in set(items)}) == Counter(items)
    assert plan.sequences == best(sorted(items, reverse=True), [])


def test_encoder_equals_tokenizer():
    texts = ["Don't  STOP!!  a.b c d", "Été ΣΣ <|endoftext|> x\x1cy\x85z", "", " \n"]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    got = packing.Encoder(tokenizer_path()).ids(texts, 1)
    assert [x.tolist() for x in got] == [tok.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_sharding_table_and_placement(spark):
    names = [f"n{i}" for i in range(7)]
    table = sharding.lookup_table(names, 1009)
    share = Counter(table)
    assert set(table) == set(range(7)) and max(share.values()) - min(share.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6) < 1009 * 0.25
    docs = frame(spark, some_texts())
    placed = sharding.place(docs, ["doc_id"], names, 1009)
    assert placed.select("row.*").columns == docs.columns and placed.count() == docs.count()
    for r in placed.select("slot", "shard").collect():
        assert table[r["slot"]] == r["shard"]
    assert sharding.place(docs.limit(0), ["doc_id"], names, 1009).count() == 0
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)


def brute_components(prints, radius):
    up = {f: f for f in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {f: root(f) for f in prints}


@pytest.mark.parametrize(("radius", "bands", "tree"), [(2, 4, 2048), (2, 3, 3), (6, 8, 5)])
def test_links_reach_what_brute_force_reaches(spark, monkeypatch, radius, bands, tree):
    monkeypatch.setattr(simhash, "TREE_SIZE", tree)
    rng = random.Random(radius)
    prints = {0, (1 << 64) - 1}
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 4, 12])):
            prints.add(f)
            for _ in range(rng.randint(1, radius + 2)):
                f ^= 1 << rng.randrange(64)
    df = spark.createDataFrame([(simhash._signed(f),) for f in prints], "fp long")
    got = {r["node"]: r["component"] for r in simhash.components(simhash.links(df, radius, bands)).collect()}
    want = brute_components(prints, radius)
    groups = {}
    for f in prints:
        groups.setdefault(want[f], set()).add(got.get(simhash._signed(f), simhash._signed(f)))
    assert all(len(v) == 1 for v in groups.values())
    assert len({next(iter(v)) for v in groups.values()}) == len(groups)


def test_near_duplicates_name_least_id_and_keep_one(spark):
    texts = some_texts()
    docs = frame(spark, texts)
    found = simhash.near_duplicates(docs, "text", "doc_id").select("row.doc_id", "row.text", "fp", "component", "first")
    rows = found.collect()
    want = brute_components({simhash.fingerprint((t or "").encode()) for t in texts}, 2)
    least = {}
    for r in rows:
        assert r["fp"] == simhash._signed(simhash.fingerprint((r["text"] or "").encode()))
        g = want[r["fp"] & (2**64 - 1)]
        least.setdefault(g, []).append(r)
    for group in least.values():
        ids = [r["doc_id"] for r in group if r["doc_id"] is not None]
        assert {r["component"] for r in group} == {min(ids, default=None)}
        assert sum(r["first"] for r in group) == 1
    kept = simhash.one_of_each(docs.union(docs), "text", "doc_id")
    assert kept.columns == docs.columns and kept.count() == len(least)
    assert simhash.one_of_each(docs.limit(0), "text", "doc_id").count() == 0
    assert simhash.one_of_each(docs.limit(0), "text", "doc_id", 3, 6, 8, 10, 0.75).count() == 0


def shingle_set(text, size=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i: i + size]) for i in range(max(len(w) - size + 1, 1))}


def test_signatures_estimate_similarity():
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(25_000)]
    for share in (0.0, 0.5, 0.8, 0.95):
        cut = int(len(base) * share)
        other = base[:cut] + [f"v{rng.randrange(10**6)}" for _ in range(len(base) - cut)]
        a, b = " ".join(base), " ".join(other)
        x, y = shingle_set(a), shingle_set(b)
        got = simhash.similarity(*simhash.signatures([a.encode(), b.encode()], 5))
        assert abs(got - len(x & y) / len(x | y)) < 0.2
    short = simhash.signatures([None, b"", b"a b", b"A  B", b"a c", b"a b c d e"], 5)
    assert short[0] == short[1] != short[2] == short[3] != short[4] != short[5]


def test_near_duplicates_need_the_similarity_too(spark):
    rng = random.Random(8)
    fresh = iter(range(10**9))
    def words(n):
        return [f"w{next(fresh)}" for _ in range(n)]
    texts, group = [], []
    for g in range(12):
        base = words(300)
        texts.append(base), group.append(g)
        for _ in range(4):
            near = list(base)
            for at in rng.sample(range(300), 3):
                near[at] = f"x{next(fresh)}"
            texts.append(near), group.append(g)
    shared = words(200)
    for g in range(12, 20):  # most of each text is shared, yet the similarity is below 0.8
        texts.append(words(40) + shared + words(40)), group.append(g)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = simhash.near_duplicates(docs, "text", "doc_id", 3, 6, 8, reach=10, alike=0.75)
    got = {r["doc_id"]: r["component"] for r in found.select("row.doc_id", "component").collect()}
    first = {}
    for i, g in enumerate(group):
        first.setdefault(g, i)
    assert got == {i: first[g] for i, g in enumerate(group)}
    loose = simhash.near_duplicates(docs, "text", "doc_id", 3, 16, 18).select("component").distinct().count()
    assert loose < 20


def test_near_duplicates_are_decided_by_exact_similarity(spark):
    rng = random.Random(11)
    texts = []
    for share in range(60):  # pairs of one replaced passage, 0.70 to 0.90 alike
        base = [f"w{share}_{i}" for i in range(400)]
        n = 20 + share
        at = rng.randrange(400 - n)
        texts += [base, [*base[:at], *[f"x{share}_{i}" for i in range(n)], *base[at + n:]]]
    texts = [" ".join(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = simhash.near_duplicates(docs, "text", "doc_id", 3, 16, 18, reach=16, alike=0.8, keep=["doc_id"])
    got = {r["doc_id"]: r["component"] for r in found.select("row.doc_id", "component").collect()}
    want = {}
    for i in range(0, len(texts), 2):
        x, y = shingle_set(texts[i]), shingle_set(texts[i + 1])
        near = (simhash.fingerprint(texts[i].encode()) ^ simhash.fingerprint(texts[i + 1].encode())).bit_count() <= 16
        want |= {i: i, i + 1: i if near and len(x & y) / len(x | y) >= 0.8 else i + 1}
    assert got == want and 10 < sum(i != c for i, c in want.items()) < 50


def test_recall_by_similarity(spark):
    """Isolated pairs of 0.8 and more, one replaced passage or scattered words, by bands of four hundredths."""
    rng = random.Random(21)
    vocabulary = [f"v{i}" for i in range(3000)]
    made, pairs = Counter(), []
    while len(made) < 10 or min(made.values()) < 20:
        n, kind, share = rng.randint(150, 600), rng.choice("ps"), rng.uniform(0.8, 1.0)
        a = rng.choices(vocabulary, k=n)
        b, away = list(a), n * (1 - 2 * share / (1 + share))
        if kind == "p":
            m = max(1, int(away) - rng.randint(0, 4))
            at = rng.randrange(n - m)
            b[at: at + m] = rng.choices(vocabulary, k=m)
        else:
            for at in rng.sample(range(n), max(1, round(away / 4.2))):
                b[at] = rng.choice(vocabulary)
        a, b = " ".join(a), " ".join(b)
        alike = simhash.jaccard(a.encode(), b.encode(), 5)
        band = (kind, min(4, int((alike - 0.8) / 0.04)))
        if 0.8 <= alike < 1 and made[band] < 20:
            made[band] += 1
            pairs.append((band, a, b))
    docs = spark.createDataFrame([(2 * i + k, p[1 + k]) for i, p in enumerate(pairs) for k in (0, 1)],
                                 "doc_id long, text string")
    found = simhash.near_duplicates(docs, "text", "doc_id", 3, reach=corpus_pipeline.REACH, alike=0.8, keep=["doc_id"])
    got = {r["doc_id"]: r["component"] for r in found.select("row.doc_id", "component").collect()}
    assert all(c in (d, d - d % 2) for d, c in got.items())
    hit = defaultdict(int)
    for i, (band, _, _) in enumerate(pairs):
        hit[band] += got[2 * i + 1] == 2 * i
    assert all(hit[band] >= 0.9 * n for band, n in made.items()), hit


@pytest.mark.parametrize("size", [0, 10**9])
def test_groups_of_copies_and_of_half_alike_texts(spark, monkeypatch, size):
    """A large group of near copies, and texts that share a passage: not all pairs are counted, no link is lost."""
    monkeypatch.setattr(simhash, "SMALL_UNIT", size)
    rng, vocabulary = random.Random(4), [f"v{i}" for i in range(5000)]
    base, shared = rng.choices(vocabulary, k=300), rng.choices(vocabulary, k=180)
    texts = []
    for _ in range(150):
        near = list(base)
        for at in rng.sample(range(300), rng.randint(1, 7)):
            near[at] = rng.choice(vocabulary)
        texts.append(near)
    texts += [shared + rng.choices(vocabulary, k=rng.choice([20, 38, 45, 60])) for _ in range(40)]
    raw = [" ".join(t) for t in texts]
    sets = [shingle_set(t) for t in raw]
    group = list(range(len(raw)))
    for i in range(len(raw)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    counted = []
    materialize = simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, label: counted.append((label, materialize(df, label))) or counted[-1][1])
    docs = spark.createDataFrame(list(enumerate(raw)), "doc_id long, text string")
    found = simhash.near_duplicates(docs, "text", "doc_id", 3, reach=24, alike=0.8, keep=["doc_id"])
    got = {r["doc_id"]: r["component"] for r in found.select("row.doc_id", "component").collect()}
    assert got == dict(enumerate(group))
    pairs = [df.select("a", "b").distinct().count() for label, df in counted if label == "counted"]
    assert sum(pairs) < 6000  # of 17,955


def test_rows_of_near_dedup_grow_with_a_cloud_and_not_with_its_pairs(spark, monkeypatch):
    """Texts that share a passage, nearly all pairs close below the limit: what is written stays linear."""
    rng, vocabulary = random.Random(8), [f"v{i}" for i in range(5000)]
    shared = rng.choices(vocabulary, k=200)
    raw = [" ".join(shared + rng.choices(vocabulary, k=rng.choice([22, 27, 30, 33]))) for _ in range(160)]
    sets = [shingle_set(t) for t in raw]
    group, refused = list(range(len(raw))), 0
    for i in range(len(raw)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
            else:
                refused += 1
    written = defaultdict(int)
    materialize = simhash.materialize

    def counting(df, label):
        out = materialize(df, label)
        if "a" in out.columns:
            written[label] += out.select("a", "b").distinct().count()
        return out

    monkeypatch.setattr(simhash, "materialize", counting)
    docs = spark.createDataFrame(list(enumerate(raw)), "doc_id long, text string")
    found = simhash.near_duplicates(docs, "text", "doc_id", 3, reach=40, alike=0.8, keep=["doc_id"])
    got = {r["doc_id"]: r["component"] for r in found.select("row.doc_id", "component").collect()}
    assert got == dict(enumerate(group)) and 20 < len(set(group)) and refused > 8000
    # At most one pair a member in a unit of each of 16 bands, in two rounds.
    assert written["counted"] < 2500 and written["linked"] < 160


def test_links_of_a_unit_are_those_by_brute_force():
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = [b"", None, b"a b", b"A  b", b"a b c d e", b"a b c d e"]
    for _ in range(60):
        words = list(base)
        for at in rng.sample(range(120), rng.randint(0, 8)):
            words[at] = f"x{rng.randrange(40)}"
        texts.append(" ".join(words).encode())
    n, want = len(texts), list(range(len(texts)))
    for i in range(n):
        for j in range(i):
            if simhash.jaccard(texts[i], texts[j], 5) >= 0.8:
                a, b = want[i], want[j]
                want = [min(a, b) if g in (a, b) else g for g in want]
    prints = simhash.fingerprints(texts, 3)
    sig = np.frombuffer(b"".join(simhash.signatures(texts, 5)), np.uint8).reshape(n, -1)
    halves = [list(range(0, n, 2)), list(range(1, n, 2))]
    for blocks in ([(list(range(n)),) * 2], [(halves[0],) * 2, (halves[1],) * 2, tuple(halves)]):
        got = list(range(n))
        for tree, query in blocks:
            for band in range(simhash.BANDS):
                unit = simhash.Unit(list(range(n)), prints, sig, list(got), [set()] * n, tree, query, 64, 0.0)
                for i, j in unit.links(texts, band, 5, 0.8):
                    assert got[i] != got[j]
                    a, b = got[i], got[j]
                    got = [min(a, b) if g in (a, b) else g for g in got]
        assert got == want and 5 < len(set(want)) < n


def test_many_spans_in_one_text(spark):
    text = "é ".join(f"u{i}@x{i}.de, +49 30 {10_000_000 + i}" for i in range(12_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.with_candidates(docs, "text", ["doc_id"]).select("base_email", F.size("base_phone").alias("n")).first()
    places = [(m.start(), m.end()) for m in re.finditer(r"[a-z0-9]+@[a-z0-9]+\.de", text)]
    assert [(x["start"], x["end"]) for x in row["base_email"]] == places and row["n"] == 12_000


def test_contents_take_linear_time_in_nesting():
    page = "<body>" + "<div>a " * 20_000 + "</div>" * 20_000 + "</body>"
    start = time.process_time()
    assert len(pages.variants(pages.keyed(pages.parse(page)))) >= 1
    assert time.process_time() - start < 20
    one, other = (pages.contents(pages.keyed(pages.parse(f"<div><p>a b</p><p>{x}</p></div>"))) for x in ("c", "d"))
    assert list(one.values())[1] == list(other.values())[1] and len(set(one.values()) ^ set(other.values())) == 4


def test_base_spans_and_redaction(spark):
    texts = ["mail a.b@c.de, 4539 1488 0343 6467 and +1 (743) 555-3824", "1.2.3.4 999.1.1.1 1.2.3.4.5", "é x@y.z é",
             None, "", "a@b.c-x%y@d.e +12 4539148803436468", "9" * 20_000, "4539148803436467 4539148803436467"]
    rows = frame(spark, texts)
    out = pii.personal_data(rows, "text", ["doc_id", "text"]).select(
        "row.text", pii.written(F.col("base")).alias("b"), pii.written(F.col("spans")).alias("s"),
        pii.redact(F.coalesce(F.col("row.text"), F.lit("")), F.col("base")).alias("r")).collect()
    got = {r["text"]: r["b"] for r in out}
    assert got[texts[0]] == "email:5:13,card:15:34,phone:39:56"
    assert got[texts[1]] == "ip:0:7,ip:18:25"
    assert got[texts[2]] == "email:2:7" and got[None] == got[""] == ""
    assert got[texts[5]] == "email:0:7,email:7:13"
    assert got[texts[6]] == ""
    assert {r["text"]: r["r"] for r in out}[texts[0]] == "mail [email], [card] and [phone]"
    assert all(set(filter(None, r["b"].split(","))) <= set(r["s"].split(",")) for r in out)
    assert pii.personal_data(rows.limit(0), "text", ["doc_id"]).count() == 0


def test_boosting_finds_the_rule_and_thresholds_hold():
    table = [dict(dict.fromkeys(pii.BINS, 0), kind=2, digits=d, head=h, n=50, pos=48 if d == 5 and h == 1 else 1)
             for d in range(7) for h in range(3)]
    trees = pii.boost([dict(r) for r in table])
    limit = pii.thresholds(trees, table)
    chosen = [(r["digits"], r["head"]) for r in table if sum(pii._value(t, r) for t in trees) >= limit[2]]
    assert chosen == [(5, 1)] and limit[0] == math.inf


def test_language_model_equals_counted_bigrams(spark):
    texts = some_texts()
    docs = frame(spark, texts)
    held = F.col("doc_id") % 4 == 0
    rows = language_model.score_texts(docs, "text", held, ["doc_id", "text"]).select(
        "row.doc_id", "row.text", "held_out", "out.*").collect()
    assert len(rows) == len(texts)
    one, two = Counter(), Counter()
    for i, t in enumerate(texts):
        w = [*(t or "").encode().lower().split(), "end"]
        if i == 3 or i % 4:
            one.update(w)
            two.update(zip(["start", *w], w, strict=False))
    n, v, mass = sum(one.values()), len(one), language_model.MASS
    for r in rows:
        w = [*(r["text"] or "").encode().lower().split(), "end"]
        p = [(one[x] + 0.1) / (n + 0.1 * (v + 1)) for x in w]
        state = [one["end"], *(one[x] for x in w)]
        q = [(two[a, b] + mass * y) / (s + mass) for a, b, y, s in zip(["start", *w], w, p, state, strict=False)]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(one[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(map(math.log10, p)))
        assert r["score"] == pytest.approx(sum(map(math.log10, q)))
    assert language_model.score_texts(docs.limit(0), "text", held, ["doc_id"]).count() == 0


def test_repetition_counts(spark):
    texts = [*some_texts(), "a b c a b c\nx\nx\n\nx #|#"]
    rows = repetition.repetition_rules(frame(spark, texts), "text", ["doc_id", "text"]).select("row.text", "out.*")
    for r in rows.collect():
        t = r["text"] or ""
        w = t.encode().split()
        windows = Counter(tuple(w[i: i + 3]) for i in range(len(w) - 2))
        marked = {i + k for i in range(len(w) - 2) if windows[tuple(w[i: i + 3])] > 1 for k in range(3)}
        full = [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
        assert r["n_words"] == len(w) and r["n_repeat_words"] == len(marked)
        assert r["n_dup_lines"] == len(full) - len(set(full))
        assert r["word_chars"] == sum(len(x.decode()) for x in w)
        assert r["n_symbols"] == sum(t.count(c) for c in "#*$%&|<>")
        assert r["base_failed"] == (len(w) < 50 or 100 * len(marked) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])
        for n, share in r["coverage"].items():
            seen = Counter(tuple(w[i: i + n]) for i in range(len(w) - n + 1))
            inside = {i + k for i in range(len(w) - n + 1) if seen[tuple(w[i: i + n])] > 1 for k in range(n)}
            assert share == pytest.approx(sum(len(w[i].decode()) for i in inside) / r["word_chars"])


def test_boilerplate_lines_by_host(spark):
    rows = [(i, "h", f"menu\nown {i}\n\nodd{i % 9}") for i in range(20)] + [(99, "h", "menu\nown 1\n\nodd1")] * 30
    rows += [(50, None, "menu\nb"), (51, "few", "menu\na"), (52, "h", None), (53, "h", "")]
    pages_ = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("kept_text", F.lit("z"))
    out = lines.drop_boilerplate(pages_, "source", "text", 0.3, 5).select(
        "row.doc_id", F.col("kept_text").alias("t"), "n_lines", "n_dropped").collect()
    got = {r["doc_id"]: (r["t"], r["n_lines"], r["n_dropped"]) for r in out}
    assert len(out) == len(rows)
    assert got[7] == ("own 7\n\nodd7", 4, 1) and got[99] == ("own 1\n\nodd1", 4, 1)
    assert got[50] == ("menu\nb", 2, 0) and got[51] == ("menu\na", 2, 0)
    assert got[52] == (None, 0, 0) and got[53] == ("", 1, 0)
    assert lines.drop_boilerplate(pages_.limit(0), "source", "text").count() == 0


def test_unique_lines_of_small_hosts_stay(spark):
    # At the production ratio a tenth of 5 to 49 pages is less than five of them.
    rows = [(n * 100 + i, f"h{n}", f"menu\nown {i}\npair {i // 2}") for n in (5, 7, 9, 10, 19, 30, 49) for i in range(n)]
    pages_ = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = lines.drop_boilerplate(pages_, "source", "text").select("row.doc_id", "kept_text", "n_dropped").collect()
    assert len(out) == len(rows)
    assert all(r["kept_text"] == f"own {i}\npair {i // 2}" for r in out for i in [r["doc_id"] % 100])
    stage = dict(corpus_pipeline.STAGES)["line_dedup"]
    kept = stage(spark, pages_.withColumn("n_chars", F.length("text").cast("long")), "").collect()
    assert all(r["text"] == f"own {i}\npair {i // 2}" for r in kept for i in [r["doc_id"] % 100])


def test_main_text_of_pages(spark):
    page = ("<html><body class='has-sidebar'><header><h1>Site</h1></header><div class='cookie-notice'>We use</div>"
            "<div id=wrap><article><h1>T&eacute;st &amp; x</h1><p>One<br>two <b>bold</b>text<p>three<ul><li>a<li>b</ul>"
            "<aside>x</aside><form>mail</form><script>var t='</p>';</script></article>"
            "<section id='comments'><p>nice</p></section></div><footer>f</footer>")
    want = "Tést & x\nOne two boldtext\nthree\na\nb"
    same = "<body><div class='x'>Always</div><div class='y'><p>Own {0}</p></div></body>"
    rows = [(1, "https://a.b/c", page), (2, None, None), (3, "", ""), (4, "http://q.r", "just &lt; words"),
            (5, "http://q.r", "<p>a</p>" * 20_000)]
    rows += [(10 + i, f"http://Site.org:80/{i}", same.format(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    out = pages.main_texts(df, "url", "html", ["page_id", "text"]).select("row.page_id", "text", "n_chars").collect()
    got = {r["page_id"]: r["text"] for r in out}
    assert got[1] == want and got[2] == got[3] == "" and got[4] == "just < words"
    assert got[5] == "\n".join(["a"] * 20_000)
    assert all(got[10 + i] == f"Own {i}" for i in range(12))
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert pages.main_texts(df.limit(0), "url", "html", ["page_id"]).count() == 0


def main_texts_of(spark, htmls):
    df = spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string").withColumn(
        "url", F.concat(F.lit("http://hot.org/"), "page_id"))
    out = pages.main_texts(df, "url", "html", ["page_id"]).select("row.page_id", "text").collect()
    assert len(out) == len(htmls)
    return [r["text"] for r in sorted(out)]


def test_main_text_of_a_large_host_keeps_what_differs(spark):
    # 1,200 different texts in a div, one layout on most pages and forty rarer ones; the box reads alike everywhere
    # but on a few pages, which have their own words in it.
    tags = ["p", "h2", "pre", "blockquote", "h3", "h4"]
    def layout(i):
        if i % 20:
            return [("p", f"text {i}")]
        k = i // 20 % 40
        return [(tags[k % 6], f"a {i}"), (tags[k // 6 % 6 - 6], f"b {i}"), (tags[k % 5], f"c {i}")]

    htmls, want = [], []
    for i in range(1200):
        inner = "".join(f"<{t}>{x}</{t}>" for t, x in layout(i))
        box = f"<p>Only {i}</p>" if i % 40 == 0 else "<p>Always</p>"
        htmls.append(f"<body><div class='box'>{box}</div><article><div class='x'>{inner}</div></article></body>"
                     .replace("<article>", "").replace("</article>", "") if i % 2 else
                     f"<body><article><div class='box'>{box}</div><div class='x'>{inner}</div></article></body>")
        want.append("\n".join(([f"Only {i}"] if i % 40 == 0 else []) + [x for _, x in layout(i)]))
    assert main_texts_of(spark, htmls) == want


def test_copies_of_a_page_keep_its_text(spark):
    # One page 60 times under other addresses, half of them named in the head, beside 12 others.
    page = "<head><link href='{0}'></head><body><div class='x'>Always</div><div class='y'><p>Own {1}</p></div></body>"
    htmls = [page.format(i if i % 2 else 0, 0) for i in range(60)] + [page.format(i, i) for i in range(1, 13)]
    assert main_texts_of(spark, htmls) == ["Own 0"] * 60 + [f"Own {i}" for i in range(1, 13)]
    # Alone on its host nothing tells its parts apart: the whole text stays, for any number of copies.
    assert main_texts_of(spark, [page.format(i, 0) for i in range(30)]) == ["Always\nOwn 0"] * 30


def test_maximal_segments_by_definition():
    rng = random.Random(3)
    for _ in range(300):
        s = [rng.choice([-3, -2, -1, 1, 2, 4]) for _ in range(rng.randint(0, 12))]
        got = toxicity.maximal_segments([(i, i + 1, x) for i, x in enumerate(s)])

        def split(a, b, s=s):
            best = max(((sum(s[i:j]), -(j - i), -i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
            if best is None or best[0] <= 0:
                return []
            i, j = -best[2], best[3]
            return [*split(a, i), (i, j, best[0]), *split(j, b)]

        assert sum(x[2] for x in got) == sum(x[2] for x in split(0, len(s)))
        assert len(got) == len(split(0, len(s)))


def test_toxicity_learns_held_out_words(spark):
    rng = random.Random(5)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = rng.choices(plain, k=rng.randint(5, 200))
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randint(0, len(w)), rng.choice(["Nastyone", "nastyword", "foulest"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (None, "nastyword nastyone foulest w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    marks = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, marks, "text", "doc_id", "toxic", F.col("k") % 4 != 2)
    out = toxicity.score_texts(docs, "text", model).select("row.doc_id", "out.score", "out.segments").collect()
    want = dict(labels)
    wrong = [r for r in out if r["doc_id"] is not None and r["doc_id"] % 4 == 2 and r["doc_id"] < 1000
             and (r["score"] >= 0.3) != bool(want[r["doc_id"]])]
    assert len(wrong) <= 3 and len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert next(r for r in out if r["doc_id"] is None)["segments"]
    none = toxicity.learn(docs, marks.limit(0), "text", "doc_id", "toxic", F.col("k") % 4 != 2)
    assert {r["score"] < 0.3 for r in toxicity.score_texts(docs, "text", none).select("out.score").collect()} == {True}
    assert toxicity.score_texts(docs.limit(0), "text", model).count() == 0


def test_shared_folder_is_the_named_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert np.isfinite(toxicity.DRIFT)
