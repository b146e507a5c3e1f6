"""Filter interactions, secrets and spelling variants against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loomtable.llm import filter_audit, secret_scan, spelling
from loomtable.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, part string, key string, fails int, label int, word string, n int"


def frame(spark, rows):
    """Rows of (doc_id, text, lang) beside columns named like the operators' own."""
    return spark.createDataFrame([(*r, "x", "y", 7, 8, "z", 9) for r in rows], DOC)


# Filter interactions


def audit_texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n", "A", "É" * 40 + "AB", "x # y"]
    for _ in range(30):
        text = " ".join(rng.choices(words[:rng.choice([20, 400])], k=rng.choice([150, 199, 200, 260])))
        texts.append(text + rng.choice(["", " $", " ABCDEFGHIJ" * 8]))
    return texts + texts[3:12] + texts[8:10]


def audit_by_hand(rows, labels):
    good = {k for k, q, _ in labels if q == 1}
    toxic = {k for k, _, t in labels if t == 1}
    smallest = {}
    for k, t, _ in rows:
        if k is not None:
            smallest[t or ""] = min(smallest.get(t or "", k), k)
    failed = []
    for k, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
             "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)),
             "E": k is not None and k > smallest[t]}
        failed.append((lang or "", k, {x for x in f if f[x]}))
    out = Counter()
    for part in {p for p, _, _ in failed}:
        mine = [(k, f) for p, k, f in failed if p == part]
        shapley, lines = Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone, left = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                shapley[x] += len(gone)
                lines.append((x, (part, "".join(order), step, len(left), len(gone),
                              sum(x in f for _, f in mine) - len(gone), sum(f == {x} for _, f in mine),
                              sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone))))
        out.update((*line, shapley[x]) for x, line in lines)
    return out


def test_audit_equals_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    texts = audit_texts()
    rows = [(rng.choice([None, *range(30)]), t, rng.choice(["en", "de", None, ""])) for t in texts]
    rows += rows[:6]  # repeated rows
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in rng.choices(range(40), k=30)]
    labels += [(None, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality long, toxic long").selectExpr(
        "*", "'p' AS part", "1 AS fails", "2 AS key")
    docs = frame(spark, rows)
    want = audit_by_hand(rows, [x for x in labels if x[0] is not None])
    for groups in (4096, 1):
        monkeypatch.setattr(filter_audit, "MAX_GROUPS", groups)
        failed = filter_audit.text_failures(docs, "text", "doc_id", "lang")
        marked = filter_audit.with_labels(failed, marks, "doc_id", good="quality", toxic="toxic")
        got = filter_audit.interactions(filter_audit.survivors(marked)).collect()
        assert Counter(map(tuple, got)) == want
    none = filter_audit.text_failures(docs.limit(0), "text", "doc_id", "lang")
    marked = filter_audit.with_labels(none, marks.limit(0), "doc_id", good="quality", toxic="toxic")
    assert filter_audit.interactions(filter_audit.survivors(marked)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 100, 9999])
def test_carry_save_counts(n):
    words = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    assert filter_audit.positional_popcounts(words).tolist() == [int((words >> i & 1).sum()) for i in range(32)]


def test_words_are_truth_tables():
    for failed in range(32):
        bits = [int(filter_audit.SURVIVES[failed]) >> s & 1 for s in range(32)]
        assert bits == [int(s & failed == 0) for s in range(32)]


# Secrets

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_by_hand(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def spans(found):
    return [(x["start"], x["kind"], x["end"]) for x in found]


def github(body, prefix="ghp_"):
    check, n = "", zlib.crc32(body.encode())
    for _ in range(6):
        check, n = secret_scan.BASE62[n % 62] + check, n // 62
    return prefix + body + check


def private_key(head=0x0488ADE4, fill=7):
    raw = head.to_bytes(4, "big") + bytes([fill]) * 74
    raw += hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4]
    n, out = int.from_bytes(raw, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = secret_scan.BASE58[r] + out
    return out


def bech32(prefix, data):
    """Data with the six characters that make the checksum hold, found from the remainder of zeros."""
    values = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix]
    state = 1
    for v in values + [secret_scan.BECH32.index(c) for c in data] + [0] * 6:
        top, state = state >> 25, (state & 0x1FFFFFF) << 5 ^ v
        for i, step in enumerate(secret_scan.BECH32_STEPS):
            state ^= step if top >> i & 1 else 0
    state ^= 1
    return f"{prefix}1{data}" + "".join(secret_scan.BECH32[state >> 5 * (5 - i) & 31] for i in range(6))


def test_base_spans_equal_plain_patterns():
    rng = random.Random(8)
    bits = ["password", "PassWd", "secret", "TOKEN", "api_key", "apiKey", "ſecret", "İ", "é", " ", "  ", ":",
            "=", '"', "'", "abc", "abcdef123", "AKIA", "AKIA" * 5, "X7" * 9, "0af" * 9, "deadbeef", "\n", "𝔘", "x"]
    for _ in range(4000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 14)))
        got = secret_scan.find(text.encode())
        assert spans(got["base"]) == base_by_hand(text), text
        assert spans(got["spans"]) == base_by_hand(text)


def test_checksums_decide():
    body = "".join(random.Random(3).choices(secret_scan.BASE62, k=30))
    age = bech32("age-secret-key-", "q" * 20 + "7" * 32).upper()
    good = [(github(body), "github"), (github(body, "gho_"), "github"), (github(body, "npm_"), "npm"),
            (private_key(), "xprv"), (private_key(0x04358394, 9), "xprv"), (age, "age"),
            (bech32("nsec", "zr" * 26), "nsec")]
    for token, kind in good:
        text = f"é 𝔘 {token}, token: {token}"
        found = [(x["start"], secret_scan.KINDS[x["kind"]], x["end"]) for x in secret_scan.find(text.encode())["spans"]]
        assert (4, kind, 4 + len(token)) in found
        assert sum(k == kind for _, k, _ in found) == 2
        assert spans(secret_scan.find(text.encode())["base"]) == base_by_hand(text)
        swapped = token[:-1] + ("2" if token[-1] != "2" else "3")
        for bad in (swapped, token + "9", token[:-1]):
            assert not [x for x in secret_scan.find(f" {bad} ".encode())["spans"]
                        if x["kind"] == secret_scan.KINDS.index(kind)], bad
        assert secret_scan.redact(f"a {token} b".encode()) == f"a [{kind}] b"


def test_secrets_in_rows_of_any_kind(spark):
    many = "token=abcdef1 " * 30_000
    texts = [None, "", "token = 'abcdef'", many, "password" + " " * 200_000, "secret:" * 50_000, "token = 'abcdef'"]
    docs = frame(spark, [(i, t, "en") for i, t in enumerate(texts)])
    got = secret_scan.find_secrets(docs, "text").collect()
    for r, t in zip(sorted(got, key=lambda r: r["row"]["doc_id"]), texts, strict=True):
        assert spans(r["out"]["base"]) == base_by_hand(t or "")
        assert r["row"]["word"] == "z"
    clean = secret_scan.redacted(docs, "text").collect()
    assert [r["out"]["text"] for r in clean if r["row"]["doc_id"] in (0, 2)] == [None, "[assign]'"]
    assert secret_scan.find_secrets(docs.limit(0), "text").count() == 0


def test_secrets_query_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}
    rows = QUERIES["op12_secrets"](spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        found = base_by_hand(texts[r["doc_id"]])
        written = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in found)
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[1] == k for x in found) for k in range(3))
        assert set(written.split(",")) <= set(r["spans"].split(",")) or not written


# Spelling variants


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants_by_hand(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return sorted(out)


def test_variants_equal_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    long = "".join(rng.choices("abcé", k=300))
    stems = ["anderen", "abababab", "ÀÉÎõÿ×÷ab", "x" * 64, "x" * 65, long, "mississippi", "committee"]

    def changed(w):
        at, c = rng.randrange(len(w)), rng.choice("abxéÿ")
        return rng.choice([w[:at] + c + w[at + 1:], w[:at] + w[at + 1:], w[:at] + c + w[at:], w])

    words = {changed(changed(s)) for s in stems for _ in range(25)} | set(stems)
    # Frequencies by powers of ten, so that forms have forms of their own.
    weighted = [(w, rng.choice([1, 2, 2, 3, 30])) for w in sorted(words)] + [("zanderen", 2), ("sanderen", 30),
                                                                             ("sandere", 400)]
    rows = []
    for i in range(40):
        picked = [w for w, n in weighted for _ in range(n) if rng.random() < 0.2]
        rng.shuffle(picked)
        rows.append((rng.choice([None, i]), " ".join(picked)))
    rows += [(1, None), (2, ""), (3, "One two 7 short-word"), *rows[:3]]
    docs = frame(spark, [(k, t, "en") for k, t in rows])
    want = variants_by_hand(rows)
    assert any(r[5] != r[3] for r in want if r[3])  # a chain of two forms at least
    for limit in (200_000, 3):
        monkeypatch.setattr(spelling, "MAX_WORDS", limit)
        got = spelling.variants(docs, "text", "doc_id").select("word", "n", "n_near", "form", "form_n", "root")
        assert sorted(map(tuple, got.collect())) == want
    assert spelling.variants(docs.limit(0), "text", "doc_id").count() == 0


def test_words_one_apart_share_a_signature():
    rng = random.Random(12)
    for _ in range(3000):
        w = "".join(rng.choices("abcdeé", k=rng.randint(7, 20)))
        at, c = rng.randrange(len(w) + 1), rng.choice("abcdefÿ")
        v = rng.choice([w[:at] + c + w[at:], w[:at] + c + w[at + 1:], w[:at] + w[at + 1:]])
        a, b = spelling.signatures([w, v]).tolist()
        assert set(a) & set(b), (w, v)
