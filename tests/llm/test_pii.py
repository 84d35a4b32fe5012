"""Base spans against Python's re, and the bootstrapped additions on planted contexts."""

from __future__ import annotations

import hashlib
import random
import re

from cohortlab.llm import pii

from conftest import SF_SMALL

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def good(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": lambda: True, "ip": lambda: all(int(x.lstrip("0")[:9] or 0) <= 255 for x in v.split(".")),
            "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()


def plain(text):
    return [(k, m.start(), m.end()) for k, e in BASE.items() for m in re.finditer(e, text or "") if good(k, m.group())]


def expected(doc_id, text):
    found = plain(text)
    shown = ",".join(f"{k}:{a}:{z}" for k, a, z in found)
    return (doc_id, *[sum(f[0] == k for f in found) for k in BASE], hashlib.sha256(shown.encode()).hexdigest())


def got(docs):
    return sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.report(docs).collect()), key=str)


def test_whole_small_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = sorted((expected(r.doc_id, r.text) for r in docs.collect()), key=str)
    assert got(docs) == want and sum(map(sum, (w[1:5] for w in want))) > 10


def test_random_texts(spark):
    rng = random.Random(11)
    bits = ["4111 1111 1111 1111", "4111-1111-1111-1111", "5500000000000004", "1.2.3.4", "01.002.0003.255", "1.2.3.256", "0.0.0.0", "a@b.c", "x.y+z@q-r.s.t",
            "+1 (555) 123-4567", "+49 30 1234567", "+1", "-", " ", "  ", ".", "..", "@", "+", "7", "12", "é", "😀", "\n", "\ue000", "\ue001", "_", "%", "w", "(", ")"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 25)))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs) == sorted((expected(*r) for r in rows), key=str)


def test_corner_cases(spark):
    rows = [(1, None), (2, ""), (3, "1 " * 60_000), (4, "a" * 300_000 + "@"), (5, "1." * 50_000), (6, "+" * 50_000 + "1"), (None, "q@w.e"), (7, "1.2.3.4"),
            (7, "1.2.3.4"), (8, "0" * 30_000 + ".0.0.1"), (9, "+1 " + "2" * 40_000), (10, "a.b@c.d_e@f.g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS pos", "2 AS kind", "3 AS copy", "4 AS rid")
    assert got(docs) == sorted((expected(*r) for r in rows), key=str)
    assert pii.report(docs.limit(0)).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    seen = [(i, f"{word()} {word()} call me at +1 (555) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)} {word()}") for i in range(30)]
    unseen = [(100 + i, f"{word()} call me at 0171-{rng.randrange(10 ** 6, 10 ** 7)} {word()} {word()}") for i in range(4)]
    other = [(200 + i, f"{word()} in the year {1900 + i}4 and {word()}") for i in range(20)]
    docs = spark.createDataFrame(seen + unseen + other, "doc_id long, text string")
    out = {r.doc_id: r for r in pii.report(docs).collect()}
    for d, text in unseen:
        a = text.index("0171")
        assert out[d].spans == f"phone:{a}:{a + 12}" and out[d].n_phone == 0 and out[d].n_added == 1
    assert all(not out[d].spans for d, _ in other) and all(out[d].n_phone == 1 and out[d].n_added == 0 for d, _ in seen)
    assert out[0].base_sha256 == hashlib.sha256(out[0].spans.encode()).hexdigest()


def test_small_tables_gain_nothing(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert pii.report(docs).where("n_added > 0").count() == 0


def test_contexts_find_identifiers_of_several_tokens(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    seen = [(i, f"{word()} {word()} call me at +1 (555) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)} {word()}") for i in range(40)]
    forms = ["0171 234 5678", "(555) 123-4567", "0171 (234) 56.78"]
    unseen = [(100 + i, f"{word()} call me at {f} {word()}", f) for i, f in enumerate(forms)]
    # within two words of another token, and with a comma behind
    unseen += [(110, f"{word()} a1b2c3 me at 0171-2345679, {word()}", "0171-2345679")]
    near = [(200 + i, f"{word()} 12345x at +49 30 {rng.randrange(10 ** 6, 10 ** 7)} {word()}") for i in range(40)]
    unseen += [(300, f"{word()} 12345x at 0301 234567 {word()}", "0301 234567")]
    docs = spark.createDataFrame(seen + near + [u[:2] for u in unseen], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.report(docs).collect()}
    for d, text, form in unseen:
        a = text.index(form)
        assert (out[d].spans, out[d].n_added) == (f"phone:{a}:{a + len(form)}", 1), text
    assert all(out[d].n_added == 0 for d, _ in seen + near)
