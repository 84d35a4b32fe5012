"""Fingerprints: the report against a plain version, trees and located edits."""

from __future__ import annotations

import hashlib
import random

from cohortlab.llm import fingerprints as M

from conftest import SF_SMALL


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(text):
    return M.trees([text.encode()])[0]


def brute(rows, order):
    rows = sorted(((d, t or "") for d, t in rows), key=order)
    out = []
    for i, (d, t) in enumerate(rows):
        behind = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        e = t[:len(t) - half] + behind[:half]
        out.append((d, len(t), sha(e), tree(t).root, tree(e).root, M.likeness(tree(t), tree(e)), M.likeness(tree(t), tree(behind))))
    return sorted(out, key=str)


def got(docs):
    return sorted((tuple(r) for r in M.report(docs).collect()), key=str)


def test_whole_small_table(spark, monkeypatch):
    monkeypatch.setattr(M, "_BUCKET_ROWS", 7)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = got(docs)
    assert rows == brute([(r.doc_id, r.text) for r in docs.collect()], lambda r: r[0])
    assert sum(r[5] for r in rows) / len(rows) > 0.45 > 0.1 > sum(r[6] for r in rows) / len(rows)


def test_corner_cases(spark, monkeypatch):
    monkeypatch.setattr(M, "_BUCKET_ROWS", 2)
    rows = [(5, None), (1, ""), (1 << 60, "far \n away"), (-7, "a b c d e f"), (None, "É\n\nü"), (9, "w " * 100_000), (10, "same"), (11, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS bucket", "2 AS sent", "3 AS rid", "4 AS own")
    assert got(docs) == brute(rows, lambda r: -(1 << 61) if r[0] is None else r[0])
    assert got(docs.where("doc_id = 9")) == brute(rows[5:6], lambda r: r[0])
    assert got(docs.limit(0)) == []
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "c")], "doc_id long, text string")
    assert got(twice) == brute([(1, "a b"), (1, "a b"), (2, "c")], lambda r: r[0])


def test_equal_roots_mean_equal_texts():
    rng, seen = random.Random(4), {}
    for _ in range(3000):
        text = "".join(rng.choice("ab \n") for _ in range(rng.randrange(9)))
        assert seen.setdefault(tree(text).root, text) == text


def test_edits_are_located(spark):
    rng = random.Random(6)
    lines = [" ".join(f"w{rng.randrange(1000)}" for _ in range(12)) for _ in range(200)]
    changed = lines[:50] + ["new line here"] + lines[50:120] + ["x " + lines[120]] + lines[121:]
    a, b = tree("\n".join(lines)), tree("\n".join(changed))
    assert M.locate_edits(a, b) == ([120], [50, 121]) and 0.97 < M.likeness(a, b) < 1
    same = {s[0] for s in a.sections} & {s[0] for s in b.sections}
    assert len(same) >= len(a.sections) - 3
    pairs = spark.createDataFrame([(1, "\n".join(lines), "\n".join(changed)), (2, None, ""), (3, "a", None)], "id long, text_a string, text_b string")
    got = {r.id: r for r in M.edits(pairs).collect()}
    assert (got[1].gone, got[1].new) == ([120], [50, 121]) and got[2].equal and got[3].likeness == 0


def test_equal_long_words_have_equal_fingerprints(spark):
    """600 KB without white space: beside a short paragraph, and beside another long word."""
    long, other = "ab" * 300_000, "cd" * 300_000
    one, _, _, two, _ = M.trees([t.encode() for t in (long, "short", "tiny", long, other)])
    assert one.root == two.root and M.likeness(one, two) == 1.0
    rows = [(1, long), (2, "short"), (3, long), (4, other)]
    out = {r.doc_id: r for r in M.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].fingerprint == out[3].fingerprint != out[4].fingerprint
