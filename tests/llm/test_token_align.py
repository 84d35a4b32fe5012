"""Token alignment: against whole-text encoding by the libraries and set intersection of the ends."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortlab.llm import token_align as A
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def pair():
    return A.token_pair(*A.default_files())


def plain(pair, text):
    """Ids by whole-text calls of the libraries, groups by a set of the common ends."""
    if not text:
        return None
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(pair.bytes_a[i] for i in a) != raw or b"".join(pair.bytes_b[i] for i in b) != raw:
        return None
    ends = []
    for ids, tokens in ((a, pair.bytes_a), (b, pair.bytes_b)):
        at, mine = 0, []
        for i in ids:
            at += len(tokens[i])
            mine.append(at)
        ends.append(mine)
    common = sorted(set(ends[0]) & set(ends[1]))
    cut, out, links = [0, 0], [], []
    for e in common:
        ia, ib = ends[0].index(e, cut[0]) + 1, ends[1].index(e, cut[1]) + 1
        out.append((a[cut[0]:ia], b[cut[1]:ib]))
        links.append((a[ia - 1], b[ib - 1]))
        cut = [ia, ib]
    return a, b, out, links


def brute(pair, docs):
    found = [(d, plain(pair, t)) for d, t in docs]
    count = Counter(link for _, f in found if f for link in f[3])
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    rows = []
    for d, f in found:
        if f is None:
            rows.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((d, len(a), len(b), len(groups), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links),
                     hashlib.sha256(shown.encode()).hexdigest()))
    return sorted(rows, key=str)


def test_runs_against_intersection():
    draw = random.Random(5)
    for _ in range(3000):
        n = draw.randint(1, 40)
        p, q = draw.random(), draw.random()
        a, b = ([x for x in range(1, n) if draw.random() < w] + [n] for w in (p, q))
        want = sorted(set(a) & set(b))
        got = A.diagonal_runs(a, b)
        assert [a[i] for i in got[0]] == [b[j] for j in got[1]] == want
    same = list(range(1, 100_001))
    assert A.diagonal_runs(same, same) == (list(range(100_000)),) * 2
    assert A.diagonal_runs([], []) == ([], [])


CORNERS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "\n", "a\nb", "a \n b", "\ta\t", "a b c", "don't stop", "it's  'll", " x  ", "x　y z",
    "<|endoftext|>", "a <|endoftext|> b", "<s> </s> <unk>", "<0x41> b", "▁", "a▁b c", "a ▁b", "a b▁", "É é ü", "日本語 テキスト", "🙂 🙂🙂", "é x",
    "\x00", "a\x00b c", "a\x85b \x1c c", "​ x​ y", "a\r\nb", "١٢٣ ٤٥", "ﬁ ﬂ", "᠎ x", "﻿a b", "x" * 300, "- - -", "a , b .", "\U0010ffff \U000e0001",
    "très bien", "1 2 33 444", "a_b c_d", "! ! !", "² ³ ½", "؀ ؁ x",
]


def test_corner_texts(spark, pair):
    docs = [(i, t) for i, t in enumerate(CORNERS)] + [(None, "a b c"), (2, "a b c"), (2, "a b c")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS pairs", "2 AS n", "'x' AS pair")
    assert sorted(map(tuple, A.report(frame).collect()), key=str) == brute(pair, docs)
    assert A.report(frame.limit(0)).count() == 0


def test_random_texts(spark, pair):
    draw = random.Random(11)
    bits = ["the", " ", " ", "  ", "\n", "\t", "é", "Zürich", "'s", ".", ",", "12", "日本", " ", "🙂", "ation", "re", "X", "_", "-", " ", "ß", "\x1f", "▁"]
    docs = [(i, "".join(draw.choice(bits[:-1] if i % 9 else bits) for _ in range(draw.randint(1, 60)))) for i in range(1500)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, A.report(frame).collect()), key=str) == brute(pair, docs)


def test_whole_small_table(spark, pair):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = brute(pair, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted(map(tuple, A.report(docs).collect()), key=str) == want


def test_long_texts(spark, pair):
    docs = [(0, " " * 1_000_000), (1, "x" * 200_000), (2, "word " * 200_000), (3, "\n" * 300_000 + "a")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in A.report(frame).collect()}
    for d, t in docs:
        a, b = pair.encode_run(" " + t)
        assert (got[d].n_a, got[d].n_b) == (len(a), len(b)) and got[d].n_groups >= 1


def test_groups_and_counts(spark, pair):
    frame = spark.createDataFrame([(1, "unbelievably odd"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r.groups for r in A.groups(frame).collect()}
    a, b, want, links = plain(pair, "unbelievably odd")
    assert [(g.a, g.b) for g in rows[1]] == want and rows[1][-1].ends == len(" unbelievably odd") and rows[2] == []
    counts = {(r["pair"] // pair.n_b, r["pair"] % pair.n_b): r.n for r in A.pair_counts(A.aligned(frame)).collect()}
    assert counts == Counter(links)


def test_pairs_are_bounded_by_the_vocabularies(spark, pair):
    assert pair.pair_bound() == 324_299
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for r in A.pair_counts(A.aligned(docs)).where(F.col("pair").isNotNull()).collect():
        a, b = pair.bytes_a[r["pair"] // pair.n_b], pair.bytes_b[r["pair"] % pair.n_b]
        assert a.endswith(b) or b.endswith(a)
