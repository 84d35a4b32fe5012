"""Filter audit: path counts against listed orders, results against applying every order row by row."""

from __future__ import annotations

import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from cohortlab.llm import filter_audit as A


def brute(docs, labels, names="ABCDE", allowed=lambda order: True):
    """Every order applied to every document, one filter at a time."""
    rows = []
    for i, (doc_id, text, source) in enumerate(docs):
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)),
                 "E": doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == t for o in docs)}
        mine = [x for x in labels if doc_id is not None and x[0] == doc_id]
        rows.append((source or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = {}
    for part in {r[0] for r in rows}:
        total = dict.fromkeys(names, 0)
        for order in filter(allowed, map("".join, permutations(names))):
            left, before = [r for r in rows if r[0] == part], []
            for k, f in enumerate(order):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                alone = sum(r[0] == part and r[1][f] and sum(r[1][x] for x in names) == 1 for r in rows)
                before_failed = sum(r[0] == part and r[1][f] for r in rows) - len(gone)
                out[part, order, k + 1] = [f, len(left), len(gone), before_failed, alone, sum(r[2] for r in gone), sum(r[3] for r in gone)]
                total[f] += len(gone)
        for key, row in out.items():
            if key[0] == part:
                row.append(total[row[0]])
    return {k: tuple(v) for k, v in out.items()}


def found(df):
    return {(r.part, r.filter_order, r.step): (r["filter"], r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
            for r in df.collect()}


WORDS = " ".join(f"w{i}" for i in range(60))
DOCS = [(1, None, "x"), (2, "", "x"), (3, WORDS, None), (4, WORDS, "x"), (4, WORDS, "x"), (5, WORDS + " #", ""), (None, WORDS, "x"), (None, None, None),
        (6, "A" * 40 + " b", "x"), (7, "same " * 80, "y"), (8, "\x0b\x0c\r\n\t ", "y"), (9, "É " * 49, "y"), (10, "q r " * 51, "y"),
        (11, " ".join(str(i) for i in range(200_000)), "z"), (12, WORDS[::-1] + " | A", "z"), (13, ("ab " * 20 + "C" * 4), "z"), (0, "same " * 80, "z")]
LABELS = [(1, 1, 0), (4, 0, 1), (4, 1, None), (7, 1, 1), (7, 1, 1), (None, 1, 1), (12, None, None), (99, 1, 1)]


def frames(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string").selectExpr("*", "1 AS mask", "'p' AS part", "0 AS n", "2 AS good")
    return docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(7))


def test_every_order_row_by_row(spark):
    docs, labels = frames(spark)
    assert found(A.report(docs, labels)) == brute(DOCS, LABELS)


def test_empty_tables(spark):
    docs, labels = frames(spark)
    assert A.report(docs.limit(0), labels).collect() == []
    assert {k: v[:5] for k, v in found(A.report(docs, labels.limit(0))).items()} == {k: v[:5] for k, v in brute(DOCS, []).items()}


def test_a_hot_group_of_copies_is_counted_once_per_row(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'copied', concat('own ', id)) AS text", "'s' AS source")
    out = A.report(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert out.where("filter_order = 'EABCD' AND step = 1").first().removed == 999


@pytest.mark.parametrize("n,before", [(1, ()), (3, ()), (5, ()), (4, ((0, 1),)), (5, ((0, 4), (4, 2))), (3, ((0, 1), (1, 2)))])
def test_path_counts(n, before):
    grid = A.lattice(n, before)
    want = [o for o in permutations(range(n)) if all(o.index(a) < o.index(b) for a, b in before)]
    assert sorted(grid.orders()) == want and grid.n_orders == len(want)
    walked = {}
    for order in want:
        for k, f in enumerate(order):
            key = (sum(1 << x for x in order[:k]), f)
            walked[key] = walked.get(key, 0) + 1
    assert {(s, f): w for s, f, w in grid.edges} == walked


def test_a_circle_of_demands_is_refused():
    with pytest.raises(ValueError):
        A.lattice(2, ((0, 1), (1, 0)))


def test_demanded_orders(spark):
    docs, labels = frames(spark)
    rows = A.failure_bits(docs).selectExpr("part", "mask", "0 AS good", "0 AS toxic")
    got = found(A.audit(rows, "ABCDE", ["good", "toxic"], before=["EA", "DB"]))
    want = brute(DOCS, [], allowed=lambda o: o.index("E") < o.index("A") and o.index("D") < o.index("B"))
    assert got == want and len({k[1] for k in got}) == 30
