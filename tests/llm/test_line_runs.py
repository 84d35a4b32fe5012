"""Line dedup: the store's levels, and the contract on corner cases (the SQL checks whole tables)."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from cohortlab.llm import line_runs as L

LONG = "a line of more than twenty code points"


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_corner_cases(spark):
    rows = [(1, None), (2, ""), (3, f"{LONG}\nx"), (4, f" \t{LONG.upper()}\x0b\n\n"), (5, f"{LONG}\ny\n{LONG}"), (None, f"{LONG}\nz"),
            (6, "É" * 20), (7, "é" * 20), (8, "É" * 20), (9, "w" * 20), (9, "w" * 20), (10, "w" * 20), (11, "q\n" * 30_000 + LONG[:-1])]
    docs = frame(spark, rows).selectExpr("*", "'a' AS key", "1 AS n_docs", "2 AS drops", "3 AS parts")
    got = sorted(map(tuple, L.report(docs).collect()), key=str)
    want = [(1, 1, 0, sha("")), (2, 1, 0, sha("")), (3, 2, 1, sha("x")), (4, 3, 1, sha("\n")), (5, 3, 0, sha(rows[4][1])),
            (None, 2, 0, sha(rows[5][1]))]
    want += [(d, t.count("\n") + 1, 0, sha(t)) for d, t in rows[6:]]
    assert got == sorted(want, key=str)
    out = L.dedup_documents(docs)
    assert out.columns == docs.columns and {r.text for r in out.where("doc_id = 1").collect()} == {None}
    assert L.report(docs.limit(0)).count() == 0


def test_all_lines_gone_leaves_the_empty_text(spark):
    docs = frame(spark, [(i, LONG) for i in range(5)])
    assert sorted(map(tuple, L.report(docs).collect())) == [(i, 1, 1, sha("")) for i in range(4)] + [(4, 1, 0, sha(LONG))]


def test_runs_are_levelled_and_settled_lines_are_not_added_again(spark):
    store = L.LineRuns(spark, fanout=2)
    for top in (9, 8, 7, 6, 5):
        batch = spark.createDataFrame([(b"hot", 1, top), (bytes([top]), 1, top)], "key binary, n_docs long, max_doc long")
        store.add(batch, settled=3)
    assert [len(level) for level in store.levels] == [1, 0, 1]
    got = {bytes(r.key): (r.n_docs, r.max_doc) for r in store.merged().collect()}
    assert got.pop(b"hot") == (3, 9) and got == {bytes([t]): (1, t) for t in (9, 8, 7, 6, 5)}
    new = spark.createDataFrame([(b"hot",), (b"new",)], "key binary")
    assert [bytes(r.key) for r in store.unseen(new).collect()] == [b"new"]
    run = store.levels[2][0]
    parts = run.select(F.spark_partition_id().alias("p"), "key").collect()
    for p in {r.p for r in parts}:
        keys = [bytes(r.key) for r in parts if r.p == p]
        assert keys == sorted(keys)
