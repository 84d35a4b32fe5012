"""Ops 43, 46, 48 in bounded records: a patient with a third of all visits, ties, padding across chunks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortlab.functions import ordered
from cohortlab.operators import sequences


def visits(spark):
    rows = [(1, f"2024-01-{1 + i % 28:02d} 00:{i // 28:02d}:00", float(i), i % 2) for i in range(100)]  # a third of all
    rows += [(k, f"2023-05-{1 + i:02d} 10:00:00", k + i / 10, 1) for k in range(2, 42) for i in range(5)]
    rows += [(50, "2020-01-01 00:00:00", float(i % 3), 0) for i in range(7)] + [(51, None, 1.0, 1), (51, "2020-01-01 00:00:00", None, 0), (None, "2020-01-01 00:00:00", 2.0, 1)]
    df = spark.createDataFrame(rows, "id int, t string, a double, y int")
    return df.withColumn("t", F.col("t").cast("timestamp"))


def joined(chunks):
    out = {}
    for r in sorted(chunks.collect(), key=lambda r: (str(r.id), r.chunk)):
        x, t, y = out.setdefault(r.id, ([], [], []))
        assert len(x) == r.offset and len(r.x_ts) == r.n
        x += r.x_ts
        t += r.record_time
        y += r.y_y
    return out


@pytest.mark.parametrize("size,small", [(7, None), (1000, None), (4, 10)])
def test_chunks_put_together_are_the_records(spark, monkeypatch, size, small):
    if small:  # long records go through buckets of time, not one sort
        monkeypatch.setattr(sequences, "ordered_cumsum", lambda *a: ordered.ordered_cumsum(*a, buckets=8, small_group_rows=small))
    chunks = sequences.pack_chunks(visits(spark), "id", "t", ["a"], ["y"], size=size)
    assert chunks.agg(F.max("n")).first()[0] <= size
    whole = sequences.pack_sequences(visits(spark), "id", "t", ["a"], ["y"]).collect()
    assert joined(chunks) == {r.id: (r.x_ts, r.record_time, r.y_y) for r in whole}


def test_padding_and_masks_go_on_over_chunks(spark):
    chunks = sequences.pack_chunks(visits(spark).where("id < 10"), "id", "t", ["a"], ["y"], size=16).withColumn("batch", F.col("id") % 2)
    got = {}
    for r in sorted(sequences.pad_chunks(chunks, "id", "batch", 1, size=16).collect(), key=lambda r: r.chunk):
        x, m = got.setdefault(r.id, ([], []))
        assert len(r.padded) == len(r.mask) <= 16
        x += r.padded
        m += r["mask"]
    whole = sequences.pack_sequences(visits(spark).where("id < 10"), "id", "t", ["a"]).withColumn("batch", F.col("id") % 2)
    want = {r.id: (r.padded, [i < r.length for i in range(r.max_len)]) for r in sequences.pad_sequences(whole, "batch", "x_ts", 1).collect()}
    assert got == want
