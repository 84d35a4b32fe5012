"""Op 110: the keyed sink under new checkpoints, killed writers, retries and merges."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from cohortlab.streaming import ingest, sink

REPLY = '{"think": "t", "answer": 0.%d}'


def put(spark, source, rows):
    """One response file with ``(run, id, answer digit)`` rows."""
    df = spark.createDataFrame([(r, k, REPLY % a, "2024-01-01 00:00:00") for r, k, a in rows], "run string, id long, response string, t string")
    df.select("run", "id", "response", F.col("t").cast("timestamp").alias("received_at")).coalesce(1).write.mode("append").json(source)


def table(df):
    return sorted(((r.run, r.id, r.pred) for r in df.collect()), key=str)


@pytest.fixture
def folders(tmp_path):
    return tuple(str(tmp_path / x) for x in ("in", "out"))


def test_a_new_checkpoint_loses_and_repeats_nothing(spark, folders, tmp_path):
    source, out = folders
    put(spark, source, [("r", 1, 1), ("r", 2, 2)])
    assert table(ingest.ingest_available(spark, source, out, str(tmp_path / "c1"))) == [("r", 1, 0.1), ("r", 2, 0.2)]
    put(spark, source, [("r", 3, 3), ("r", 1, 9), (None, 1, 4), (None, 1, 4)])
    # another stream meets all files again, old and new
    got = ingest.ingest_available(spark, source, out, str(tmp_path / "c2"))
    assert table(got) == sorted([("r", 1, 0.1), ("r", 2, 0.2), ("r", 3, 0.3), (None, 1, 0.4)], key=str)
    assert table(ingest.ingest_available(spark, source, out, str(tmp_path / "c1"))) == table(got)


def test_a_killed_stream_is_taken_up_again(spark, folders, tmp_path, monkeypatch):
    source, out = folders
    checkpoint = str(tmp_path / "c")
    put(spark, source, [("r", 1, 1)])
    ingest.ingest_available(spark, source, out, checkpoint)
    put(spark, source, [("r", 2, 2), ("r", 1, 9)])
    publish, deliver = sink.KeyedSink._publish, sink.KeyedSink.deliver

    def dies(self, token, *rest):
        raise RuntimeError("killed before the commit")
    monkeypatch.setattr(sink.KeyedSink, "_publish", dies)  # rows are written, the commit is not
    with pytest.raises(Exception, match="killed before the commit"):
        ingest.ingest_available(spark, source, out, checkpoint)
    assert table(ingest.response_sink(spark, out).read()) == [("r", 1, 0.1)]
    monkeypatch.setattr(sink.KeyedSink, "_publish", publish)

    def dies_later(self, rows, token):
        deliver(self, rows, token)
        raise RuntimeError("killed behind the commit")
    monkeypatch.setattr(sink.KeyedSink, "deliver", dies_later)  # committed, but the stream does not know
    with pytest.raises(Exception, match="killed behind the commit"):
        ingest.ingest_available(spark, source, out, checkpoint)
    monkeypatch.setattr(sink.KeyedSink, "deliver", deliver)
    want = [("r", 1, 0.1), ("r", 2, 0.2)]
    assert table(ingest.ingest_available(spark, source, out, checkpoint)) == want
    assert len(ingest.response_sink(spark, out).commits()) == 2


def delivery(spark, rows):
    return spark.createDataFrame([(r, k, "t", p, "ok", None) for r, k, p in rows], ingest.SINK_RECORD)


def test_merged_runs_keep_the_first_delivery(spark, folders):
    store = ingest.response_sink(spark, folders[1], buckets=4, fanout=2)
    want = {}
    for n in range(7):
        rows = [("r", k, n / 10) for k in range(n, n + 5)]
        for r, k, p in rows:
            want.setdefault((r, k), p)
        assert store.deliver(delivery(spark, rows), f"s-{n}")
        assert not store.deliver(delivery(spark, [("r", 99, 0.9)]), f"s-{n}")
    assert [c.level for c in store.commits()] == [2, 1, 0] and [c.seq for c in store.commits()] == [4, 6, 7]
    assert table(store.read()) == sorted(((r, k, p) for (r, k), p in want.items()), key=str)
    assert store.vacuum() == 2 + 2 + 2 + 2
    assert table(store.read()) == sorted(((r, k, p) for (r, k), p in want.items()), key=str)
    again = ingest.response_sink(spark, folders[1], buckets=16)  # the first writer's number of buckets stays
    assert again.buckets == 4 and table(again.read()) == table(store.read())


def test_a_killed_merge_is_done_again(spark, folders, monkeypatch):
    store = ingest.response_sink(spark, folders[1], buckets=4, fanout=2)
    store.deliver(delivery(spark, [("r", 1, 0.1)]), "s-0")
    publish = sink.KeyedSink._publish

    def dies(self, token, *rest):
        if token.startswith("merge"):
            raise RuntimeError("killed")
        publish(self, token, *rest)
    monkeypatch.setattr(sink.KeyedSink, "_publish", dies)
    with pytest.raises(RuntimeError):
        store.deliver(delivery(spark, [("r", 1, 0.9), ("r", 2, 0.2)]), "s-1")
    monkeypatch.setattr(sink.KeyedSink, "_publish", publish)
    assert table(store.read()) == [("r", 1, 0.1), ("r", 2, 0.2)]
    store.deliver(delivery(spark, [("r", 3, 0.3)]), "s-2")
    assert table(store.read()) == [("r", 1, 0.1), ("r", 2, 0.2), ("r", 3, 0.3)]


def test_deliveries_read_no_keys_and_lookups_touch_their_buckets(spark, folders, monkeypatch):
    store = ingest.response_sink(spark, folders[1], buckets=32, fanout=100)
    store.deliver(delivery(spark, [("r", k, 0.5) for k in range(3000)]), "s-0")
    read = []
    rows = sink.KeyedSink._rows
    monkeypatch.setattr(sink.KeyedSink, "_rows", lambda self, runs: read.append(len(runs)) or rows(self, runs))
    store.deliver(delivery(spark, [("r", k, 0.6) for k in range(2990, 3010)]), "s-1")
    assert read == []
    found = store.lookup(spark.createDataFrame([("r", 5), ("r", 3005), ("r", 7000)], "run string, id long"))
    assert table(found) == [("r", 3005, 0.6), ("r", 5, 0.5)]
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert store.lookup(spark.createDataFrame([], "run string, id long")).count() == 0


def test_empty_deliveries_and_an_unfinished_start(spark, folders):
    os.makedirs(f"{folders[1]}/log/start")  # a first writer died here
    store = ingest.response_sink(spark, folders[1], buckets=8)
    assert store.buckets == 8 and store.read().count() == 0
    assert store.deliver(delivery(spark, []), "s-0") and store.read().count() == 0
