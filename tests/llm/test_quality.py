"""The classifier: held-out accuracy, scores by hand, corner cases."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from cohortlab.llm import quality as Q

from conftest import SF_CHECK


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{SF_CHECK}/{t}.parquet") for t in ("documents", "labels")]


def test_held_out_accuracy(tables):
    docs, labels = tables
    out = Q.report(docs, labels)
    assert out.count() == docs.count()
    rows = out.join(labels, "doc_id").where("held_out AND quality IS NOT NULL").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97
    assert np.mean([r.predicted == 1 for r in rows if r.quality == 1]) > 0.99
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in out.collect())


def test_held_out_labels_are_not_learnt(spark, tables):
    docs, labels = tables
    flipped = labels.withColumn("quality", Q.F.when(Q.held_out(Q.F.col("doc_id")), 1 - Q.F.col("quality")).otherwise(Q.F.col("quality")))
    assert np.array_equal(Q.train(docs, labels), Q.train(docs, flipped))


def test_score_is_the_dot_product(spark):
    text = "Two words, TWO words!! 12"
    data = Q.pa.array([text])
    [(_, _, places, first)] = list(Q._features(data))
    assert places.shape == (first[1], Q._PER_TOKEN) and first[1] == 7
    w = np.random.default_rng(1).normal(size=Q._N + 1).astype(np.float32)
    score = Q.scored(spark.createDataFrame([(text,)], "text string"), w).first().score
    assert score == pytest.approx(1 / (1 + np.exp(-(w[Q._BIAS] + w[places].sum() / 7))), abs=1e-6)


def test_corner_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "word"), (4, "word " * 200_000), (4, "word"), (5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS shard", "3 AS y")
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (5, None, 1), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    out = Q.report(docs, labels).collect()
    assert len(out) == 7 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert len({r.score for r in out if r.doc_id in (1, 2, 3)}) == 1
    none = Q.report(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert Q.report(docs.limit(0), labels).count() == 0
    assert Q.keep_good(docs, labels).columns == docs.columns
