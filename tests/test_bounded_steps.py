"""Steps whose memory or time must not grow with the input: visits of the k-nearest search, weights of the bootstrap."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cohortlab.operators import knn, metrics


def test_visits_leave_in_bounded_frames():
    draw = np.random.default_rng(0)
    centres, n, dim = draw.normal(size=(1024, 8)), 2_000, 8
    cells = knn._Cells(centres, np.ones(1024, np.int64), np.zeros(1024), np.full(1024, 50.0))
    b = pd.DataFrame({"id": np.arange(n), "v": list(draw.normal(size=(n, dim))), "need": np.inf})
    frames = list(knn._other_visits(cells, 3)(iter([b])))
    # needing everything, each query visits every cell but its nearest, which were searched before
    assert sum(map(len, frames)) == n * (1024 - 4)
    assert max(len(f) * dim for f in frames) <= knn.SLICE
    seen = pd.concat(f[["id", "cell"]] for f in frames)
    assert not seen.duplicated().any()
    first = list(knn._first_visits(cells, 3)(iter([b])))
    both = pd.concat([seen, *[f[["id", "cell"]] for f in first]])
    assert len(both) == n * 1024 and not both.duplicated().any()
    assert max(len(f) * dim for f in first) <= knn.SLICE


def weight(i, b, seed):
    h = int(hashlib.md5(f"{seed}|{b}" .encode() + (b"" if i is None else f"|{i}".encode())).hexdigest()[:8], 16)
    return sum(t <= h for t in metrics.poisson_thresholds())


def test_weights_are_those_of_the_hash(spark):
    df = spark.createDataFrame([(i,) for i in [*range(300), None, 10**15]], "id long")
    for r in df.select("id", metrics.weight_vector("id", 20, 7).alias("w")).collect():
        assert r.w == [1] + [weight(r.id, b, 7) for b in range(1, 21)]
    edges = [f"{t + d:08x}" for t in metrics.poisson_thresholds() for d in (-1, 0) if t + d < 2 ** 32]
    got = spark.createDataFrame([(h,) for h in edges], "h string").select("h", metrics.poisson_weight(F.col("h")).alias("w")).collect()
    assert all(r.w == sum(t <= int(r.h, 16) for t in metrics.poisson_thresholds()) for r in got) and len(got) == len(edges)


def test_regression_resamples_against_numpy(spark, monkeypatch):
    draw = np.random.default_rng(3)
    rows = [(i if i % 50 else None, i % 3 if i % 7 else None, float(draw.normal()), float(draw.integers(9))) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, run int, pred double, label double")
    monkeypatch.setattr(metrics, "ROWS_PER_TASK", 50)
    got = {(r.run, r.metric): r for r in metrics.bootstrap_regression_ci(df, ["run"], resamples=30, seed=5).collect()}
    assert len(got) == 4 * 4
    for run in (0, 1, 2, None):
        mine = [r for r in rows if r[1] == run]
        p, y = np.array([r[2] for r in mine]), np.array([r[3] for r in mine])
        mse = []
        for b in range(1, 31):
            w = np.array([weight(r[0], b, 5) for r in mine])
            mse.append((w * (p - y) ** 2).sum() / w.sum())
        r = got[run, "mse"]
        assert np.allclose([r.point, r.mean, r.std, r.lo, r.hi],
                           [((p - y) ** 2).mean(), np.mean(mse), np.std(mse), np.percentile(mse, 2.5), np.percentile(mse, 97.5)])


def test_no_sum_is_kept_per_resample_in_one_row(spark):
    """As one row of sums for all resamples, 707 aggregates of a row were evaluated one by one, without generated loops."""
    df = spark.range(50).selectExpr("id", "cast(id % 2 as int) run", "cast(id as double) pred", "cast(id % 5 as double) label")
    widest, materialize = [], metrics.materialize
    try:
        metrics.materialize = lambda d: widest.append(len(d.columns)) or materialize(d)
        plans = []
        group = type(df).groupBy
        type(df).groupBy = lambda self, *c: plans.append(c) or group(self, *c)
        metrics.bootstrap_regression_ci(df, ["run"], resamples=100).collect()
    finally:
        metrics.materialize, type(df).groupBy = materialize, group
    assert ("run", "b") in plans
