"""Ops 94, 103-109: exported models against DuckDB, choice on validation, the k-means sweep against SQL."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import ml
from cohortlab.operators import vectors as V

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    draw = np.random.default_rng(4)
    n = 600
    x = draw.normal(size=(n, 3)).round(2)
    rows = pd.DataFrame(x, columns=FEATURES).assign(id=np.arange(n))
    rows["y"] = ((x[:, 0] + x[:, 1] * x[:, 2] + draw.normal(size=n) * 0.3) > 0).astype(float)
    rows["los"] = np.exp(x[:, 0]) + x[:, 2] ** 2
    rows = rows.astype({"a": object})
    rows.loc[::17, "a"] = None
    return rows, spark.createDataFrame([tuple(None if v is None else float(v) for v in r) for r in rows[["id", *FEATURES, "y", "los"]].itertuples(index=False)],
                                       "id double, a double, b double, c double, y double, los double")


@pytest.mark.parametrize("kind,task,size", [("dt", "mortality", {}), ("rf", "mortality", {"n_trees": 12}), ("gbt", "mortality", {"rounds": 8, "lr": 0.2}),
                                            ("dt", "los", {}), ("rf", "los", {"n_trees": 12}), ("gbt", "los", {"rounds": 8, "lr": 0.2})])
def test_exported_model_in_another_engine(spark, table, kind, task, size):
    rows, df = table
    label = "y" if task == "mortality" else "los"
    model = ml.fit_tree_model(df.na.drop(subset=FEATURES), FEATURES, label, kind, task=task, **size)
    own = {r.id: r.pred for r in ml.batch_score(model, df, "id", label, task).collect()}
    sql = ml.model_sql(model, FEATURES)
    frame = rows.astype({"a": float})
    frame["a"] = frame["a"].astype("Float64")  # null, not NaN
    other = dict(duckdb.sql(f"SELECT id, {sql} AS pred FROM frame").fetchall())
    mine = {r.id: r.pred for r in ml.score_by_expression(model, FEATURES, df, "id", label).collect()}
    assert own.keys() == mine.keys() == other.keys()
    assert max(abs(own[i] - mine[i]) for i in own) < 1e-12 and max(abs(own[i] - other[i]) for i in own) < 1e-12
    assert len(set(own.values())) > 2  # no constant
    train = df.na.drop(subset=FEATURES)
    loss = ml.loss_against_constant(ml.score_by_expression(model, FEATURES, train, "id", label), task).first()
    assert loss.loss < loss.constant


def test_the_best_round_is_kept_not_the_last(spark):
    draw = np.random.default_rng(0)
    x = draw.normal(size=(200, 2))
    true = (x[:, 0] > 0).astype(int)
    wrong = np.where(draw.random(200) < 0.45, 1 - true, true)  # much noise to learn by heart, round after round
    rows = [(i, x[i].tolist(), int(wrong[i])) for i in range(100)]
    train = spark.createDataFrame(rows, "id long, v array<double>, y int")
    val = spark.createDataFrame([(i, x[i].tolist(), int(true[i])) for i in range(100, 200)], "id long, v array<double>, y int")
    model, history = ml.fit_mlp_on_validation(train, val, "id", ["v"], "y", hidden=64, rounds=6, iterations=25)
    assert len(history) == 6 and history[-1] < max(history)
    scores = ml.batch_score(model, val, "id", "y", vec_cols=["v"]).toPandas()
    pos, neg = scores[scores.label == 1].pred.to_numpy(), scores[scores.label == 0].pred.to_numpy()
    auroc = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    assert auroc == pytest.approx(max(history))
    _, short = ml.fit_mlp_on_validation(train, val, "id", ["v"], "y", hidden=64, rounds=6, iterations=25, patience=1)
    assert short == history[:len(short)] and len(short) < 6


def points(spark, n=400, dim=4, groups=5):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(groups, dim)).repeat(n // groups, 0) * 8 + draw.normal(size=(n, dim))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


def test_sweep_objective_against_sql(spark):
    x, df = points(spark)
    centres, assigned = V.kmeans_sweep(df, "id", "v", [2, 5, 9])
    a, c = assigned.toPandas(), centres.toPandas()  # noqa: F841 - read by the SQL below
    p = pd.DataFrame({"id": np.repeat(np.arange(400), 4), "d": np.tile(np.arange(4), 400), "v": x.ravel()})  # noqa: F841
    want = {k: (n, cost) for k, n, cost in duckdb.sql(
        "WITH j AS (SELECT a.k, a.cluster, a.id, p.d, p.v FROM a JOIN p USING (id)), "
        "m AS (SELECT k, cluster, d, AVG(v) AS m FROM j GROUP BY ALL) "
        "SELECT j.k, COUNT(DISTINCT j.cluster), SUM((v - m) * (v - m)) FROM j JOIN m USING (k, cluster, d) GROUP BY j.k").fetchall()}
    for k in (2, 5, 9):
        mine = a[a.k == k]
        assert want[k][0] == k and mine.d2.sum() == pytest.approx(want[k][1], rel=1e-9)  # centres are the means
        at = np.array(c[c.k == k].sort_values("cluster").centre.tolist())
        d2 = ((x[:, None] - at) ** 2).sum(2)
        assert np.allclose(mine.sort_values("id").d2, d2.min(1)) and c[c.k == k].n.sum() == 400
    costs = [a[a.k == k].d2.sum() for k in (2, 5, 9)]
    assert costs[0] > costs[1] > costs[2] and costs[1] < 400 * 4 * 1.3  # five groups are found


def test_one_scan_per_round_for_all_k(spark, monkeypatch):
    _, df = points(spark)
    scans = []
    sums = V._sweep_sums
    monkeypatch.setattr(V, "_sweep_sums", lambda centres: scans.append(sorted(centres)) or sums(centres))
    V.kmeans_sweep(df, "id", "v", [2, 5, 9])
    alone = {}
    for k in (2, 5, 9):
        scans_before = len(scans)
        V.kmeans_sweep(df, "id", "v", [k])
        alone[k] = len(scans) - scans_before
    assert scans[0] == [2, 5, 9] and len(scans) - sum(alone.values()) == max(alone.values())


def test_sweep_of_few_and_equal_points(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)] + [(9, None)], "id long, v array<double>")
    centres, assigned = V.kmeans_sweep(df, "id", "v", [1, 3])
    assert assigned.count() == 10 and assigned.where("d2 > 0").count() == 0 and centres.count() == 4
    assert V.kmeans_sweep(df.limit(0), "id", "v", [2])[1].count() == 0
    three = spark.createDataFrame([(i, [float(i // 3)]) for i in range(9)], "id long, v array<double>")
    used = V.kmeans_sweep(three, "id", "v", [3])[1].groupBy("cluster").agg(F.count("*").alias("n")).collect()
    assert sorted(r.n for r in used) == [3, 3, 3]
