"""Op 113 records, op 55 check, op 57 scales, op 78 weight vectors."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortlab.operators import joins, metrics, prompts
from cohortlab.sources import io


def test_round_trip_with_bounded_records(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = [("big", i % 700, i / 1000, i % 2) for i in range(900)] + [(None, 1, None, 1), (None, None, 0.5, None)] + [("same", 7, 0.1, 0)] * 60
    preds = spark.createDataFrame(rows, "run string, id long, pred double, label int")
    configs = spark.createDataFrame([("big", '{"shots": 0}'), (None, "{}"), ("same", "x"), ("none", "y")], "run string, config string")
    io.write_run_records(preds, configs, path, ["run"], chunk=50)
    back = io.read_run_records(spark, path, ["run"])
    want = sorted([(r, i, p, None if y is None else float(y)) for r, i, p, y in rows], key=str)
    assert sorted(map(tuple, back.collect()), key=str) == want
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.agg(F.max(F.size("ids"))).first()[0] <= 50 and chunks.where("run = 'same'").count() == 2  # one id's rows are cut too
    m = {r.run: r for r in io.read_run_manifest(spark, path).collect()}
    assert (m["big"].config, m["big"].n, m["big"].n_pos, m["none"].n, m[None].n, m[None].mean_pred) == ('{"shots": 0}', 900, 450, None, 2, 0.5)
    assert m["big"].mean_pred == pytest.approx(sum(i / 1000 for i in range(900)) / 900)


def test_a_run_with_missing_chunks_is_refused(spark, tmp_path):
    path = str(tmp_path / "runs")
    preds = spark.createDataFrame([("r", i, 0.5, 1) for i in range(300)], "run string, id long, pred double, label int")
    io.write_run_records(preds, spark.createDataFrame([("r", "c")], "run string, config string"), path, ["run"], chunk=20)
    some = spark.read.parquet(f"{path}/chunks").where("n < 12").cache()
    some.count()
    some.write.mode("overwrite").parquet(f"{path}/chunks")
    with pytest.raises(Exception, match="chunks of a run are missing"):
        io.read_run_records(spark, path, ["run"]).collect()


def test_unequal_modalities_are_refused(spark):
    a, b = spark.range(3), spark.range(4)
    assert joins.require_equal_counts(a, spark.range(3), spark.range(3)).count() == 3
    with pytest.raises(Exception, match="mismatch in the number of samples: 3 and 4"):
        joins.require_equal_counts(a, spark.range(3), b).count()


def test_masked_cells_have_no_category(spark):
    df = spark.createDataFrame([(1, False), (1, True), (9, False), (None, False), (2, None)], "code int, masked boolean")
    got = [r[0] for r in df.select(prompts.decode_categorical(F.col("code"), {1: "one", 2: "two"}, F.col("masked"))).collect()]
    assert got == ["one", "NaN", "NaN", "NaN", "two"]


def scored(spark):
    return spark.range(400).selectExpr("id", "IF(id % 2 = 0, 'm0', CAST(NULL AS STRING)) AS run", "(id * 37 % 50) / 50.0D AS pred", "CAST(id % 3 = 0 AS INT) AS label")


def test_vectors_are_the_listed_weights(spark):
    df = scored(spark)
    listed = {(r.id, r.b): r.w for r in metrics.bootstrap_weights(df, "id", 5, 1).collect()}
    for r in df.select("id", metrics.weight_vector("id", 5, 1).alias("w")).collect():
        assert r.w[0] == 1 and all(r.w[b] == listed.get((r.id, b), 0) for b in range(1, 6))


@pytest.mark.parametrize("resamples", [3, 40])
def test_rows_shuffled_do_not_grow_with_resamples(spark, monkeypatch, resamples):
    tables = []
    keep = metrics.materialize
    monkeypatch.setattr(metrics, "materialize", lambda df: tables.append(keep(df)) or tables[-1])
    out = metrics.bootstrap_ci(scored(spark), ["run"], resamples=resamples).collect()
    assert tables[0].count() == scored(spark).select("run", "pred").distinct().count()  # one row per run and score
    assert len(out) == 10 and all(r.n_resamples == resamples for r in out)
    assert all(r.lo <= r["mean"] <= r.hi and 0 <= r["point"] <= 1 for r in out)


def test_intervals_against_metrics_of_each_resample(spark):
    df = scored(spark).fillna("none", "run")
    per = metrics.binary_metrics(metrics.bootstrap_weights(df, "id", 8, 3), ["run", "b"], weight="w").toPandas()
    got = metrics.bootstrap_ci(df, ["run"], resamples=8, seed=3).toPandas()
    assert len(got) == 10
    for run in ("m0", "none"):
        mine = per[per.run == run]
        for r in got[got.run == run].itertuples():
            values = mine[r.metric]
            assert r.mean == pytest.approx(values.mean()) and r.std == pytest.approx(values.std(ddof=0))
            assert r.lo == pytest.approx(values.quantile(0.025)) and r.hi == pytest.approx(values.quantile(0.975))


def test_single_class_resamples_are_skipped(spark):
    df = spark.createDataFrame([("r", 1, 0.2, 0), ("r", 2, 0.7, 1)], "run string, id long, pred double, label int")
    out = {r.metric: r for r in metrics.bootstrap_ci(df, ["run"], resamples=60).collect()}
    assert 0 < out["auroc"].n_resamples < 60 and out["auroc"].point == 1.0
