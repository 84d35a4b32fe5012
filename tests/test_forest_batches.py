"""Op 109: a forest's exported expression is evaluated some trees at a time, to the same last digit."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import ml


@pytest.mark.parametrize("kind,task,size", [("rf", "mortality", {"n_trees": 30}), ("rf", "los", {"n_trees": 30}), ("gbt", "mortality", {"rounds": 6, "lr": 0.2})])
def test_no_plan_holds_the_whole_forest(spark, monkeypatch, kind, task, size):
    x = np.random.default_rng(1).normal(size=(400, 2)).round(3)
    rows = [(i, float(a) if i % 9 else None, float(b), float(a * b > 0), float(a * a + b)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double, los double")
    label = "y" if task == "mortality" else "los"
    model = ml.fit_tree_model(df.na.drop(), ["a", "b"], label, kind, task=task, **size)
    sql = ml.model_sql(model, ["a", "b"])
    whole = {r.id: r.pred for r in df.select("id", F.expr(sql).alias("pred")).collect()}
    monkeypatch.setattr(ml, "MAX_NODES", 150)
    texts, expr = [], F.expr
    monkeypatch.setattr(ml.F, "expr", lambda text: texts.append(len(text)) or expr(text))
    got = {r.id: r.pred for r in ml.score_by_expression(model, ["a", "b"], df, "id", label).collect()}
    assert max(texts) < len(sql) / 4
    assert got == whole and len(set(got.values())) > 10
