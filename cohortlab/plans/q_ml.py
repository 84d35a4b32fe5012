"""Registered queries: Spark ML fits and scoring (ops 103-109).

Fitted models are not bit-comparable across libraries, so a query returns each scored
row's id and label with what can be checked: that the prediction is a probability (or a
length of stay that is not negative), that the fitted model and its exported SQL expression give the
row the same value, that the model's training loss is below the best constant's and, over all rows, that it beats chance.
``tests/test_models.py`` evaluates the exported expressions in DuckDB on every row."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab.functions.exprs import with_global
from cohortlab.operators import metrics, ml, panel, splits
from cohortlab.plans.common import PANEL_FEATURES, build_panel, panel_splits
from cohortlab.plans import sqlparts as S
from cohortlab.plans.registry import oracle, register
from cohortlab.session import materialize
from cohortlab.sources.tables import fixture


def _last_visit_table(spark, sf):
    p = build_panel(spark, sf)
    lv = panel.last_visit(p, "id", "record_date", PANEL_FEATURES + ["sex"])
    lab = fixture(spark, sf, "f_patients").select("id", "outcome")
    sp = panel_splits(spark, sf).select("id", "split")
    return lv.join(lab, "id").join(sp, "id")


_TREE_FEATURES = ["sex"] + PANEL_FEATURES


_PANEL = dict(fixtures=("f_patients", "f_visits"), ctes=tuple(S.panel_split_ctes()))


def _panel_oracle(cols: str, where: str = "") -> str:
    return oracle(f"SELECT p.id, CAST(p.label AS DOUBLE) AS label, {cols} FROM psplit p {where}", **_PANEL)


def _checked(scores):
    """id, label, and whether the prediction is a probability; of the whole table: better than chance."""
    scores = materialize(scores)
    auc = metrics.binary_metrics(scores.withColumn("run", F.lit(1)), ["run"]).select((F.col("auroc") > 0.5).alias("better"))
    return with_global(scores.select("id", "label", F.col("pred").between(0, 1).alias("valid")), auc)


def _against_model(model, features, rows, label, task):
    """Scores by the exported expression; ``same``: the fitted model gives each row that value."""
    own = ml.batch_score(model, rows, "id", label, task).select("id", F.col("pred").alias("model_pred"))
    out = ml.score_by_expression(model, features, rows, "id", label).join(own, "id")
    return out.select("id", "label", "pred", (F.abs(F.col("pred") - F.col("model_pred")) <= 1e-9).alias("same"))


def _learnt(model, train, label, task="mortality"):
    """One row: is the loss on the training rows below the best constant's (or as low where that has none)?"""
    loss = ml.loss_against_constant(ml.batch_score(model, train, "id", label, task), task)
    return loss.select(((F.col("loss") < F.col("constant")) | (F.col("constant") < 1e-9)).alias("learnt"))


def _tree(kind):
    def q(spark, sf):
        t = materialize(_last_visit_table(spark, sf))
        train = t.where(F.col("split") == "train")
        model = ml.fit_tree_model(train, _TREE_FEATURES, "outcome", kind)
        out = _against_model(model, _TREE_FEATURES, t.where(F.col("split") == "val"), "outcome", "mortality")
        return with_global(out.select("id", "label", F.col("pred").between(0, 1).alias("valid"), "same"),
                           _learnt(model, train, "outcome"))
    return q


_VAL = _panel_oracle("true AS valid, true AS same, true AS learnt", "WHERE split = 'val'")
register("fit_decision_tree", _VAL)(_tree("dt"))
register("fit_random_forest", _VAL)(_tree("rf"))
register("fit_gbt", _VAL)(_tree("gbt"))


def _regressor(kind):
    def q(spark, sf):
        """Days between first and last visit, from the last visit's values."""
        v = fixture(spark, sf, "f_visits").groupBy("id").agg(F.datediff(F.max("record_date"), F.min("record_date")).cast("double").alias("los"))
        t = materialize(_last_visit_table(spark, sf).join(v, "id"))
        train = t.where(F.col("split") == "train")
        model = ml.fit_tree_model(train, _TREE_FEATURES, "los", kind, task="los")
        s = _against_model(model, _TREE_FEATURES, t.where(F.col("split") == "val"), "los", "los")
        return with_global(s.select("id", "label", (F.col("pred") >= 0).alias("valid"), "same"), _learnt(model, train, "los", "los"))
    return q


_LOS_VAL = oracle("SELECT p.id, CAST(datediff('day', MIN(v.record_date), MAX(v.record_date)) AS DOUBLE) AS label, true AS valid, true AS same, true AS learnt "
                  "FROM psplit p JOIN f_visits v ON v.id = p.id WHERE p.split = 'val' GROUP BY p.id", **_PANEL)
register("fit_los_decision_tree", _LOS_VAL)(_regressor("dt"))
register("fit_los_random_forest", _LOS_VAL)(_regressor("rf"))
register("fit_los_gbt", _LOS_VAL)(_regressor("gbt"))


@register("batch_score", _panel_oracle("true AS valid, true AS same, true AS better"))
def q_batch_score(spark, sf):
    t = materialize(_last_visit_table(spark, sf))
    model = ml.fit_tree_model(t.where(F.col("split") == "train"), _TREE_FEATURES, "outcome", "dt")
    scores = materialize(_against_model(model, _TREE_FEATURES, t, "outcome", "mortality"))
    return _checked(scores).join(scores.select("id", "same"), "id")


@register("full_vs_few", oracle("SELECT s.shot, p.id, CAST(p.label AS DOUBLE) AS label, true AS valid, true AS measured "
                                "FROM psplit p, (VALUES ('full'), ('few')) s(shot) WHERE p.split = 'val'", **_PANEL))
def q_full_vs_few(spark, sf):
    t = _last_visit_table(spark, sf)
    few_ids = splits.few_shot(panel_splits(spark, sf).where(F.col("split") != "test"), 5)
    outs = []
    for shot, train in (("full", t.where(F.col("split") == "train")),
                        ("few", t.join(few_ids.where(F.col("split") == "train").select("id"), "id", "left_semi"))):
        model = ml.fit_tree_model(train, _TREE_FEATURES, "outcome", "dt")
        s = ml.batch_score(model, t.where(F.col("split") == "val"), "id", "outcome").withColumn("shot", F.lit(shot))
        outs.append(s)
    scores = outs[0].unionByName(outs[1])
    scores = materialize(scores)
    m = metrics.binary_metrics(scores, ["shot"]).select("shot", (F.col("auroc").between(0, 1) & F.col("auprc").between(0, 1)).alias("measured"))
    return scores.join(m, "shot").select("shot", "id", "label", F.col("pred").between(0, 1).alias("valid"), "measured")


def _emb_split(spark, sf):
    e = fixture(spark, sf, "f_embeddings").withColumn("label", (F.col("cluster") >= 5).cast("int"))
    sp = splits.stratified_fraction(e.select("id", "label"), 1 / 8, salt="mlp").select("id", "split")
    return e.join(sp, "id")


@register("fit_mlp_on_embeddings", oracle(
    "SELECT id, CAST(label AS DOUBLE) AS label, true AS valid FROM ms WHERE v", ("f_embeddings",), ctes=tuple(
        [("me", "SELECT id, CAST(cluster >= 5 AS INT) AS label FROM f_embeddings")] + S.strat_ctes("me", "ms", "CEIL(n_all * 0.125)", "mlp", "v"))))
def q_fit_mlp(spark, sf):
    e = _emb_split(spark, sf)
    train, val = e.where(F.col("split") == "train"), e.where(F.col("split") == "val")
    model, _ = ml.fit_mlp_on_validation(train, val, "id", ["embedding"], "label")
    return _checked(ml.batch_score(model, val, "id", "label", vec_cols=["embedding"])).drop("better")


@register("fit_fused_mlp", oracle(
    "SELECT id, CAST(label AS DOUBLE) AS label, true AS valid FROM fs WHERE v", ("f_pairs",), ctes=tuple(
        [("fe", "SELECT id, CAST(score >= 2 AS INT) AS label FROM f_pairs")] + S.strat_ctes("fe", "fs", "CEIL(n_all * 0.125)", "fused", "v"))))
def q_fit_fused(spark, sf):
    p = fixture(spark, sf, "f_pairs").withColumn("label", (F.col("score") >= 2).cast("int"))
    sp = splits.stratified_fraction(p.select("id", "label"), 1 / 8, salt="fused").select("id", "split")
    d = p.join(sp, "id")
    train, val = d.where(F.col("split") == "train"), d.where(F.col("split") == "val")
    model, _ = ml.fit_mlp_on_validation(train, val, "id", ["e1", "e2"], "label")
    return _checked(ml.batch_score(model, val, "id", "label", vec_cols=["e1", "e2"])).drop("better")
