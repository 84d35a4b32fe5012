"""Family F: evaluation metrics as grouped aggregates over a long prediction table.

Every metric takes ``run_cols`` (the experiment key), so one query scores the
whole grid. Threshold tests are strict (> 0.5); division by zero gives 0.

Curve metrics (AUROC, AP, minPSE) share one cumulative table, built from the
distinct scores of each run with ``ordered_cumsum`` (no run-wide sort).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.exprs import join_null_safe, safe_div, with_global
from cohortlab.functions.ordered import ordered_cumsum
from cohortlab.session import materialize, write_once

CURVE_BUCKETS = 4096
LOG_CLAMP = -100.0


def confusion_metrics(df: DataFrame, run_cols: list[str], score: str = "pred", label: str = "label",
                      threshold: float = 0.5, weight: str | None = None) -> DataFrame:
    """Op 70: accuracy, precision, recall, F1 at ``score > threshold``."""
    w = F.col(weight) if weight else F.lit(1)
    p = (F.col(score) > threshold)
    y = (F.col(label) == 1)
    s = df.groupBy(*run_cols).agg(
        F.sum(w).alias("n"),
        F.sum(F.when(p & y, w).otherwise(0)).alias("tp"),
        F.sum(F.when(p & ~y, w).otherwise(0)).alias("fp"),
        F.sum(F.when(~p & y, w).otherwise(0)).alias("fn"),
        F.sum(F.when(~p & ~y, w).otherwise(0)).alias("tn"))
    return s.select(
        *run_cols,
        safe_div(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"),
        safe_div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        safe_div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        safe_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def score_table(df: DataFrame, run_cols: list[str], score: str = "pred", label: str = "label",
                weight: str | None = None) -> DataFrame:
    """(run, threshold, pos, neg): weighted label counts per distinct score.

    Every binary metric is a function of this table, which is as small as the
    number of distinct scores per run and is built with map-side partial
    aggregation."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y = F.col(label).cast("double")
    return df.where(F.col(score).isNotNull()).groupBy(*run_cols, F.col(score).cast("double").alias("threshold")).agg(
        F.sum(w * y).alias("pos"), F.sum(w * (1 - y)).alias("neg"))


def curve_from_table(agg: DataFrame, run_cols: list[str], buckets: int = CURVE_BUCKETS) -> DataFrame:
    tot = agg.groupBy(*run_cols).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    c = ordered_cumsum(agg, run_cols, "threshold", ["pos", "neg"], descending=True, buckets=buckets)
    c = c.withColumnRenamed("pos_cum", "tp").withColumnRenamed("neg_cum", "fp")
    c = c.join(tot, run_cols) if run_cols else with_global(c, tot)
    return c.select(*run_cols, "threshold", "pos", "neg", "tp", "fp", "P", "N",
                    safe_div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                    safe_div(F.col("tp"), F.col("P")).alias("recall"))


def pr_curve(df: DataFrame, run_cols: list[str], score: str = "pred", label: str = "label",
             weight: str | None = None, buckets: int = CURVE_BUCKETS) -> DataFrame:
    """Op 74: per run and distinct score (descending), cumulative tp/fp,
    precision and recall at threshold ``score >= s``.

    Output: run_cols, threshold, pos, neg, tp, fp, P, N, precision, recall.
    """
    return curve_from_table(score_table(df, run_cols, score, label, weight), run_cols, buckets)


def roc_points(curve: DataFrame, run_cols: list[str]) -> DataFrame:
    """Op 74 (ROC view of the same table): true- and false-positive rate per threshold."""
    return curve.select(*run_cols, "threshold", safe_div(F.col("tp"), F.col("P")).alias("tpr"),
                        safe_div(F.col("fp"), F.col("N")).alias("fpr"))


def confusion_from_table(agg: DataFrame, run_cols: list[str], threshold: float = 0.5) -> DataFrame:
    p = F.col("threshold") > threshold
    s = agg.groupBy(*run_cols).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("_all"),
        F.sum(F.when(p, F.col("pos")).otherwise(0.0)).alias("_tp"),
        F.sum(F.when(p, F.col("neg")).otherwise(0.0)).alias("_fp"),
        F.sum(F.when(~p, F.col("pos")).otherwise(0.0)).alias("_fn"),
        F.sum(F.when(~p, F.col("neg")).otherwise(0.0)).alias("_tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("_tp", "_fp", "_fn", "_tn"))
    return s.select(
        *run_cols,
        safe_div(tp + tn, F.col("_all")).alias("accuracy"),
        safe_div(tp, tp + fp).alias("precision"),
        safe_div(tp, tp + fn).alias("recall"),
        safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def curve_metrics(curve: DataFrame, run_cols: list[str]) -> DataFrame:
    """Ops 71-73 from the shared curve: exact AUROC (ties count 1/2), average
    precision (step sum, no interpolation) and minPSE = max min(precision, recall)."""
    return curve.groupBy(*run_cols).agg(
        safe_div(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2)),
                 F.first("P") * F.first("N")).alias("auroc"),
        safe_div(F.sum(F.col("pos") * F.col("precision")), F.first("P")).alias("auprc"),
        F.max(F.least("precision", "recall")).alias("minpse"))


def binary_metrics(df: DataFrame, run_cols: list[str], score: str = "pred", label: str = "label",
                   weight: str | None = None, table: DataFrame | None = None) -> DataFrame:
    """auroc, auprc, minpse, f1, accuracy, precision, recall per run, all from
    one score table (pass ``table`` to reuse a materialised one)."""
    # read twice: the curve and the confusion counts
    t = table if table is not None else materialize(score_table(df, run_cols, score, label, weight))
    c = curve_metrics(curve_from_table(t, run_cols), run_cols)
    m = confusion_from_table(t, run_cols)
    return c.join(m, run_cols) if run_cols else with_global(c, m)


def regression_metrics(df: DataFrame, run_cols: list[str], pred: str = "pred", label: str = "label") -> DataFrame:
    """Op 75: MAE, MSE, RMSE, R^2 = 1 - SS_res / SS_tot (one pass). Of constant labels R^2 is 1
    if every prediction is right, else 0."""
    e = F.col(pred) - F.col(label)
    s = df.groupBy(*run_cols).agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
                                  F.sum(e * e).alias("_ssr"),
                                  (F.var_pop(F.col(label)) * F.count(F.lit(1))).alias("_sst"))
    return s.select(*run_cols, "mae", "mse", F.sqrt("mse").alias("rmse"),
                    F.when(F.col("_sst") > 0, 1.0 - F.col("_ssr") / F.col("_sst"))
                    .when(F.col("_ssr") > 0, 0.0).when(F.col("_ssr") == 0, 1.0).alias("r2"))


def multiclass_metrics(df: DataFrame, run_cols: list[str], scores: str = "scores", label: str = "label") -> DataFrame:
    """Op 76: argmax (first maximum) vs label: accuracy, macro/micro F1, macro
    precision/recall. Classes absent from both predictions and labels are ignored."""
    d = df.withColumn("_p", F.array_position(F.col(scores), F.array_max(F.col(scores))) - 1) \
          .withColumn("_y", F.col(label).cast("long"))
    ev = d.select(*run_cols, F.explode(F.array(
        F.struct(F.col("_p").alias("cls"), (F.col("_p") == F.col("_y")).cast("int").alias("tp"),
                 (F.col("_p") != F.col("_y")).cast("int").alias("fp"), F.lit(0).alias("fn")),
        F.struct(F.col("_y").alias("cls"), F.lit(0).alias("tp"), F.lit(0).alias("fp"),
                 (F.col("_p") != F.col("_y")).cast("int").alias("fn")))).alias("e")).select(*run_cols, "e.*")
    pc = ev.groupBy(*run_cols, "cls").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    pc = pc.where(F.col("tp") + F.col("fp") + F.col("fn") > 0)
    macro = pc.groupBy(*run_cols).agg(
        F.avg(safe_div(F.col("tp"), F.col("tp") + F.col("fp"))).alias("precision_macro"),
        F.avg(safe_div(F.col("tp"), F.col("tp") + F.col("fn"))).alias("recall_macro"),
        F.avg(safe_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1_macro"))
    acc = d.groupBy(*run_cols).agg(F.avg((F.col("_p") == F.col("_y")).cast("double")).alias("accuracy"))
    out = acc.join(macro, run_cols) if run_cols else with_global(acc, macro)
    return out.withColumn("f1_micro", F.col("accuracy"))


def log_loss_mse(df: DataFrame, run_cols: list[str], pred: str = "pred", label: str = "label",
                 task: str = "binary", alpha: float = 1.0) -> DataFrame:
    """Op 81: binary cross-entropy (log clamped at -100), MSE, and their sum
    weighted by ``alpha`` for the multitask loss column."""
    p, y = F.col(pred).cast("double"), F.col(label).cast("double")

    def clamped_log(x):
        return F.when(x <= 0, F.lit(LOG_CLAMP)).otherwise(F.greatest(F.ln(x), F.lit(LOG_CLAMP)))
    bce = -(y * clamped_log(p) + (1 - y) * clamped_log(1 - p))
    s = df.groupBy(*run_cols).agg(F.avg(bce).alias("bce"), F.avg((p - y) * (p - y)).alias("mse"))
    return s.withColumn("loss", F.col("bce") + F.lit(alpha) * F.col("mse"))


def reverse_scale(col, mean, std):
    return col * std + mean


# ---------------------------------------------------------------- bootstrap

def poisson_thresholds(max_k: int = 16) -> list[int]:
    """32-bit cut points of the Poisson(1) CDF: weight = #cuts <= h for uniform h."""
    cuts, cdf, term = [], 0.0, math.exp(-1.0)
    for k in range(max_k + 1):
        cdf += term
        term /= (k + 1)
        t = math.floor(cdf * 2 ** 32)
        if t >= 2 ** 32:
            break
        cuts.append(t)
    return cuts


def poisson_weight(h) -> F.Column:
    """Number of cut points up to ``h``, 8 lower-case hex digits: these sort as their numbers do, and most end at the first or second cut."""
    cuts = [f"{t:08x}" for t in poisson_thresholds()]
    w = F.when(h < F.lit(cuts[0]), 0)
    for k, t in enumerate(cuts[1:], 1):
        w = w.when(h < F.lit(t), k)
    return w.when(h.isNotNull(), len(cuts))


def _digits(id_col: str, b, seed: int) -> F.Column:
    return F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), b.cast("string"), F.col(id_col).cast("string"))), 1, 8)


def weight_vector(id_col: str, resamples: int = 100, seed: int = 42) -> F.Column:
    """Multiplicities of a row in the original sample (place 0: 1) and in resamples 1..B: Poisson(1), hash-seeded by id.

    No row index or join is needed, so resamples of any size are built where the row is.
    """
    drawn = F.transform(F.sequence(F.lit(1), F.lit(resamples)), lambda b: _digits(id_col, b, seed))
    return F.concat(F.array(F.lit(1)), F.transform(drawn, poisson_weight))


def bootstrap_weights(df: DataFrame, id_col: str, resamples: int = 100, seed: int = 42) -> DataFrame:
    """The resamples as rows: ``b`` and ``w`` for each resample that drew the row."""
    drawn = df.withColumn("_w", weight_vector(id_col, resamples, seed))
    one = drawn.select("*", F.posexplode("_w").alias("b", "w")).where((F.col("b") > 0) & (F.col("w") > 0))
    return one.drop("_w")


ROWS_PER_TASK = 25_000  # of a bootstrap: every row is hashed once per resample


def _spread(base: DataFrame) -> DataFrame:
    """The rows, written once, in as many tasks as their weights are worth: these cost more than the rows' size tells."""
    base = write_once(base, "bootstrap-rows")
    tasks = max(base.sparkSession.sparkContext.defaultParallelism, math.ceil(base.count() / ROWS_PER_TASK))
    return base.repartition(tasks)


def bootstrap_ci(df: DataFrame, run_cols: list[str], id_col: str = "id", score: str = "pred",
                 label: str = "label", resamples: int = 100, seed: int = 42,
                 metrics: tuple[str, ...] = ("auroc", "auprc", "minpse", "accuracy", "f1")) -> DataFrame:
    """Op 78: per run and metric: point estimate, bootstrap mean, population std
    and the 2.5 / 97.5 linear percentiles. Single-class resamples are skipped.

    Each row carries its vector of weights; one aggregate turns the rows into one per (run,
    distinct score) that holds the weight sums of every resample and class, so what is combined
    map-side and shuffled has as many rows for 1,000 resamples as for one. That table is written once; the running
    sums along the score are taken for all resamples together, and every
    metric of a resample is an aggregate over the unfolded vectors, combined before the shuffle.
    """
    y = F.col(label).cast("double")
    base = _spread(df.select(*run_cols, id_col, score, label).where(F.col(score).isNotNull()))
    rows = base.select(*run_cols, F.col(score).cast("double").alias("threshold"), y.alias("_y"),
                       weight_vector(id_col, resamples, seed).alias("_w"))
    every = range(resamples + 1)
    pos, neg = [f"_p{b}" for b in every], [f"_n{b}" for b in every]
    sums = rows.groupBy(*run_cols, "threshold").agg(
        *[F.sum(F.col("_w")[b] * F.col("_y")).alias(pos[b]) for b in every],
        *[F.sum(F.col("_w")[b] * (1 - F.col("_y"))).alias(neg[b]) for b in every])
    table = materialize(sums)
    curve = ordered_cumsum(table, run_cols, "threshold", pos + neg, descending=True)
    total = table.groupBy(*run_cols).agg(F.array(*[F.sum(p) for p in pos]).alias("_P"), F.array(*[F.sum(n) for n in neg]).alias("_N"))
    vectors = join_null_safe(curve.select(*run_cols, "threshold", *[
        F.array(*names).alias(out) for out, names in (("pos", pos), ("neg", neg), ("tp", [f"{p}_cum" for p in pos]), ("fp", [f"{n}_cum" for n in neg]))]),
        total, run_cols)
    one = vectors.select(*run_cols, "threshold", F.inline(F.arrays_zip(
        F.sequence(F.lit(0), F.lit(resamples)).alias("b"), "pos", "neg", "tp", "fp", F.col("_P").alias("P"), F.col("_N").alias("N"))))
    precision, recall = safe_div(F.col("tp"), F.col("tp") + F.col("fp")), safe_div(F.col("tp"), F.col("P"))
    above, below = F.col("threshold") > 0.5, F.col("threshold") <= 0.5
    s = one.groupBy(*run_cols, "b").agg(
        safe_div(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2)), F.first("P") * F.first("N")).alias("auroc"),
        safe_div(F.sum(F.col("pos") * precision), F.first("P")).alias("auprc"),
        F.max(F.least(precision, recall)).alias("minpse"), F.first("P").alias("_p"), F.first("N").alias("_n"),
        F.sum(F.when(above, F.col("pos")).otherwise(0.0)).alias("_tp"), F.sum(F.when(above, F.col("neg")).otherwise(0.0)).alias("_fp"),
        F.sum(F.when(below, F.col("pos")).otherwise(0.0)).alias("_fn"), F.sum(F.when(below, F.col("neg")).otherwise(0.0)).alias("_tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("_tp", "_fp", "_fn", "_tn"))
    per = materialize(s.select(
        *run_cols, "b", "auroc", "auprc", "minpse", safe_div(tp + tn, tp + fp + fn + tn).alias("accuracy"), safe_div(tp, tp + fp).alias("precision"),
        safe_div(tp, tp + fn).alias("recall"), safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ((F.col("_p") > 0) & (F.col("_n") > 0)).alias("both")))
    arr = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])
    return _intervals(per.where("b = 0").select(*run_cols, F.inline(arr)), per.where("b > 0 AND both").select(*run_cols, "b", F.inline(arr)), run_cols)


def _intervals(point: DataFrame, per: DataFrame, run_cols: list[str]) -> DataFrame:
    """Point estimates ``(metric, v)`` with the spread of the resamples' ``(b, metric, v)``."""
    ci = per.groupBy(*run_cols, "metric").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"),
        F.percentile("v", F.lit(0.025)).alias("lo"), F.percentile("v", F.lit(0.975)).alias("hi"),
        F.count(F.lit(1)).alias("n_resamples"))
    return join_null_safe(point.withColumnRenamed("v", "point"), ci, run_cols + ["metric"])


def bootstrap_regression_ci(df: DataFrame, run_cols: list[str], id_col: str = "id", pred: str = "pred", label: str = "label",
                            resamples: int = 100, seed: int = 42) -> DataFrame:
    """Op 78 for lengths of stay: MAE, MSE, RMSE and R^2 with the same resamples.

    Every metric follows from weighted sums of five terms of a row, so the rows become one per run and resample,
    summed where they are: a row's copies are never written or sent. Sums of squares are taken about the run's mean label.
    """
    base = _spread(df.select(*run_cols, F.col(id_col).alias("_id"), F.col(pred).cast("double").alias("_q"), F.col(label).cast("double").alias("_y")))
    centre = base.groupBy(*run_cols).agg(F.avg("_y").alias("_c"))
    e, y = F.col("_q") - F.col("_y"), F.col("_y") - F.col("_c")
    terms = {"n": F.lit(1.0), "a": F.abs(e), "ssr": e * e, "y1": y, "y2": y * y}
    rows = join_null_safe(base, centre, run_cols).select(*run_cols, "_id", "_y", *[t.alias(f"_{k}") for k, t in terms.items()])
    drawn = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(resamples))).alias("b"))
    drawn = drawn.select("*", _digits("_id", F.col("b"), seed).alias("_h"))
    weighed = drawn.select("*", F.when(F.col("b") == 0, 1).otherwise(poisson_weight(F.col("_h"))).alias("_w"))
    s = materialize(weighed.groupBy(*run_cols, "b").agg(
        *[F.sum(F.col("_w") * F.col(f"_{k}")).alias(k) for k in terms],
        *[agg(F.when(F.col("_w") > 0, F.col("_y"))).alias(k) for k, agg in (("lo", F.min), ("hi", F.max))]).where("n > 0"))
    sst = F.col("y2") - F.col("y1") * F.col("y1") / F.col("n")
    r2 = F.when(F.col("lo") < F.col("hi"), 1.0 - F.col("ssr") / sst).when(F.col("ssr") > 0, 0.0).otherwise(1.0)
    arr = F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("v")) for m, v in (
        ("mae", F.col("a") / F.col("n")), ("mse", F.col("ssr") / F.col("n")), ("rmse", F.sqrt(F.col("ssr") / F.col("n"))), ("r2", r2))])
    every = s.select(*run_cols, "b", F.inline(arr))
    return _intervals(every.where("b = 0").drop("b"), every.where("b > 0"), run_cols)


def format_mean_std(df: DataFrame, mean: str, std: str, scale100: bool, out: str = "formatted") -> DataFrame:
    """Op 79: 'xx.xx±yy.yy' (x100 for binary tasks)."""
    k = 100.0 if scale100 else 1.0
    return df.withColumn(out, F.format_string("%.2f±%.2f", F.col(mean) * k, F.col(std) * k))


def select_best(df: DataFrame, group_cols: list[str], score: str, order_col: str,
                higher_is_better: bool = True) -> DataFrame:
    """Op 80: best row per group; strict improvement, so the earliest
    (smallest ``order_col``) wins ties."""
    s = F.col(score).desc() if higher_is_better else F.col(score).asc()
    w = Window.partitionBy(*group_cols).orderBy(s, F.col(order_col).asc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
