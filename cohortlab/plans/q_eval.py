"""Registered queries: evaluation, fairness, failure rates (ops 51, 56, 70-88)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab.operators import fairness, metrics, prompts
from cohortlab.plans import sqlparts as S
from cohortlab.plans.common import admissions_los
from cohortlab.plans.registry import oracle, register
from cohortlab.sources.tables import fixture, read_table

# ---------------------------------------------------------------- shared SQL

_CONF_SQL = """
SELECT model, CAST(tp + tn AS DOUBLE) / n AS accuracy,
       COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 0) AS precision,
       COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0) AS recall,
       COALESCE(CAST(2 * tp AS DOUBLE) / NULLIF(2 * tp + fp + fn, 0), 0) AS f1
FROM (SELECT model, COUNT(*) AS n,
             SUM(CASE WHEN pred > 0.5 AND label = 1 THEN 1 ELSE 0 END) AS tp,
             SUM(CASE WHEN pred > 0.5 AND label <> 1 THEN 1 ELSE 0 END) AS fp,
             SUM(CASE WHEN pred <= 0.5 AND label = 1 THEN 1 ELSE 0 END) AS fn,
             SUM(CASE WHEN pred <= 0.5 AND label <> 1 THEN 1 ELSE 0 END) AS tn
      FROM {src} GROUP BY model)"""


def curve_ctes(src: str, run: str = "model", w: str = "1", out: str = "cur") -> list[tuple[str, str]]:
    return [
        (f"{out}_a", f"SELECT {run}, CAST(pred AS DOUBLE) AS threshold, SUM({w} * label)::DOUBLE AS pos, "
                     f"SUM({w} * (1 - label))::DOUBLE AS neg FROM {src} GROUP BY {run}, CAST(pred AS DOUBLE)"),
        (out, f"SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER (PARTITION BY {run}) AS P, "
              f"SUM(neg) OVER (PARTITION BY {run}) AS N FROM {out}_a "
              f"WINDOW w AS (PARTITION BY {run} ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"),
        (f"{out}_m", f"SELECT {run}, COALESCE(SUM(neg * (tp - pos + pos / 2)) / NULLIF(MAX(P) * MAX(N), 0), 0) AS auroc, "
                     f"COALESCE(SUM(pos * COALESCE(tp / NULLIF(tp + fp, 0), 0)) / NULLIF(MAX(P), 0), 0) AS auprc, "
                     f"MAX(LEAST(COALESCE(tp / NULLIF(tp + fp, 0), 0), COALESCE(tp / NULLIF(P, 0), 0))) AS minpse "
                     f"FROM {out} GROUP BY {run}"),
    ]


def _preds(spark, sf):
    return fixture(spark, sf, "f_preds")

# ---------------------------------------------------------------- binary metrics


@register("confusion_metrics", oracle(_CONF_SQL.format(src="f_preds"), ("f_preds",),
                                      dbl=("accuracy", "precision", "recall", "f1")))
def q_confusion(spark, sf):
    return metrics.confusion_metrics(_preds(spark, sf), ["model"])


@register("pr_curve", oracle(
    "SELECT model, threshold, pos, neg, tp, fp, P, N, COALESCE(tp / NULLIF(tp + fp, 0), 0) AS precision, "
    "COALESCE(tp / NULLIF(P, 0), 0) AS recall FROM cur", ("f_preds",), ctes=tuple(curve_ctes("f_preds")),
    dbl=("threshold", "pos", "neg", "tp", "fp", "P", "N", "precision", "recall")))
def q_pr_curve(spark, sf):
    return metrics.pr_curve(_preds(spark, sf), ["model"])


@register("roc_points", oracle(
    "SELECT model, threshold, COALESCE(tp / NULLIF(P, 0), 0) AS tpr, COALESCE(fp / NULLIF(N, 0), 0) AS fpr FROM cur",
    ("f_preds",), ctes=tuple(curve_ctes("f_preds")), dbl=("threshold", "tpr", "fpr")))
def q_roc_points(spark, sf):
    return metrics.roc_points(metrics.pr_curve(_preds(spark, sf), ["model"]), ["model"])


for _m in ("auroc", "auprc", "minpse"):
    def _mk(m):
        @register(m, oracle(f"SELECT model, {m} FROM cur_m", ("f_preds",), ctes=tuple(curve_ctes("f_preds")),
                            dbl=(m,)))
        def q(spark, sf):
            c = metrics.pr_curve(_preds(spark, sf), ["model"])
            return metrics.curve_metrics(c, ["model"]).select("model", m)
        return q
    _mk(_m)


_REG_SRC = ("reg", "SELECT CAST(outcome AS INT) AS run, CAST(GREATEST(datediff('day', record_date, discharge_date), 0) "
                   "AS DOUBLE) AS label, lab_quantity / 5 AS pred FROM f_admissions")
_REG_SQL = ("SELECT run, AVG(ABS(pred - label)) AS mae, AVG((pred - label) * (pred - label)) AS mse, "
            "SQRT(AVG((pred - label) * (pred - label))) AS rmse, "
            "CASE WHEN MIN(label) < MAX(label) THEN 1 - SUM(power(pred - label, 2)) / (SUM(label * label) - SUM(label) * SUM(label) / COUNT(*)) "
            "WHEN MAX(ABS(pred - label)) = 0 THEN 1.0 ELSE 0.0 END AS r2 "
            "FROM reg GROUP BY run")


def _reg_frame(spark, sf):
    a = admissions_los(spark, sf)
    return a.select(F.col("outcome").cast("int").alias("run"), F.col("los").cast("double").alias("label"),
                    (F.col("lab_quantity") / 5).alias("pred"))


@register("regression_metrics", oracle(_REG_SQL, ("f_admissions",), ctes=(_REG_SRC,),
                                       dbl=("mae", "mse", "rmse", "r2")))
def q_regression(spark, sf):
    return metrics.regression_metrics(_reg_frame(spark, sf), ["run"])


@register("multiclass_metrics", oracle(
    "WITH p AS (SELECT list_position(scores, list_max(scores)) - 1 AS pc, CAST(label AS BIGINT) AS y FROM f_scores), "
    "ev AS (SELECT pc AS cls, CAST(pc = y AS INT) AS tp, CAST(pc <> y AS INT) AS fp, 0 AS fn FROM p "
    "UNION ALL SELECT y, 0, 0, CAST(pc <> y AS INT) FROM p), "
    "pc AS (SELECT cls, SUM(tp) AS tp, SUM(fp) AS fp, SUM(fn) AS fn FROM ev GROUP BY cls HAVING SUM(tp)+SUM(fp)+SUM(fn) > 0) "
    "SELECT (SELECT AVG(CAST(pc = y AS DOUBLE)) FROM p) AS accuracy, "
    "AVG(COALESCE(tp / NULLIF(tp + fp, 0), 0)) AS precision_macro, AVG(COALESCE(tp / NULLIF(tp + fn, 0), 0)) AS recall_macro, "
    "AVG(COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0)) AS f1_macro, "
    "(SELECT AVG(CAST(pc = y AS DOUBLE)) FROM p) AS f1_micro FROM pc", ("f_scores",),
    dbl=("accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_micro")))
def q_multiclass(spark, sf):
    return metrics.multiclass_metrics(fixture(spark, sf, "f_scores"), [])


_MT_SRC = ("mt", "SELECT outcome AS label, LEAST(CAST(1 AS DOUBLE), lab_quantity / 50) AS pred, "
                 "CAST(GREATEST(datediff('day', record_date, discharge_date), 0) AS DOUBLE) AS los, "
                 "lab_quantity / 5 AS los_pred, 'all' AS model FROM f_admissions")


@register("multitask_metrics", oracle(
    "SELECT c.model, auroc, auprc, minpse, f1, accuracy, mae, mse, rmse, r2 FROM cur_m c JOIN ("
    + _CONF_SQL.format(src="mt") + ") k ON k.model = c.model JOIN ("
    "SELECT model, AVG(ABS(los_pred - los)) AS mae, AVG((los_pred - los) * (los_pred - los)) AS mse, "
    "SQRT(AVG((los_pred - los) * (los_pred - los))) AS rmse, "
    "CASE WHEN MIN(los) < MAX(los) THEN 1 - SUM(power(los_pred - los, 2)) / (SUM(los * los) - SUM(los) * SUM(los) / COUNT(*)) "
            "WHEN MAX(ABS(los_pred - los)) = 0 THEN 1.0 ELSE 0.0 END AS r2 "
    "FROM mt GROUP BY model) r ON r.model = c.model", ("f_admissions",), ctes=(_MT_SRC,) + tuple(curve_ctes("mt")),
    dbl=("auroc", "auprc", "minpse", "f1", "accuracy", "mae", "mse", "rmse", "r2")))
def q_multitask(spark, sf):
    a = admissions_los(spark, sf).select(
        F.lit("all").alias("model"), F.col("outcome").alias("label"),
        F.least(F.lit(1.0), F.col("lab_quantity") / 50).alias("pred"),
        F.col("los").cast("double").alias("los"), (F.col("lab_quantity") / 5).alias("los_pred"))
    b = metrics.binary_metrics(a, ["model"]).select("model", "auroc", "auprc", "minpse", "f1", "accuracy")
    r = metrics.regression_metrics(a, ["model"], "los_pred", "los")
    return b.join(r, "model")


# ---------------------------------------------------------------- bootstrap

def _bootstrap_sql() -> str:
    cuts = metrics.poisson_thresholds()
    w = " + ".join(f"CAST(h >= {t} AS INT)" for t in cuts)
    ctes = [
        ("bh", "SELECT p.*, r.b, ('0x' || substr(md5('42|' || CAST(r.b AS VARCHAR) || '|' || CAST(p.id AS VARCHAR)), 1, 8))::BIGINT AS h "
               "FROM f_preds p, (SELECT CAST(range AS INT) AS b FROM range(1, 101)) r"),
        ("bw", f"SELECT model, b, id, pred, label, ({w}) AS w FROM bh"),
        ("bw1", "SELECT * FROM bw WHERE w > 0"),
        ("bk", "SELECT model || '#' || CAST(b AS VARCHAR) AS mb, * FROM bw1"),
    ] + curve_ctes("bk", "mb", "w", "bc") + [
        ("bconf", "SELECT mb, SUM(w) AS n, SUM(CASE WHEN pred > 0.5 AND label = 1 THEN w ELSE 0 END) AS tp, "
                  "SUM(CASE WHEN pred > 0.5 AND label <> 1 THEN w ELSE 0 END) AS fp, "
                  "SUM(CASE WHEN pred <= 0.5 AND label = 1 THEN w ELSE 0 END) AS fn, "
                  "SUM(CASE WHEN pred <= 0.5 AND label <> 1 THEN w ELSE 0 END) AS tn, "
                  "SUM(w * label) AS npos, SUM(w * (1 - label)) AS nneg FROM bk GROUP BY mb"),
        ("per", "SELECT c.mb, c.auroc, c.auprc, c.minpse, CAST(tp + tn AS DOUBLE) / n AS accuracy, "
                "COALESCE(CAST(2 * tp AS DOUBLE) / NULLIF(2 * tp + fp + fn, 0), 0) AS f1 "
                "FROM bc_m c JOIN bconf k ON k.mb = c.mb WHERE npos > 0 AND nneg > 0"),
        ("perl", "SELECT split_part(mb, '#', 1) AS model, m.metric, m.v FROM per, "
                 "LATERAL (VALUES ('auroc', auroc), ('auprc', auprc), ('minpse', minpse), ('accuracy', accuracy), ('f1', f1)) m(metric, v)"),
        ("ci", "SELECT model, metric, AVG(v) AS mean, STDDEV_POP(v) AS std, quantile_cont(v, 0.025) AS lo, "
               "quantile_cont(v, 0.975) AS hi, COUNT(*) AS n_resamples FROM perl GROUP BY model, metric"),
    ] + curve_ctes("f_preds", "model", "1", "pc") + [
        ("pconf", _CONF_SQL.format(src="f_preds")),
        ("pt", "SELECT c.model, m.metric, m.v AS point FROM pc_m c JOIN pconf k ON k.model = c.model, "
               "LATERAL (VALUES ('auroc', c.auroc), ('auprc', c.auprc), ('minpse', c.minpse), ('accuracy', k.accuracy), ('f1', k.f1)) m(metric, v)"),
        ("boot", "SELECT pt.model, pt.metric, point, mean, std, lo, hi, n_resamples FROM pt JOIN ci "
                 "ON ci.model = pt.model AND ci.metric = pt.metric"),
    ]
    return ctes


_BOOT = tuple(_bootstrap_sql())


def _boot(spark, sf):
    return metrics.bootstrap_ci(_preds(spark, sf), ["model"], "id", "pred", "label", resamples=100, seed=42)


@register("bootstrap_ci", oracle("SELECT * FROM boot", ("f_preds",), ctes=_BOOT,
                                 dbl=("point", "mean", "std", "lo", "hi")))
def q_bootstrap(spark, sf):
    return _boot(spark, sf)


def _los_boot_ctes():
    """Op 78 over stays: one weighted regression per run and resample, resample 0 the sample itself."""
    w = " + ".join(f"CAST(h >= {t} AS INT)" for t in metrics.poisson_thresholds())
    return (
        ("lr", "SELECT record_id AS id, CAST(outcome AS INT) AS run, CAST(GREATEST(datediff('day', record_date, discharge_date), 0) AS DOUBLE) "
               "AS y, lab_quantity / 5 AS p FROM f_admissions"),
        ("lw", f"SELECT *, CASE WHEN b = 0 THEN 1 ELSE {w} END AS w FROM (SELECT lr.*, b, ('0x' || substr(md5('42|' || CAST(b AS VARCHAR) || "
               "'|' || CAST(id AS VARCHAR)), 1, 8))::BIGINT AS h FROM lr, (SELECT CAST(range AS INT) AS b FROM range(0, 101)))"),
        ("lm", "SELECT *, SUM(w * y) OVER (PARTITION BY run, b) / SUM(w) OVER (PARTITION BY run, b) AS mu FROM lw"),
        ("lg", "SELECT run, b, SUM(w * ABS(p - y)) / SUM(w) AS mae, SUM(w * power(p - y, 2)) / SUM(w) AS mse, "
               "SQRT(SUM(w * power(p - y, 2)) / SUM(w)) AS rmse, 1 - SUM(w * power(p - y, 2)) / SUM(w * power(y - mu, 2)) AS r2 FROM lm GROUP BY run, b"),
        ("ll", "SELECT run, b, m.metric, m.v FROM lg, LATERAL (VALUES ('mae', mae), ('mse', mse), ('rmse', rmse), ('r2', r2)) m(metric, v)"))


@register("bootstrap_los", oracle(
    "SELECT run, metric, MAX(v) FILTER (WHERE b = 0) AS point, AVG(v) FILTER (WHERE b > 0) AS mean, STDDEV_POP(v) FILTER (WHERE b > 0) AS std, "
    "quantile_cont(v, 0.025) FILTER (WHERE b > 0) AS lo, quantile_cont(v, 0.975) FILTER (WHERE b > 0) AS hi, "
    "COUNT(*) FILTER (WHERE b > 0) AS n_resamples FROM ll GROUP BY run, metric", ("f_admissions",), ctes=_los_boot_ctes(),
    dbl=("point", "mean", "std", "lo", "hi")))
def q_bootstrap_los(spark, sf):
    a = admissions_los(spark, sf).select(F.col("record_id").alias("id"), F.col("outcome").cast("int").alias("run"),
                                         F.col("los").alias("label"), (F.col("lab_quantity") / 5).alias("pred"))
    return metrics.bootstrap_regression_ci(a, ["run"], resamples=100, seed=42)


@register("format_mean_std", oracle(
    "SELECT model, metric, printf('%.2f±%.2f', mean * 100, std * 100) AS formatted FROM boot",
    ("f_preds",), ctes=_BOOT))
def q_format_mean_std(spark, sf):
    return metrics.format_mean_std(_boot(spark, sf), "mean", "std", True).select("model", "metric", "formatted")


@register("select_best", oracle(
    "SELECT model, lang, auroc FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY model ORDER BY auroc DESC, lang) AS rn "
    "FROM (SELECT split_part(ml, '#', 1) AS model, split_part(ml, '#', 2) AS lang, auroc FROM sb_m)) WHERE rn = 1",
    ("f_preds",), ctes=(("pl", "SELECT p.*, p.model || '#' || d.lang AS ml FROM f_preds p JOIN documents d ON d.doc_id = p.id"),)
    + tuple(curve_ctes("pl", "ml", "1", "sb")), dbl=("auroc",)))
def q_select_best(spark, sf):
    p = _preds(spark, sf).join(read_table(spark, sf, "documents", ["doc_id", "lang"]).withColumnRenamed("doc_id", "id"), "id")
    m = metrics.curve_metrics(metrics.pr_curve(p, ["model", "lang"]), ["model", "lang"])
    return metrics.select_best(m, ["model"], "auroc", "lang").select("model", "lang", "auroc")


@register("log_loss_mse", oracle(
    "SELECT model, bce, mse, bce + mse AS loss FROM (SELECT model, AVG(-(label * CASE WHEN pred <= 0 THEN -100 ELSE "
    "GREATEST(LN(pred), -100) END + (1 - label) * CASE WHEN 1 - pred <= 0 THEN -100 ELSE GREATEST(LN(1 - pred), -100) END)) "
    "AS bce, AVG((pred - label) * (pred - label)) AS mse FROM f_preds GROUP BY model)", ("f_preds",),
    dbl=("bce", "mse", "loss")))
def q_log_loss(spark, sf):
    return metrics.log_loss_mse(_preds(spark, sf), ["model"])

# ---------------------------------------------------------------- defaults, unknowns


_PARSED_SQL = S.PARSE_SQL  # op 66 over f_responses -> parsed(id, response, think, pred, status)
_JPD = (("parsed", _PARSED_SQL),
        ("jpd", "SELECT l.doc_id AS id, l.quality AS label, COALESCE(CAST(p.pred AS DOUBLE), 0.501) AS pred "
                "FROM labels l LEFT JOIN parsed p ON p.id = l.doc_id"))


def _jpd(spark, sf):
    ids = read_table(spark, sf, "labels", ["doc_id", "quality"]).select(F.col("doc_id").alias("id"),
                                                                         F.col("quality").alias("label"))
    parsed = prompts.parse_response(fixture(spark, sf, "f_responses"), "response")
    return fairness.join_preds_default(ids, parsed.select("id", "pred"), "id", "pred", 0.501)


@register("join_preds_default", oracle("SELECT * FROM jpd", ("f_responses",), ctes=_JPD, dbl=("pred",)))
def q_join_preds_default(spark, sf):
    return _jpd(spark, sf)


@register("known_only", oracle(
    "SELECT s.subset, COUNT(*) AS n, AVG(CAST((pred > 0.5) = (label = 1) AS DOUBLE)) AS accuracy "
    "FROM (SELECT 'all' AS subset, * FROM jpd UNION ALL SELECT 'known', * FROM jpd WHERE pred <> 0.501) s "
    "GROUP BY s.subset", ("f_responses",), ctes=_JPD, dbl=("accuracy",)))
def q_known_only(spark, sf):
    j = _jpd(spark, sf)
    both = j.withColumn("subset", F.explode(F.when(F.col("pred") != 0.501, F.array(F.lit("all"), F.lit("known")))
                                            .otherwise(F.array(F.lit("all")))))
    return both.groupBy("subset").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(((F.col("pred") > 0.5) == (F.col("label") == 1)).cast("double")).alias("accuracy"))

# ---------------------------------------------------------------- fairness


_DEMO_SQL = ("SELECT id, CAST(contains(lower(race), 'white') AS INT) AS race_attr, CAST(age > 50 AS INT) AS age_attr, "
             "CAST(gender AS INT) AS gender_attr FROM f_demographics")


@register("sensitive_attrs", oracle(_DEMO_SQL, ("f_demographics",)))
def q_sensitive_attrs(spark, sf):
    return fairness.sensitive_attrs(fixture(spark, sf, "f_demographics")).select(
        "id", "race_attr", "age_attr", "gender_attr")


def _fair_sql(src: str, run: str, attr: str) -> str:
    e = "1e-8"
    return (f"SELECT {run}, r1 / (r0 + {e}) AS DI, r1 - r0 AS SPD, tpr1 - tpr0 AS EOD, "
            f"0.5 * ((fpr1 - fpr0) + (tpr1 - tpr0)) AS AOD FROM (SELECT {run}, "
            f"pp1 / (w1 + {e}) AS r1, pp0 / (w0 + {e}) AS r0, tp1 / (tpos1 + {e}) AS tpr1, tp0 / (tpos0 + {e}) AS tpr0, "
            f"fp1 / (tneg1 + {e}) AS fpr1, fp0 / (tneg0 + {e}) AS fpr0 FROM (SELECT {run}, "
            + ", ".join(
                f"SUM(CASE WHEN {attr} = {g} THEN 1.0 ELSE 0.0 END) AS w{g}, "
                f"SUM(CASE WHEN {attr} = {g} AND pred > 0.5 THEN 1.0 ELSE 0.0 END) AS pp{g}, "
                f"SUM(CASE WHEN {attr} = {g} AND label = 1 THEN 1.0 ELSE 0.0 END) AS tpos{g}, "
                f"SUM(CASE WHEN {attr} = {g} AND label <> 1 THEN 1.0 ELSE 0.0 END) AS tneg{g}, "
                f"SUM(CASE WHEN {attr} = {g} AND pred > 0.5 AND label = 1 THEN 1.0 ELSE 0.0 END) AS tp{g}, "
                f"SUM(CASE WHEN {attr} = {g} AND pred > 0.5 AND label <> 1 THEN 1.0 ELSE 0.0 END) AS fp{g}"
                for g in (1, 0))
            + f" FROM {src} WHERE {attr} IN (0, 1) GROUP BY {run}))")


@register("fairness_metrics", oracle(_fair_sql("f_preds", "model", "attr"), ("f_preds",),
                                     dbl=("DI", "SPD", "EOD", "AOD")))
def q_fairness_metrics(spark, sf):
    return fairness.fairness_metrics(_preds(spark, sf), ["model"], "attr")


_ATTRS = {"Age": "age_attr", "Gender": "gender_attr", "Race": "race_attr"}
_FBA_CTES = (("demo", _DEMO_SQL), ("pd", "SELECT p.*, d.age_attr, d.gender_attr, d.race_attr FROM f_preds p JOIN demo d ON d.id = p.id"),
             ("pl", "SELECT model || '#' || a.attribute AS ma, p.pred, p.label, a.v AS attr_value FROM pd p, LATERAL "
                    "(VALUES ('Age', age_attr), ('Gender', gender_attr), ('Race', race_attr)) a(attribute, v)"),
             ("fm", _fair_sql("pl", "ma", "attr_value")))


@register("fairness_by_attribute", oracle(
    "SELECT split_part(ma, '#', 1) AS model, " + ", ".join(
        f"MAX({k}) FILTER (WHERE split_part(ma, '#', 2) = '{n}') AS {n}_{k}"
        for n in _ATTRS for k in fairness.FAIR_METRICS) + " FROM fm GROUP BY split_part(ma, '#', 1)",
    ("f_preds", "f_demographics"), ctes=_FBA_CTES,
    dbl=tuple(f"{n}_{k}" for n in _ATTRS for k in fairness.FAIR_METRICS)))
def q_fairness_by_attribute(spark, sf):
    demo = fairness.sensitive_attrs(fixture(spark, sf, "f_demographics")).select(
        "id", "age_attr", "gender_attr", "race_attr")
    p = _preds(spark, sf).join(demo, "id")
    return fairness.fairness_by_attribute(p, ["model"], _ATTRS)

# ---------------------------------------------------------------- failures


@register("failure_check", oracle(
    "SELECT id, pred, (pred IS NOT NULL AND NOT isnan(pred)) AS valid FROM parsed", ("f_responses",),
    ctes=(("parsed", _PARSED_SQL),), dbl=("pred",)))
def q_failure_check(spark, sf):
    parsed = prompts.parse_response(fixture(spark, sf, "f_responses"), "response")
    return fairness.failure_check(parsed.select("id", "pred"), "pred")


_LANGS = ["de", "en", "es", "fr"]
_FR_CTES = (("coh", "SELECT d.doc_id AS id, d.lang, m.model FROM documents d, (VALUES ('m0'), ('m1')) m(model)"),
            ("fr", "SELECT c.model, c.lang, COUNT(*) AS n_cohort, AVG(CASE WHEN p.pred IS NOT NULL AND NOT isnan(p.pred) "
                   "THEN 0.0 ELSE 1.0 END) AS failure_rate FROM coh c LEFT JOIN f_preds p ON p.id = c.id AND p.model = c.model "
                   "GROUP BY c.model, c.lang"))


def _failure_rates(spark, sf):
    docs = read_table(spark, sf, "documents", ["doc_id", "lang"]).select(F.col("doc_id").alias("id"), "lang")
    cohort = docs.withColumn("model", F.explode(F.array(F.lit("m0"), F.lit("m1"))))
    res = _preds(spark, sf).join(docs, "id").select("model", "lang", "id", "pred")
    return fairness.failure_rate(cohort, res, ["model", "lang"], "id", "pred")


@register("failure_rate", oracle("SELECT * FROM fr", ("f_preds",), ctes=_FR_CTES, dbl=("failure_rate",)))
def q_failure_rate(spark, sf):
    return _failure_rates(spark, sf)


@register("failure_pivot", oracle(
    "SELECT model, " + ", ".join(f"COALESCE(printf('%.2f', MAX(failure_rate) FILTER (WHERE lang = '{c}') * 100), '-') AS {c}"
                                 for c in _LANGS) + " FROM fr GROUP BY model", ("f_preds",), ctes=_FR_CTES))
def q_failure_pivot(spark, sf):
    return fairness.failure_pivot(_failure_rates(spark, sf), ["model"], "lang", _LANGS)


@register("report_runs", oracle(
    "SELECT model, lang, failure_rate, COALESCE(LAG(model) OVER (ORDER BY model, lang) <> model, TRUE) AS is_start, "
    "COUNT(*) OVER (PARTITION BY model) AS group_size FROM fr", ("f_preds",), ctes=_FR_CTES, dbl=("failure_rate",)))
def q_report_runs(spark, sf):
    r = _failure_rates(spark, sf).select("model", "lang", "failure_rate")
    return fairness.report_runs(r, "model", ["model", "lang"])
