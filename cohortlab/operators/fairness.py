"""Family G: sensitive attributes, group fairness, failure rates, report layout (ops 82-88)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.exprs import nan_to_null

FAIR_EPS = 1e-8
FAIR_METRICS = ("DI", "SPD", "EOD", "AOD")


def sensitive_attrs(df: DataFrame, race: str = "race", age: str = "age", gender: str = "gender",
                    term: str = "white", age_cut: float = 50) -> DataFrame:
    """Op 82: race contains ``term`` (case-insensitive) -> 1; age > cut -> 1; gender as is."""
    return df.withColumns({
        "race_attr": F.lower(F.col(race)).contains(term).cast("int"),
        "age_attr": (F.col(age) > age_cut).cast("int"),
        "gender_attr": F.col(gender).cast("int"),
    })


def fairness_metrics(df: DataFrame, run_cols: list[str], attr: str = "attr", pred: str = "pred",
                     label: str = "label", weight: str | None = None, threshold: float = 0.5) -> DataFrame:
    """Op 83: weighted DI, SPD, EOD, AOD between attr == 1 (protected) and attr == 0.

    Rows whose attribute is not 0/1 are ignored. One conditional-sum aggregate.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    d = df.where(F.col(attr).isin(0, 1))
    p = F.col(pred) > threshold
    y = F.col(label) == 1
    aggs = []
    for g, tag in ((1, "1"), (0, "0")):
        in_g = F.col(attr) == g
        aggs += [F.sum(F.when(in_g, w).otherwise(0.0)).alias(f"w{tag}"),
                 F.sum(F.when(in_g & p, w).otherwise(0.0)).alias(f"pp{tag}"),
                 F.sum(F.when(in_g & y, w).otherwise(0.0)).alias(f"tpos{tag}"),
                 F.sum(F.when(in_g & ~y, w).otherwise(0.0)).alias(f"tneg{tag}"),
                 F.sum(F.when(in_g & p & y, w).otherwise(0.0)).alias(f"tp{tag}"),
                 F.sum(F.when(in_g & p & ~y, w).otherwise(0.0)).alias(f"fp{tag}")]
    s = d.groupBy(*run_cols).agg(*aggs)
    e = F.lit(FAIR_EPS)
    r1, r0 = F.col("pp1") / (F.col("w1") + e), F.col("pp0") / (F.col("w0") + e)
    tpr1, tpr0 = F.col("tp1") / (F.col("tpos1") + e), F.col("tp0") / (F.col("tpos0") + e)
    fpr1, fpr0 = F.col("fp1") / (F.col("tneg1") + e), F.col("fp0") / (F.col("tneg0") + e)
    return s.select(*run_cols, (r1 / (r0 + e)).alias("DI"), (r1 - r0).alias("SPD"),
                    (tpr1 - tpr0).alias("EOD"), (0.5 * ((fpr1 - fpr0) + (tpr1 - tpr0))).alias("AOD"))


def fairness_by_attribute(df: DataFrame, run_cols: list[str], attrs: dict[str, str], pred: str = "pred",
                          label: str = "label") -> DataFrame:
    """Op 84: op 83 for several attributes, one row per run with
    ``{Attr}_{metric}`` columns (attributes unpivoted, then pivoted on a fixed list)."""
    names = list(attrs)
    long = df.select(*run_cols, pred, label, F.inline(F.array(*[
        F.struct(F.lit(n).alias("attribute"), F.col(c).alias("attr_value")) for n, c in attrs.items()])))
    m = fairness_metrics(long, run_cols + ["attribute"], "attr_value", pred, label)
    wide = m.groupBy(*run_cols).pivot("attribute", names).agg(*[F.first(k).alias(k) for k in FAIR_METRICS])
    return wide.select(*run_cols, *[F.col(f"{n}_{k}") for n in names for k in FAIR_METRICS])


def failure_check(df: DataFrame, pred: str = "pred", out: str = "valid") -> DataFrame:
    """Op 85: a result is valid iff its prediction is present and not NaN."""
    return df.withColumn(out, F.col(pred).isNotNull() & ~F.isnan(F.col(pred)))


def failure_rate(cohort: DataFrame, results: DataFrame, run_cols: list[str], id_col: str = "id",
                 pred: str = "pred") -> DataFrame:
    """Op 86: share of cohort ids per run whose result is missing or invalid.

    ``cohort`` holds (run_cols..., id); the denominator is the actual cohort size.
    """
    r = failure_check(results.select(*run_cols, id_col, pred), pred).select(*run_cols, id_col, "valid")
    j = cohort.join(r, run_cols + [id_col], "left")
    return j.groupBy(*run_cols).agg(
        F.count(F.lit(1)).alias("n_cohort"),
        F.avg((~F.coalesce(F.col("valid"), F.lit(False))).cast("double")).alias("failure_rate"))


def failure_pivot(rates: DataFrame, row_cols: list[str], col_key: str, columns: list[str],
                  value: str = "failure_rate") -> DataFrame:
    """Op 87: rows = run keys, one text column per dataset_task ('%.2f' in percent,
    '-' where the combination does not exist)."""
    wide = rates.groupBy(*row_cols).pivot(col_key, columns).agg(F.first(value))
    return wide.select(*row_cols, *[F.coalesce(F.format_string("%.2f", F.col(c) * 100), F.lit("-")).alias(c)
                                    for c in columns])


def report_runs(df: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    """Op 88: mark where a new run of equal ``key`` values starts (value differs from
    the previous row) and the size of each key's group, for table layout.

    The window is global on purpose: report tables have one row per run.
    """
    w = Window.orderBy(*order_cols)
    return (df.withColumn("is_start", F.coalesce(F.lag(key).over(w) != F.col(key), F.lit(True)))
              .withColumn("group_size", F.count(F.lit(1)).over(Window.partitionBy(key))))


def join_preds_default(ids: DataFrame, results: DataFrame, id_col: str = "id", pred: str = "pred",
                       default: float = 0.501) -> DataFrame:
    """Op 51: every cohort id gets a prediction; missing, null or NaN -> ``default``."""
    return ids.join(results.select(id_col, pred), id_col, "left").withColumn(
        pred, F.coalesce(nan_to_null(F.col(pred).cast("double")), F.lit(default)))
