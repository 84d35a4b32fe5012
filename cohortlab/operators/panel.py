"""Family B: longitudinal panel building (ops 23-33).

Statistics are computed once on the train rows as a single wide row and
broadcast (its size is fixed by the feature list, not by the data), so
normalising any split is a narrow, shuffle-free projection.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.exprs import EPS_STD, nan_to_null, safe_div, with_global
from cohortlab.functions.ordered import MAP_QUANTILE_LIMIT, exact_quantiles
from cohortlab.session import materialize, write_once

OUTLIER_LIMIT = 1e4  # |z| above this is replaced by 0
MISSING_STATS_FILL = -1.0  # default fill of a feature that has no statistics


def daily_merge(long_df: DataFrame, keys: list[str], feature_col: str, value_col: str,
                features: list[str]) -> DataFrame:
    """Op 23: mean of all measurements per key (e.g. patient x day), one column per feature.

    The pivot list is fixed, so no extra job discovers the values and the
    schema is stable. Null keys are dropped; NaN counts as missing.
    """
    d = long_df.na.drop(how="any", subset=keys).withColumn(value_col, nan_to_null(value_col))
    return d.groupBy(*keys).pivot(feature_col, features).agg(F.avg(value_col))


def category_vocabulary(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values of a categorical column (frozen over all splits)."""
    return df.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()


MAX_CATEGORIES = 10_000  # columns that a one-hot table may get


def one_hot(df: DataFrame, column: str, values: list, keep: bool = False) -> DataFrame:
    """Op 24: one 0/1 double column ``{column}->{value}`` per vocabulary value,
    placed where the categorical column was; missing -> all zeros."""
    if len(values) > MAX_CATEGORIES:
        raise ValueError(f"over {MAX_CATEGORIES} categories in {column}")
    out = []
    for f in df.columns:
        if f == column:
            out += [F.coalesce((F.col(column) == F.lit(v)).cast("double"), F.lit(0.0)).alias(f"{column}->{v}")
                    for v in sorted(values)]
            if keep:
                out.append(F.col(column))
        else:
            out.append(F.col(f"`{f}`"))
    return df.select(*out)


def missing_mask(df: DataFrame, features: list[str], name: str = "missing_mask") -> DataFrame:
    """Op 25: per row, array of 1 (missing) / 0 (present), before imputation."""
    return df.withColumn(name, F.array(*[F.isnull(c).cast("int") for c in features]))


def wide_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of every column at once; null cells don't count.

    One aggregate over all columns brackets the order statistics with approximate
    quantiles, a second one counts the cells below each bracket, and only the cells
    inside (about 10 n / accuracy a bracket) are unpivoted and ranked. Tables of at most
    MAP_QUANTILE_LIMIT rows take Spark's exact ``percentile``, also in one aggregate.
    What reaches the driver is a few numbers per column.
    """
    rows = df.count()
    p_list = [float(p) for p in probs]
    if rows <= MAP_QUANTILE_LIMIT:
        got = df.agg(*[F.percentile(c, F.array(*map(F.lit, p_list))).alias(c) for c in columns]).first()
        return {c: list(got[c]) if got[c] is not None else [None] * len(probs) for c in columns}
    accuracy = max(10_000, min(10_000_000, -(-rows // 100_000)))
    delta = 5.0 / accuracy
    ends = [max(0.0, p - delta) for p in p_list] + [min(1.0, p + delta) for p in p_list]
    found = df.agg(*[x for c in columns for x in (F.count(c).alias(f"{c}__n"), F.min(c).alias(f"{c}__0"), F.max(c).alias(f"{c}__1"),
                                                  F.percentile_approx(c, ends, accuracy).alias(f"{c}__a"))]).first()
    brackets = []  # column, probability, lower and upper end, rank
    for c in columns:
        for i, p in enumerate(p_list):
            if found[f"{c}__n"]:
                low = found[f"{c}__0"] if p - delta <= 0 else found[f"{c}__a"][i]
                high = found[f"{c}__1"] if p + delta >= 1 else found[f"{c}__a"][len(p_list) + i]
                brackets.append((c, i, low, high, (found[f"{c}__n"] - 1) * p))
    below = df.agg(*[F.sum((F.col(c) < low).cast("long")).alias(f"b{k}") for k, (c, _, low, _, _) in enumerate(brackets)]).first()
    inside = df.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.when(F.col(c).between(low, high), F.col(c)).alias("v"))
                                          for k, (c, _, low, high, _) in enumerate(brackets)]))).where("v IS NOT NULL")
    w = Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.groupBy("k", "v").agg(F.count(F.lit(1)).alias("m")).withColumn("upto", F.sum("m").over(w))
    ranks = F.create_map(*[F.lit(x) for k, b in enumerate(brackets) for x in (k, [float(math.floor(b[4]) - below[f"b{k}"]),
                                                                                  float(math.ceil(b[4]) - below[f"b{k}"])])])
    at = ranked.withColumn("r", ranks[F.col("k")]).groupBy("k").agg(
        F.min(F.when(F.col("upto") > F.col("r")[0], F.col("v"))).alias("v0"), F.min(F.when(F.col("upto") > F.col("r")[1], F.col("v"))).alias("v1"))
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns}
    for r in at.collect():  # a row for each column and probability
        c, i, _, _, rank = brackets[r.k]
        out[c][i] = r.v0 + (rank - math.floor(rank)) * (r.v1 - r.v0)
    return out


def trimmed_stats(train: DataFrame, features: list[str], lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """Ops 26-27: one wide row with ``{f}__mean/std/median/fill`` per feature.

    Per feature the exact linear quantiles ``lo``/``hi`` are taken on train cells;
    cells strictly inside are kept (cell-wise, not a row filter); mean, sample
    std and median of the kept cells; missing statistic -> 0;
    fill = (median - mean) / (std + 1e-12).

    The features' columns are written once (as they are, not unpivoted) and every
    statistic of all features is taken in one aggregate.
    """
    cells = write_once(train.select(*[nan_to_null(F.col(f"`{c}`").cast("double")).alias(f"c{i}") for i, c in enumerate(features)]), "cells")
    names = cells.columns
    q = wide_quantiles(cells, names, [lo, hi])
    kept = cells.select(*[F.when((F.col(c) > q[c][0]) & (F.col(c) < q[c][1]), F.col(c)).alias(c) if q[c][0] is not None
                          else F.lit(None).cast("double").alias(c) for c in names])
    moments = kept.agg(*[x for c in names for x in (F.avg(c).alias(f"{c}_m"), F.stddev_samp(c).alias(f"{c}_s"))]).first()
    median = wide_quantiles(kept, names, [0.5])
    row, cols = [], []
    for f, c in zip(features, names):
        m, sd, md = (0.0 if x is None or x != x else float(x) for x in (moments[f"{c}_m"], moments[f"{c}_s"], median[c][0]))
        row += [m, sd, md, (md - m) / (sd + EPS_STD)]
        cols += [f"{f}__{k}" for k in ("mean", "std", "median", "fill")]
    return train.sparkSession.createDataFrame([tuple(row)], ", ".join(f"`{c}` double" for c in cols))


def stats_long(stats: DataFrame, features: list[str]) -> DataFrame:
    """Wide stats row -> (feature, mean, std, median, default_fill)."""
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}__mean").alias("mean"),
                              F.col(f"{c}__std").alias("std"), F.col(f"{c}__median").alias("median"),
                              F.col(f"{c}__fill").alias("default_fill")) for c in features])
    return stats.select(F.inline(rows))


def zscore(df: DataFrame, stats: DataFrame, features: list[str]) -> DataFrame:
    """Op 28: (x - mean) / (std + 1e-12) with train statistics (broadcast one-row join)."""
    s = stats.select(*[F.col(f"{c}__{k}") for c in features for k in ("mean", "std")])
    j = with_global(df, s)
    out = [((F.col(c).cast("double") - F.col(f"{c}__mean")) / (F.col(f"{c}__std") + F.lit(EPS_STD))).alias(c)
           if c in features else F.col(f"`{c}`") for c in df.columns]
    return j.select(*out)


def clip_outliers(df: DataFrame, features: list[str], limit: float = OUTLIER_LIMIT) -> DataFrame:
    """Op 29: |x| > limit -> 0; missing stays missing."""
    return df.select(*[F.when(F.abs(F.col(c)) > limit, F.lit(0.0)).otherwise(F.col(c)).alias(c)
                       if c in features else F.col(f"`{c}`") for c in df.columns])


def _time_number(c, dtype: str):
    """A number that increases with the time column (days for dates, seconds for timestamps)."""
    if dtype == "date":
        return F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    if dtype.startswith("timestamp"):
        return F.unix_seconds(F.col(c).cast("timestamp"))
    return F.col(c).cast("double")


def locf_impute(df: DataFrame, id_col: str, time_col: str, features: list[str],
                stats: DataFrame | None = None, bucket_width: float = 32) -> DataFrame:
    """Op 30: per id in time order carry the last observed value forward;
    leading (or all) missing -> the feature's default fill (-1 without stats).

    Skew-safe: rows are windowed per (id, time bucket of ``bucket_width`` days
    or units), and the value carried into a bucket is the last observed value
    of that id's earlier buckets, taken from a table with one row per
    (id, bucket). A patient with a third of all visits is spread over many tasks.
    """
    dtype = dict(df.dtypes)[time_col]
    d = df.withColumn("_tb", F.floor(_time_number(time_col, dtype) / F.lit(bucket_width)))
    w = Window.partitionBy(id_col, "_tb").orderBy(time_col).rowsBetween(Window.unboundedPreceding, 0)
    last_in = d.groupBy(id_col, "_tb").agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(time_col))).alias(f"_lb_{c}") for c in features])
    wb = Window.partitionBy(id_col).orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    carry = last_in.select(id_col, "_tb", *[F.last(f"_lb_{c}", ignorenulls=True).over(wb).alias(f"_cy_{c}")
                                            for c in features])
    d = d.join(carry, [id_col, "_tb"], "left")
    if stats is not None:
        fills = stats.select(*[F.col(f"{c}__fill") for c in features])
        d = with_global(d, fills)
        fill = {c: F.col(f"{c}__fill") for c in features}
    else:
        fill = {c: F.lit(MISSING_STATS_FILL) for c in features}
    out = [F.coalesce(F.last(F.col(c), ignorenulls=True).over(w), F.col(f"_cy_{c}"), fill[c]).alias(c)
           if c in features else F.col(f"`{c}`") for c in df.columns]
    return d.select(*out)


def los_info(train: DataFrame, id_col: str, los_col: str = "los") -> DataFrame:
    """Op 31: trimmed LOS mean/std/median plus, over the per-patient max LOS,
    p95 (``large_los``) and 0.5 x mean of values in [p5, p95] (``threshold``)."""
    st = trimmed_stats(train, [los_col]).select(
        F.col(f"{los_col}__mean").alias("los_mean"), F.col(f"{los_col}__std").alias("los_std"),
        F.col(f"{los_col}__median").alias("los_median"))
    per = materialize(train.groupBy(id_col).agg(F.max(F.col(los_col).cast("double")).alias("m")))
    q = exact_quantiles(per, [], "m", [0.05, 0.95])
    th = (with_global(per, q)
             .agg(F.avg(F.when((F.col("m") >= F.col("q0")) & (F.col("m") <= F.col("q1")), F.col("m"))).alias("_t")))
    return with_global(with_global(st, q.select(F.col("q1").alias("large_los"))),
                       th.select((F.col("_t") * 0.5).alias("threshold")))


def reverse_los(df: DataFrame, info: DataFrame, col: str, out: str) -> DataFrame:
    """Op 32: y * los_std + los_mean (no epsilon)."""
    j = with_global(df, info.select("los_mean", "los_std"))
    return j.withColumn(out, F.col(col) * F.col("los_std") + F.col("los_mean")).drop("los_mean", "los_std")


def los_normalize(df: DataFrame, info: DataFrame, col: str, out: str) -> DataFrame:
    """Op 33: (pred - los_mean) / (los_std + 1e-12), so generated LOS answers
    are on the scale of the z-scored labels."""
    j = with_global(df, info.select("los_mean", "los_std"))
    return (j.withColumn(out, (F.col(col) - F.col("los_mean")) / (F.col("los_std") + F.lit(EPS_STD)))
             .drop("los_mean", "los_std"))


def last_visit(df: DataFrame, id_col: str, time_col: str, cols: list[str]) -> DataFrame:
    """Op 47: features and labels of each id's last visit (partial aggregation, no sort)."""
    latest = F.max_by(F.struct(*[F.col(c) for c in [time_col] + cols]), F.col(time_col))
    return df.groupBy(id_col).agg(latest.alias("_l")).select(id_col, *[F.col(f"_l.{c}").alias(c)
                                                                        for c in [time_col] + cols])


__all__ = ["daily_merge", "category_vocabulary", "one_hot", "missing_mask", "wide_quantiles", "trimmed_stats", "stats_long",
           "zscore", "clip_outliers", "locf_impute", "los_info", "reverse_los", "los_normalize",
           "last_visit", "safe_div"]
