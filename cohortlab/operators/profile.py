"""Family A: table profiling (ops 9-13, 114). One aggregate pass per profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.exprs import nan_to_null, with_global
from cohortlab.functions.ordered import exact_quantiles
from cohortlab.session import materialize


def profile_describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Op 9: count / mean / std / min / exact quartiles / max per numeric column,
    one row per column (exact linear quartiles, not ``summary()``'s approximation).
    Cells are unpivoted so a column's work spreads over tasks."""
    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), nan_to_null(F.col(c).cast("double")).alias("v")) for c in columns])))
    cells = materialize(cells)
    mom = cells.groupBy("column_name").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"))
    q = exact_quantiles(cells, ["column_name"], "v", [0.25, 0.5, 0.75])
    out = mom.join(q, "column_name", "left")
    return out.select("column_name", "count", "mean", "std", "min", F.col("q0").alias("q25"),
                      F.col("q1").alias("q50"), F.col("q2").alias("q75"), "max")


def column_types(df: DataFrame) -> list[tuple[str, str]]:
    """Op 9 (schema half): column names and types, from metadata only."""
    return list(df.dtypes)


def preview(df: DataFrame, order_cols: list[str], n: int = 5) -> DataFrame:
    """Op 114: first ``n`` rows in an explicit order (TakeOrderedAndProject)."""
    return df.orderBy(*order_cols).limit(n)


def visits_per_patient(df: DataFrame, keys: list[str]) -> DataFrame:
    """Op 10: group size per key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_visits"))


def visit_count_stats(counts: DataFrame, col: str = "n_visits") -> DataFrame:
    """Op 11: mean / median / max / min of the group sizes."""
    m = counts.agg(F.avg(col).alias("mean_visits"), F.max(col).alias("max_visits"), F.min(col).alias("min_visits"))
    med = exact_quantiles(counts, [], col, [0.5]).select(F.col("q0").alias("median_visits"))
    return with_global(m, med).select("mean_visits", "median_visits", "max_visits", "min_visits")


def visit_count_distribution(counts: DataFrame, col: str = "n_visits") -> DataFrame:
    """Op 12: how many groups have each size, ordered by size."""
    return counts.groupBy(col).agg(F.count(F.lit(1)).alias("n_patients")).orderBy(col)


def missing_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Op 13: per column missing count, missing % (half-even, 2 dp) and total rows,
    most-missing first (column name breaks ties). One pass for all columns."""
    aggs = [F.count(F.lit(1)).alias("_total")]
    for c in columns:
        v = F.col(c)
        miss = v.isNull() | (F.isnan(v) if dict(df.dtypes)[c] in ("double", "float") else F.lit(False))
        aggs.append(F.sum(miss.cast("long")).alias(f"{c}__m"))
    s = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__m").alias("missing_count"),
                              F.bround(F.col(f"{c}__m") * 100.0 / F.col("_total"), 2).alias("missing_pct"),
                              F.col("_total").alias("total_rows")) for c in columns])
    return s.select(F.inline(rows)).orderBy(F.col("missing_count").desc(), "column_name")
