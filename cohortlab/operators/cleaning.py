"""Projections, filters and cohort cleaning (ops 1-2, 14-22)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.exprs import join_null_safe, nan_to_null
from cohortlab.session import materialize


def scan_project(df: DataFrame, columns: list[str]) -> DataFrame:
    """Op 1: keep a named column list (pruned at the parquet reader)."""
    return df.select(*columns)


def rename_standardize(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Op 2: rename source columns to canonical names."""
    return df.withColumnsRenamed(mapping)


MAX_CARRY_ROWS = 1_000_000  # block ends that one task may fill down


def fill_id_down(df: DataFrame, order_col: str, id_col: str, out: str = "id",
                 block_size: int = 1 << 20) -> DataFrame:
    """Op 14: forward-fill an id that is only given on the first row of its block.

    Rows are cut into fixed ranges of ``order_col`` (``block_size`` wide; the order may
    have gaps); each range is filled by its own window, and the value carried into a
    range is the last non-null id of the ranges before it.
    """
    d = df.withColumn("_blk", F.floor(F.col(order_col) / F.lit(block_size)))
    w = Window.partitionBy("_blk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_loc", F.last(F.col(id_col), ignorenulls=True).over(w))
    ends = d.groupBy("_blk").agg(F.max_by(F.col(id_col), F.when(F.col(id_col).isNotNull(), F.col(order_col))).alias("_last"))
    d = join_null_safe(d, _carried(ends), ["_blk"], "left")
    return d.withColumn(out, F.coalesce("_loc", "_carry")).drop("_blk", "_loc", "_carry")


def _carried(ends: DataFrame) -> DataFrame:
    """``(_blk, _carry)``: the last non-null ``_last`` of the blocks before each one. While there
    are more than MAX_CARRY_ROWS blocks, 1024 of them at a time are blocks of the next level."""
    ends = materialize(ends)
    before = F.last("_last", ignorenulls=True)
    if ends.limit(MAX_CARRY_ROWS + 1).count() <= MAX_CARRY_ROWS:
        one = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)  # at most MAX_CARRY_ROWS rows
        return ends.select("_blk", before.over(one).alias("_carry"))
    d = ends.withColumn("_up", F.floor(F.col("_blk") / 1024))
    own = Window.partitionBy("_up").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    upper = _carried(d.groupBy(F.col("_up").alias("_blk")).agg(
        F.max_by("_last", F.when(F.col("_last").isNotNull(), F.col("_blk"))).alias("_last")))
    d = d.withColumn("_loc", before.over(own)).join(upper.select(F.col("_blk").alias("_up"), "_carry"), "_up", "left")
    return d.select("_blk", F.coalesce("_loc", "_carry").alias("_carry"))


def recode_values(df: DataFrame, column: str, mapping: dict, out: str | None = None) -> DataFrame:
    """Op 15: map listed values (e.g. sex 2 -> 0), keep others."""
    expr = F.col(column)
    for src, dst in mapping.items():
        expr = F.when(F.col(column) == F.lit(src), F.lit(dst)).otherwise(expr)
    return df.withColumn(out or column, expr)


def truncate_to_day(df: DataFrame, columns: list[str]) -> DataFrame:
    """Op 16: timestamps -> dates."""
    return df.withColumns({c: F.to_date(F.col(c)) for c in columns})


def drop_missing_labels(df: DataFrame, subset: list[str]) -> DataFrame:
    """Op 17: drop rows with any null in ``subset``."""
    return df.na.drop(how="any", subset=subset)


def los_label(df: DataFrame, start_col: str, end_col: str, out: str = "los") -> DataFrame:
    """Op 18: remaining stay in days per row, max(0, end - start); null dates stay null."""
    days = F.datediff(F.col(end_col), F.col(start_col))
    return df.withColumn(out, F.when(days.isNotNull(), F.greatest(days, F.lit(0))).cast("bigint"))


def constant_column_verdict(df: DataFrame, columns: list[str]) -> DataFrame:
    """Op 19: per column, non-null count and whether it is constant or all missing.

    min == max over non-null cells is equivalent to "at most one distinct value"
    and needs no distinct-count state: one partial-aggregated pass.
    """
    aggs = []
    for c in columns:
        v = nan_to_null(F.col(c)) if dict(df.dtypes)[c] in ("double", "float") else F.col(c)
        aggs += [F.count(v).alias(f"{c}__n"), F.min(v).cast("string").alias(f"{c}__lo"),
                 F.max(v).cast("string").alias(f"{c}__hi")]
    s = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__n").alias("n_nonnull"),
                              ((F.col(f"{c}__n") == 0) | (F.col(f"{c}__lo") == F.col(f"{c}__hi"))).alias("is_constant"))
                     for c in columns])
    return s.select(F.inline(rows))


def drop_constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Op 19 applied: the verdict (one row per column) decides the select list."""
    verdict = constant_column_verdict(df, columns).where("is_constant").select("column_name").collect()
    drop = {r.column_name for r in verdict}
    return df.select(*[c for c in df.columns if c not in drop])


def negative_to_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Op 20: cell-wise ``x < 0 -> null``."""
    return df.withColumns({c: F.when(F.col(c) < 0, F.lit(None)).otherwise(F.col(c)) for c in columns})


def clean_feature_name(c) -> "F.Column":
    """Op 22: strip surrounding spaces and remove '-' from a feature name."""
    return F.regexp_replace(F.trim(c if not isinstance(c, str) else F.col(c)), "-", "")
