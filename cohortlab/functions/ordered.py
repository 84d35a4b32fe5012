"""Exact running sums along a sort order without a group-wide sort.

``ordered_cumsum`` takes a table with one row per (group, value) and adds the
inclusive running sum of some measures in value order. The value range of
each group is cut into equal-width buckets; bucket totals (at most ``buckets``
rows per group, written once) give each bucket's starting offset, and rows are
only sorted inside their (group, bucket) cell. Work is spread over group x
bucket tasks instead of one task per group, and the result is exact. If the
values crowd into a few buckets (a cell above ``skew_cell_rows``), the same sums
are taken over Spark's sampled range partitioning instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.exprs import join_null_safe
from cohortlab.session import materialize

DEFAULT_BUCKETS = 4096


SKEW_CELL_ROWS = 2_000_000  # a (group, bucket) cell larger than this takes the range-partitioned path
SMALL_GROUP_ROWS = 1_000_000  # groups up to this size are summed with one plain window


def ordered_cumsum(agg: DataFrame, group_cols: list[str], value_col: str, measures: list[str],
                   descending: bool = False, buckets: int = DEFAULT_BUCKETS, suffix: str = "_cum",
                   skew_cell_rows: int = SKEW_CELL_ROWS, small_group_rows: int = SMALL_GROUP_ROWS) -> DataFrame:
    vorder = F.col(value_col).desc() if descending else F.col(value_col).asc()
    largest = agg.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_g")).agg(F.max("_g")).first()[0] or 0
    if largest <= small_group_rows:
        # every group is provably small: one window per group is bounded work per task
        w = Window.partitionBy(*group_cols).orderBy(vorder).rowsBetween(Window.unboundedPreceding, 0)
        return agg.withColumns({f"{m}{suffix}": F.sum(m).over(w) for m in measures})
    v = F.col(value_col).cast("double")
    rng = agg.groupBy(*group_cols).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    a = join_null_safe(agg, rng, group_cols)
    frac = (v - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    bk = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor(frac * buckets), F.lit(buckets - 1))).otherwise(F.lit(0))
    a = a.withColumn("_bk", bk.cast("int")).drop("_lo", "_hi")
    bt = materialize(a.groupBy(*group_cols, "_bk").agg(F.count(F.lit(1)).alias("_cells"),
                                                       *[F.sum(m).alias(f"_bt_{m}") for m in measures]))
    biggest = bt.agg(F.max("_cells")).first()[0] or 0
    if biggest > skew_cell_rows:
        # values crowd into few buckets: fall back to sampled range partitioning
        return _ordered_cumsum_ranged(agg, group_cols, value_col, measures, descending, suffix)
    border = F.col("_bk").desc() if descending else F.col("_bk").asc()
    wb = Window.partitionBy(*group_cols).orderBy(border).rowsBetween(Window.unboundedPreceding, -1)
    bt = bt.select(*group_cols, "_bk", *[F.coalesce(F.sum(f"_bt_{m}").over(wb), F.lit(0)).alias(f"_off_{m}")
                                         for m in measures])
    a = join_null_safe(a, bt, group_cols + ["_bk"])
    wi = Window.partitionBy(*group_cols, "_bk").orderBy(vorder).rowsBetween(Window.unboundedPreceding, 0)
    a = a.withColumns({f"{m}{suffix}": F.col(f"_off_{m}") + F.sum(m).over(wi) for m in measures})
    return a.drop("_bk", *[f"_off_{m}" for m in measures])


def _ordered_cumsum_ranged(agg: DataFrame, group_cols: list[str], value_col: str, measures: list[str],
                           descending: bool, suffix: str) -> DataFrame:
    """Same result via Spark's sampled range partitioning (balanced under any value
    distribution). The partitioned table is checkpointed so partition ids are fixed;
    per-partition totals give each partition's offset."""
    spark = agg.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    vorder = F.col(value_col).desc() if descending else F.col(value_col).asc()
    order = [F.col(g) for g in group_cols] + [vorder]
    s = materialize(agg.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()))
    tot = s.groupBy("_pid", *group_cols).agg(*[F.sum(m).alias(f"_pt_{m}") for m in measures])
    w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select("_pid", *group_cols, *[F.coalesce(F.sum(f"_pt_{m}").over(w), F.lit(0)).alias(f"_off_{m}")
                                            for m in measures])
    out = join_null_safe(s, off, ["_pid"] + group_cols)
    wi = Window.partitionBy("_pid", *group_cols).orderBy(vorder).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({f"{m}{suffix}": F.col(f"_off_{m}") + F.sum(m).over(wi) for m in measures})
    return out.drop("_pid", *[f"_off_{m}" for m in measures])


def average_rank(df: DataFrame, group_cols: list[str], value_col: str, out: str = "rank") -> DataFrame:
    """1-based ascending rank per group with ties sharing their average rank."""
    d = df.groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("_n"))
    c = ordered_cumsum(d, group_cols, value_col, ["_n"])
    c = c.select(*group_cols, value_col, (F.col("_n_cum") - F.col("_n") + (F.col("_n") + 1) / 2.0).alias(out))
    return join_null_safe(df, c, group_cols + [value_col])


def dense_rank(df: DataFrame, group_cols: list[str], value_col: str, out: str = "drank") -> DataFrame:
    """0-based dense rank of ``value_col`` per group (equal values share a rank)."""
    d = df.groupBy(*group_cols, value_col).agg(F.lit(1).alias("_one"))
    c = ordered_cumsum(d, group_cols, value_col, ["_one"])
    c = c.select(*group_cols, value_col, (F.col("_one_cum") - 1).cast("long").alias(out))
    return join_null_safe(df, c, group_cols + [value_col])


MAP_QUANTILE_LIMIT = 2_000_000  # groups up to this size use Spark's exact value->count map


def largest_group(df: DataFrame, key_cols: list[str], value_col: str) -> int:
    """Size of the largest key group of non-null values (one small aggregate job)."""
    v = F.col(value_col).cast("double")
    n = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*key_cols).agg(F.count(F.lit(1)).alias("_n"))
    return n.agg(F.max("_n")).first()[0] or 0


def exact_quantiles(df: DataFrame, key_cols: list[str], value_col: str, probs: list[float],
                    accuracy: int = 10000, prefix: str = "q", map_limit: int = MAP_QUANTILE_LIMIT,
                    largest: int | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles per key (numpy / ``quantile_cont`` rule),
    without holding a group's values in one map.

    1. One aggregate pass: count, min, max and approximate quantiles at p -/+ 5/accuracy,
       which bracket the exact order statistics (rank error <= n / accuracy).
    2. One pass counts the values below each bracket and collects the distinct values
       inside it (about 10 n / accuracy of them) with their multiplicities.
    3. A running count over the bracket's distinct values picks the two order
       statistics around (n - 1) p, which are interpolated.

    Groups whose size is provably small (largest group <= ``map_limit`` values,
    checked with one count) take Spark's exact ``percentile`` aggregate instead,
    whose per-group value map is then bounded.

    Output: key_cols, ``{prefix}{i}`` per probability (null for an empty group).
    """
    v = df.select(*key_cols, F.col(value_col).cast("double").alias("_v")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v"))
    if largest is None:  # callers that already know an upper bound pass it in
        largest = largest_group(df, key_cols, value_col)
    # bracket width ~10 n / accuracy: raise the sketch accuracy with n so that at most
    # ~1e6 candidate values per key reach the exact ranking step
    accuracy = max(accuracy, min(10_000_000, -(-largest // 100_000)))
    delta = 5.0 / accuracy
    if largest <= map_limit:
        pa = v.groupBy(*key_cols).agg(F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs])).alias("_q"))
        return pa.select(*key_cols, *[F.col("_q")[i].alias(f"{prefix}{i}") for i in range(len(probs))])
    lo_p = [max(0.0, p - delta) for p in probs]
    hi_p = [min(1.0, p + delta) for p in probs]
    br = v.groupBy(*key_cols).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", lo_p, accuracy).alias("_alo"),
        F.percentile_approx("_v", hi_p, accuracy).alias("_ahi"))
    pr = br.select(*key_cols, "_n", "_min", "_max", "_alo", "_ahi",
                   F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("_i", "_p"))
    blo = F.when(F.col("_p") - delta <= 0, F.col("_min")).otherwise(F.element_at("_alo", F.col("_i") + 1))
    bhi = F.when(F.col("_p") + delta >= 1, F.col("_max")).otherwise(F.element_at("_ahi", F.col("_i") + 1))
    h = (F.col("_n") - 1) * F.col("_p")
    pr = pr.select(*key_cols, "_i", blo.alias("_blo"), bhi.alias("_bhi"), F.floor(h).cast("long").alias("_rf"),
                   F.ceil(h).cast("long").alias("_rc"), (h - F.floor(h)).alias("_fr"))
    j = join_null_safe(v, pr, key_cols)
    below = j.groupBy(*key_cols, "_i").agg(F.sum((F.col("_v") < F.col("_blo")).cast("long")).alias("_below"))
    cand = (j.where((F.col("_v") >= F.col("_blo")) & (F.col("_v") <= F.col("_bhi")))
             .groupBy(*key_cols, "_i", "_v").agg(F.count(F.lit(1)).alias("_c")))
    w = Window.partitionBy(*key_cols, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    cand = cand.withColumn("_cum", F.sum("_c").over(w))
    cand = join_null_safe(join_null_safe(cand, below, key_cols + ["_i"]), pr.select(*key_cols, "_i", "_rf", "_rc", "_fr"), key_cols + ["_i"])
    at = cand.groupBy(*key_cols, "_i").agg(
        F.min(F.when(F.col("_below") + F.col("_cum") > F.col("_rf"), F.col("_v"))).alias("_vf"),
        F.min(F.when(F.col("_below") + F.col("_cum") > F.col("_rc"), F.col("_v"))).alias("_vc"),
        F.first("_fr").alias("_fr"))
    q = at.select(*key_cols, "_i", (F.col("_vf") + F.col("_fr") * (F.col("_vc") - F.col("_vf"))).alias("_q"))
    wide = q.groupBy(*key_cols).agg(*[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(f"{prefix}{i}")
                                      for i in range(len(probs))])
    keys = br.select(*key_cols)
    return join_null_safe(keys, wide, key_cols, "left") if key_cols else wide
