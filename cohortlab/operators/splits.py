"""Family C: stratified / capped / leak-free splits and seeded sampling (ops 34-42).

Draw order of an id is ``hash_order`` (md5 of seed|salt|id), never a random
generator, so every split is reproducible and checkable in SQL.

Selection of "the first q rows of a group in hash order" is done without a
group-wide window: rows are counted per 16-bit hash bucket, cumulative counts
locate the single bucket that straddles the quota, and only the rows of that
bucket are ranked. A group holding a third of the data costs one small
histogram and one ~1/65536 slice, not one giant sorted task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.exprs import hash_order, join_null_safe
from cohortlab.session import materialize

_BUCKET_BITS = 16


def first_label_per_id(df: DataFrame, id_col: str, time_col: str, label_col: str,
                       tiebreak: str | None = None) -> DataFrame:
    """Op 34: stratum label = label of the earliest row of each id."""
    order = F.struct(F.col(time_col), F.col(tiebreak)) if tiebreak else F.col(time_col)
    return df.groupBy(F.col(id_col).alias("id")).agg(F.min_by(F.col(label_col), order).alias("label"))


def _quotas(counts: DataFrame, strata: list[str], target) -> DataFrame:
    """Quota of every stratum, ``(*strata, quota)``, in proportion to its size ``n_c``.

    Floor of the exact share, and one more for the largest remainders (ties: stratum
    order, null last). ``target`` is an int or a function of the cohort size. Only two
    sums reach the driver.
    """
    total = counts.agg(F.sum("n_c")).first()[0] or 0
    tgt = min(total, target(total) if callable(target) else int(target))
    share = F.lit(tgt).cast("decimal(19,0)") * F.col("n_c")  # a product of two counts may pass 2^63
    floor = F.floor(share / max(total, 1)) if total >= 1 << 31 else F.expr(f"({tgt} * n_c) div {max(total, 1)}")
    c = counts.withColumn("fl", floor.cast("bigint"))
    c = c.withColumn("rem", (share - F.col("fl").cast("decimal(19,0)") * max(total, 1)).cast("bigint"))
    extra = tgt - (c.agg(F.sum("fl")).first()[0] or 0)
    top = c.orderBy(F.desc("rem"), *[F.asc_nulls_last(g) for g in strata]).limit(extra).select(*strata, F.lit(1).alias("more"))
    return join_null_safe(c, top, strata, "left").select(*strata, (F.col("fl") + F.coalesce("more", F.lit(0))).alias("quota"))


def take_first_by_hash(df: DataFrame, group_cols: list[str], quotas: DataFrame,
                       h_col: str = "_h", id_col: str = "id", flag: str = "_sel") -> DataFrame:
    """Flag the first ``quota`` rows of every group in (h, id) order, exactly.

    ``quotas`` has one row per group: (*group_cols, quota); null is a group like any
    other. Hash buckets below the one that straddles the quota are taken whole, and
    only the rows of that bucket (a 65536th of a group) are ranked.
    """
    cols = df.columns
    d = df.withColumn("_b", F.shiftright(F.col(h_col), _BUCKET_BITS))
    hist = d.groupBy(*group_cols, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*group_cols).orderBy("_b")  # at most 65536 rows a group
    hist = join_null_safe(hist.withColumn("_before", F.sum("_cnt").over(w) - F.col("_cnt")), quotas, group_cols)
    # first bucket that cannot be taken whole; none -> every row is selected
    hist = hist.withColumn("_over", F.col("_before") + F.col("_cnt") > F.col("quota"))
    cut = hist.groupBy(*group_cols, "quota").agg(
        F.coalesce(F.min(F.when(F.col("_over"), F.col("_b"))), F.lit(1 << (32 - _BUCKET_BITS))).alias("_cb"),
        F.coalesce(F.min_by(F.col("_before"), F.when(F.col("_over"), F.col("_b"))), F.lit(0)).alias("_cbase"))
    d = materialize(join_null_safe(d, cut, group_cols))
    wr = Window.partitionBy(*group_cols, "_b").orderBy(h_col, id_col)
    whole = d.where(F.col("_b") != F.col("_cb")).withColumn(flag, F.col("_b") < F.col("_cb"))
    edge = d.where(F.col("_b") == F.col("_cb")).withColumn(flag, F.col("_cbase") + F.row_number().over(wr) <= F.col("quota"))
    return whole.unionByName(edge).select(*cols, flag)


def _stratified_take(cohort: DataFrame, target, seed: int, salt: str | None,
                     strata: list[str], flag: str = "_sel") -> DataFrame:
    """Flag the first quota ids of every stratum in hash order, in one way for any
    number and size of strata."""
    d = cohort.withColumn("_h", hash_order("id", seed, salt))
    counts = materialize(d.groupBy(*strata).agg(F.count(F.lit(1)).alias("n_c")))
    return take_first_by_hash(d, strata, _quotas(counts, strata, target), flag=flag).drop("_h")


def random_holdout(cohort: DataFrame, n: int = 200, seed: int = 42, salt: str | None = None) -> DataFrame:
    """Op 35: unstratified fixed-size holdout; returns cohort + boolean ``in_test``."""
    d = cohort.withColumn("_h", hash_order("id", seed, salt))
    quotas = d.agg(F.least(F.count(F.lit(1)), F.lit(n)).alias("quota"))
    return take_first_by_hash(d, [], quotas, flag="in_test").drop("_h")


def stratified_holdout(cohort: DataFrame, n: int = 200, seed: int = 42, salt: str | None = None,
                       label: str = "label") -> DataFrame:
    """Op 36: fixed-size stratified holdout; adds boolean ``in_test``."""
    return _stratified_take(cohort, n, seed, salt, [label], flag="in_test")


def stratified_cap(pool: DataFrame, cap: int = 10000, seed: int = 42, salt: str = "cap",
                   label: str = "label") -> DataFrame:
    """Op 37: keep at most ``cap`` ids of the pool, stratified; adds ``kept``."""
    return _stratified_take(pool, cap, seed, salt, [label], flag="kept")


def stratified_fraction(pool: DataFrame, frac: float = 1 / 8, seed: int = 42, salt: str = "val",
                        label: str = "label") -> DataFrame:
    """Op 38: ceil(frac*n) ids to ``val`` (stratified), the rest ``train``."""
    def target(total: int) -> int:
        return math.ceil(total * frac)
    out = _stratified_take(pool, target, seed, salt, [label], flag="_v")
    return out.withColumn("split", F.when(F.col("_v"), "val").otherwise("train")).drop("_v")


def assign_splits(cohort: DataFrame, test_n: int = 200, cap: int | None = None, val_frac: float = 1 / 8,
                  seed: int = 42) -> DataFrame:
    """Ops 36-38 chained: stratified test, then 7/8-1/8 train/val of the rest.

    Input (id, label); output (id, label, split). Every id gets a split unless a ``cap``
    on the rest is asked for (op 37), which drops the ids beyond it.
    """
    t = materialize(stratified_holdout(cohort, test_n, seed))
    test = t.where("in_test").select("id", "label", F.lit("test").alias("split"))
    pool = t.where(~F.col("in_test")).select("id", "label")
    if cap is not None:
        pool = materialize(stratified_cap(pool, cap, seed).where("kept").select("id", "label"))
    tv = stratified_fraction(pool, val_frac, seed).select("id", "label", "split")
    return materialize(test.unionByName(tv))


def leakage_check(splits: DataFrame) -> DataFrame:
    """Op 39: ids that appear in more than one split (must be empty)."""
    return (splits.groupBy("id").agg(F.count_distinct("split").alias("n_splits"))
                  .where(F.col("n_splits") > 1))


def split_sizes(splits: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    """Op 40: rows and distinct ids per split."""
    r = rows.join(splits.select(F.col("id").alias(id_col), "split"), id_col)
    return r.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"),
                                  F.count_distinct(id_col).alias("n_ids"))


def split_filter(rows: DataFrame, splits: DataFrame, id_col: str, split: str) -> DataFrame:
    """Op 21: rows whose id belongs to one split (semi join, no duplication)."""
    ids = splits.where(F.col("split") == split).select(F.col("id").alias(id_col))
    return rows.join(ids, id_col, "left_semi")


def few_shot(splits: DataFrame, per_class: int = 5, seed: int = 42, salt: str = "shot") -> DataFrame:
    """Op 41: at most ``per_class`` ids per (split, label) for train and val; test unchanged."""
    tv = splits.where(F.col("split") != "test").withColumn("_h", hash_order("id", seed, salt))
    counts = tv.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
    quotas = counts.select("split", "label", F.least("n", F.lit(per_class)).alias("quota"))
    picked = take_first_by_hash(tv, ["split", "label"], quotas).where("_sel").drop("_sel", "_h")
    return splits.where(F.col("split") == "test").unionByName(picked)


def epoch_subset(rows: DataFrame, epochs: int, size: int = 2000, seed: int = 42) -> DataFrame:
    """Op 42: per epoch, a fresh subset of at most ``size`` ids drawn without replacement."""
    d = rows.select("id").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    d = d.withColumn("_h", F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("epoch"),
                                                                 F.col("epoch").cast("string"),
                                                                 F.col("id").cast("string"))), 1, 8),
                                  16, 10).cast("bigint"))
    counts = d.groupBy("epoch").agg(F.least(F.count(F.lit(1)), F.lit(size)).alias("quota"))
    return take_first_by_hash(d, ["epoch"], counts).where("_sel").select("epoch", "id")
