"""Lookup joins, experiment grid, unions and modality joins (ops 52-55).

Lookup tables are dimension-sized; the join is left to the planner, whose
broadcast decision is checked against the measured size of the lookup side
(AQE / autoBroadcastJoinThreshold), so a lookup that grows falls back to a
shuffle join instead of being forced into memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.exprs import with_global


def join_lookup(df: DataFrame, lookup: DataFrame, key: str, lookup_key: str, value: str, out: str) -> DataFrame:
    """Op 52: map a key to a display value; unmapped keys keep their own text."""
    lk = lookup.select(F.col(lookup_key).alias("_k"), F.col(value).alias("_v"))
    j = df.join(lk, df[key] == lk["_k"], "left")
    return j.withColumn(out, F.coalesce(F.col("_v"), F.col(key).cast("string"))).drop("_k", "_v")


def experiment_grid(models: DataFrame, dataset_tasks: list[tuple[str, str]], valid: dict[str, set[str]],
                    settings: list[dict]) -> DataFrame:
    """Op 53: model x (dataset, task) x setting grid with the validity rule
    ``task -> allowed datasets`` (e.g. readmission only on one dataset).

    Models come from the data; the dimension lists are configuration and are
    attached with ``explode`` (no data x data product).
    """
    pairs = [(d, t) for d, t in dataset_tasks if t not in valid or d in valid[t]]
    pair_arr = F.array(*[F.struct(F.lit(d).alias("dataset"), F.lit(t).alias("task")) for d, t in pairs])
    set_arr = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in s.items()]) for s in settings])
    return (models.select("model", F.explode(pair_arr).alias("p"), F.explode(set_arr).alias("s"))
                  .select("model", "p.*", "s.*"))


def append_results(frames: list[DataFrame]) -> DataFrame:
    """Op 54: union result tables by column name; absent columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def join_modalities(ehr: DataFrame, note: DataFrame, labels: DataFrame, id_col: str = "id") -> DataFrame:
    """Op 55: EHR embedding x note embedding x label by id (inner join)."""
    return ehr.join(note, id_col).join(labels, id_col)


def equal_count_check(a: DataFrame, b: DataFrame) -> DataFrame:
    """Op 55 (check half): row counts of both sides in one row, and whether they agree."""
    ca = a.agg(F.count(F.lit(1)).alias("n_left"))
    cb = b.agg(F.count(F.lit(1)).alias("n_right"))
    return with_global(ca, cb).withColumn("equal", F.col("n_left") == F.col("n_right"))


def require_equal_counts(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Op 55: ``first``, which fails when read unless all tables have as many rows (no modality lacks a sample)."""
    for other in others:
        check = equal_count_check(first, other)
        sure = check.select(F.when(F.col("equal"), F.lit(True)).otherwise(F.raise_error(F.format_string(
            "mismatch in the number of samples: %d and %d", "n_left", "n_right"))).alias("_equal"))
        first = with_global(first, sure).where("_equal").drop("_equal")
    return first
