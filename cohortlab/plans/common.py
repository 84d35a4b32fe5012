"""Shared Spark building blocks for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.operators import cleaning, panel, splits
from cohortlab.session import materialize, write_once
from cohortlab.sources.tables import fixture

PANEL_FEATURES = ["age", "click", "error", "purchase", "signup", "view_"]
LAB_FEATURES = ["click", "error", "purchase", "signup", "view_"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def customer_cohort(spark: SparkSession, sf: str) -> DataFrame:
    adm = fixture(spark, sf, "f_admissions")
    return splits.first_label_per_id(adm, "patient_id", "record_date", "outcome", tiebreak="record_id")


def customer_splits(spark: SparkSession, sf: str) -> DataFrame:
    return splits.assign_splits(customer_cohort(spark, sf), test_n=200, val_frac=1 / 8, seed=42)


def panel_splits(spark: SparkSession, sf: str) -> DataFrame:
    pc = fixture(spark, sf, "f_patients").select("id", F.col("outcome").alias("label"))
    return materialize(splits.stratified_fraction(pc, 1 / 8, seed=42, salt="val").select("id", "label", "split"))


def panel_stats(spark: SparkSession, sf: str, visits: DataFrame | None = None) -> DataFrame:
    visits = fixture(spark, sf, "f_visits") if visits is None else visits
    train = splits.split_filter(visits, panel_splits(spark, sf), "id", "train")
    return panel.trimmed_stats(train, PANEL_FEATURES)


def build_panel(spark: SparkSession, sf: str, stage: str = "locf") -> DataFrame:
    """f_visits -> train stats -> z-score -> clip -> LOCF (the flagship slice)."""
    visits = write_once(fixture(spark, sf, "f_visits"), "visits")  # aggregated once, read by columns below
    stats = panel_stats(spark, sf, visits)
    z = panel.zscore(visits, stats, PANEL_FEATURES)
    if stage == "zscore":
        return z
    z = panel.clip_outliers(z, PANEL_FEATURES)
    if stage == "clip":
        return z
    return panel.locf_impute(z, "id", "record_date", LAB_FEATURES, stats)


def admissions_los(spark: SparkSession, sf: str) -> DataFrame:
    adm = fixture(spark, sf, "f_admissions")
    return cleaning.los_label(adm, "record_date", "discharge_date", "los")
