"""Registered queries: sources, profiling, cleaning, panel, splits (ops 1-42, 114)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab.operators import cleaning, panel, profile, splits
from cohortlab.plans import sqlparts as S
from cohortlab.plans.common import (LAB_FEATURES, PANEL_FEATURES, EVENT_TYPES, admissions_los,
                                    customer_cohort, customer_splits, build_panel, panel_splits,
                                    panel_stats)
from cohortlab.plans.registry import oracle, register
from cohortlab.sources.tables import fixture, read_table

VISIT_NUM = ["sex", "age"] + LAB_FEATURES

# ---------------------------------------------------------------- sources / profiling


@register("scan_project", oracle("SELECT event_id, user_id, event_type, value FROM events", dbl=("value",)))
def q_scan_project(spark, sf):
    return cleaning.scan_project(read_table(spark, sf, "events"), ["event_id", "user_id", "event_type", "value"])


@register("rename_standardize", oracle(
    "SELECT o_orderkey AS record_id, o_custkey AS patient_id, o_orderstatus AS status, "
    "o_totalprice AS total_price FROM orders", dbl=("total_price",)))
def q_rename(spark, sf):
    o = read_table(spark, sf, "orders")
    r = cleaning.rename_standardize(o, {"o_orderkey": "record_id", "o_custkey": "patient_id",
                                        "o_orderstatus": "status", "o_totalprice": "total_price"})
    return r.select("record_id", "patient_id", "status", "total_price")


_desc_sql = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT({c}) AS count, AVG(CAST({c} AS DOUBLE)) AS mean, "
    f"STDDEV_SAMP(CAST({c} AS DOUBLE)) AS std, CAST(MIN({c}) AS DOUBLE) AS min, "
    f"quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q50, "
    f"quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75, CAST(MAX({c}) AS DOUBLE) AS max FROM f_visits"
    for c in VISIT_NUM)


@register("profile_describe", oracle(_desc_sql, ("f_visits",),
                                     dbl=("mean", "std", "min", "q25", "q50", "q75", "max")))
def q_profile_describe(spark, sf):
    return profile.profile_describe(fixture(spark, sf, "f_visits"), VISIT_NUM)


@register("preview", oracle("SELECT * FROM f_visits ORDER BY id, record_date LIMIT 5", ("f_visits",),
                            dbl=tuple(LAB_FEATURES), txt=("record_date",)))
def q_preview(spark, sf):
    return profile.preview(fixture(spark, sf, "f_visits"), ["id", "record_date"])


@register("visits_per_patient", oracle("SELECT id, COUNT(*) AS n_visits FROM f_visits GROUP BY id", ("f_visits",)))
def q_visits_per_patient(spark, sf):
    return profile.visits_per_patient(fixture(spark, sf, "f_visits"), ["id"])


@register("visit_count_stats", oracle(
    "SELECT AVG(n) AS mean_visits, MEDIAN(n) AS median_visits, MAX(n) AS max_visits, MIN(n) AS min_visits "
    "FROM (SELECT id, COUNT(*) AS n FROM f_visits GROUP BY id)", ("f_visits",),
    dbl=("mean_visits", "median_visits")))
def q_visit_count_stats(spark, sf):
    return profile.visit_count_stats(profile.visits_per_patient(fixture(spark, sf, "f_visits"), ["id"]))


@register("visit_count_distribution", oracle(
    "SELECT n AS n_visits, COUNT(*) AS n_patients FROM (SELECT id, COUNT(*) AS n FROM f_visits GROUP BY id) "
    "GROUP BY n ORDER BY n", ("f_visits",)))
def q_visit_count_distribution(spark, sf):
    return profile.visit_count_distribution(profile.visits_per_patient(fixture(spark, sf, "f_visits"), ["id"]))


_miss_sql = ("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS missing_count, "
    f"ROUND_EVEN((COUNT(*) - COUNT({c})) * 100.0 / COUNT(*), 2) AS missing_pct, COUNT(*) AS total_rows "
    f"FROM f_visits" for c in ["id", "record_date"] + VISIT_NUM) + ") ORDER BY missing_count DESC, column_name")


@register("missing_profile", oracle(_miss_sql, ("f_visits",), dbl=("missing_pct",)))
def q_missing_profile(spark, sf):
    return profile.missing_profile(fixture(spark, sf, "f_visits"), ["id", "record_date"] + VISIT_NUM)

# ---------------------------------------------------------------- cleaning


@register("fill_id_down", oracle(
    "SELECT src_row, role, LAST_VALUE(id_sparse IGNORE NULLS) OVER (ORDER BY src_row "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS id FROM f_sparse_ids", ("f_sparse_ids",)))
def q_fill_id_down(spark, sf):
    d = fixture(spark, sf, "f_sparse_ids")
    return cleaning.fill_id_down(d, "src_row", "id_sparse", "id").select("src_row", "role", "id")


@register("recode_values", oracle(
    "SELECT id, CAST(1 + id % 2 AS INT) AS gender_raw, "
    "CAST(CASE WHEN 1 + id % 2 = 2 THEN 0 ELSE 1 + id % 2 END AS INT) AS gender FROM f_patients",
    ("f_patients",)))
def q_recode_values(spark, sf):
    p = fixture(spark, sf, "f_patients").select("id", (1 + F.col("id") % 2).cast("int").alias("gender_raw"))
    return cleaning.recode_values(p, "gender_raw", {2: 0}, out="gender").withColumn("gender", F.col("gender").cast("int"))


@register("truncate_to_day", oracle("SELECT event_id, CAST(ts AS DATE) AS record_date FROM events",
                                    txt=("record_date",)))
def q_truncate_to_day(spark, sf):
    e = read_table(spark, sf, "events", ["event_id", "ts"])
    return cleaning.truncate_to_day(e, ["ts"]).withColumnRenamed("ts", "record_date")


@register("drop_missing_labels", oracle(
    "SELECT src_row, id_sparse, role FROM f_sparse_ids WHERE id_sparse IS NOT NULL", ("f_sparse_ids",)))
def q_drop_missing_labels(spark, sf):
    return cleaning.drop_missing_labels(fixture(spark, sf, "f_sparse_ids"), ["src_row", "id_sparse"])


@register("los_label", oracle(
    "SELECT record_id, patient_id, GREATEST(datediff('day', record_date, discharge_date), 0) AS los "
    "FROM f_admissions", ("f_admissions",)))
def q_los_label(spark, sf):
    return admissions_los(spark, sf).select("record_id", "patient_id", "los")


_const_sql = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT({c}) AS n_nonnull, "
    f"(COUNT({c}) = 0 OR MIN({c}) = MAX({c})) AS is_constant FROM v" for c in
    ["sex", "age", "click", "ward", "unused"])


@register("drop_constant_columns", oracle(
    _const_sql, ("f_visits",), ctes=(("v", "SELECT *, 1 AS ward, CAST(NULL AS DOUBLE) AS unused FROM f_visits"),)))
def q_drop_constant(spark, sf):
    v = fixture(spark, sf, "f_visits").withColumn("ward", F.lit(1)).withColumn("unused", F.lit(None).cast("double"))
    return cleaning.constant_column_verdict(v, ["sex", "age", "click", "ward", "unused"])


@register("negative_to_missing", oracle(
    "SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS acctbal, "
    "c_nationkey FROM customer", dbl=("acctbal",)))
def q_negative_to_missing(spark, sf):
    c = read_table(spark, sf, "customer", ["c_custkey", "c_acctbal", "c_nationkey"])
    return cleaning.negative_to_missing(c, ["c_acctbal", "c_nationkey"]).select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("acctbal"), "c_nationkey")


@register("clean_feature_names", oracle(
    "SELECT p_partkey AS id, regexp_replace(trim(p_type || ' - ' || p_name || ' '), '-', '', 'g') AS feature "
    "FROM part"))
def q_clean_feature_names(spark, sf):
    p = read_table(spark, sf, "part", ["p_partkey", "p_type", "p_name"])
    raw = F.concat(F.col("p_type"), F.lit(" - "), F.col("p_name"), F.lit(" "))
    return p.select(F.col("p_partkey").alias("id"), cleaning.clean_feature_name(raw).alias("feature"))

# ---------------------------------------------------------------- panel


_pivot_sql = ("SELECT id, record_date, " + ", ".join(
    f"AVG(value) FILTER (WHERE feature = '{t}') AS \"{t}\"" for t in EVENT_TYPES) +
    " FROM f_events WHERE id IS NOT NULL AND record_date IS NOT NULL GROUP BY id, record_date")


@register("daily_merge", oracle(_pivot_sql, ("f_events",), dbl=tuple(EVENT_TYPES), txt=("record_date",)))
def q_daily_merge(spark, sf):
    return panel.daily_merge(fixture(spark, sf, "f_events"), ["id", "record_date"], "feature", "value", EVENT_TYPES)


_LANGS = ["de", "en", "es", "fr"]  # of the test tables, for the oracle


@register("one_hot", oracle(
    "SELECT id, " + ", ".join(f"COALESCE(CAST(dataset = '{v}' AS DOUBLE), 0.0) AS \"dataset->{v}\"" for v in _LANGS)
    + ", n_chars FROM f_documents", ("f_documents",), dbl=tuple(f"dataset->{v}" for v in _LANGS)))
def q_one_hot(spark, sf):
    d = fixture(spark, sf, "f_documents").select("id", "dataset", "n_chars")
    # the vocabulary is what the table holds; the result's columns follow it
    values = [r.value for r in panel.category_vocabulary(d, "dataset").limit(panel.MAX_CATEGORIES + 1).collect()]
    return panel.one_hot(d, "dataset", values)


@register("missing_mask", oracle(
    "SELECT id, record_date, concat_ws(',', " + ", ".join(f"CAST({c} IS NULL AS INT)" for c in VISIT_NUM)
    + ") AS missing_mask FROM f_visits", ("f_visits",), txt=("record_date",)))
def q_missing_mask(spark, sf):
    v = panel.missing_mask(fixture(spark, sf, "f_visits"), VISIT_NUM)
    return v.select("id", "record_date", F.array_join(F.col("missing_mask").cast("array<string>"), ",").alias("missing_mask"))


_PANEL = tuple(S.panel_split_ctes())


@register("trimmed_stats", oracle(
    "SELECT feature, mean, std, median FROM st", ("f_patients", "f_visits"),
    ctes=_PANEL + (("tr", "SELECT * FROM f_visits WHERE id IN (SELECT id FROM psplit WHERE split = 'train')"),)
    + tuple(S.trimmed_stats_ctes("tr", PANEL_FEATURES)), dbl=("mean", "std", "median")))
def q_trimmed_stats(spark, sf):
    return panel.stats_long(panel_stats(spark, sf), PANEL_FEATURES).select("feature", "mean", "std", "median")


@register("default_fill", oracle(
    "SELECT feature, default_fill FROM st", ("f_patients", "f_visits"),
    ctes=_PANEL + (("tr", "SELECT * FROM f_visits WHERE id IN (SELECT id FROM psplit WHERE split = 'train')"),)
    + tuple(S.trimmed_stats_ctes("tr", PANEL_FEATURES)), dbl=("default_fill",)))
def q_default_fill(spark, sf):
    return panel.stats_long(panel_stats(spark, sf), PANEL_FEATURES).select("feature", "default_fill")


_PANEL_ALL = tuple(S.panel_ctes())


@register("zscore", oracle("SELECT * FROM zs", ("f_patients", "f_visits"), ctes=_PANEL_ALL,
                           dbl=tuple(PANEL_FEATURES), txt=("record_date",)))
def q_zscore(spark, sf):
    return build_panel(spark, sf, "zscore")


@register("clip_outlier_to_zero", oracle("SELECT * FROM zc", ("f_patients", "f_visits"), ctes=_PANEL_ALL,
                                         dbl=tuple(PANEL_FEATURES), txt=("record_date",)))
def q_clip(spark, sf):
    return build_panel(spark, sf, "clip")


@register("locf_impute", oracle("SELECT * FROM panel", ("f_patients", "f_visits"), ctes=_PANEL_ALL,
                                dbl=tuple(PANEL_FEATURES), txt=("record_date",)))
def q_locf(spark, sf):
    return build_panel(spark, sf, "locf")


@register("last_visit", oracle(
    "SELECT p.id, arg_max(p.record_date, p.record_date) AS record_date, "
    + ", ".join(f"arg_max(p.{c}, p.record_date) AS {c}" for c in PANEL_FEATURES)
    + ", MAX(pt.outcome) AS outcome FROM panel p JOIN f_patients pt ON pt.id = p.id GROUP BY p.id",
    ("f_patients", "f_visits"), ctes=_PANEL_ALL, dbl=tuple(PANEL_FEATURES), txt=("record_date",)))
def q_last_visit(spark, sf):
    p = build_panel(spark, sf, "locf")
    lv = panel.last_visit(p, "id", "record_date", PANEL_FEATURES)
    lab = fixture(spark, sf, "f_patients").select("id", "outcome")
    return lv.join(lab, "id")


_CUST = tuple(S.customer_split_ctes())
_LOS_CTES = _CUST + (
    ("adm", "SELECT *, GREATEST(datediff('day', record_date, discharge_date), 0) AS los FROM f_admissions"),
    ("trl", "SELECT * FROM adm WHERE patient_id IN (SELECT id FROM splits WHERE split = 'train')"),
) + tuple(S.trimmed_stats_ctes("trl", ["los"], "lst")) + (
    ("per", "SELECT patient_id, MAX(CAST(los AS DOUBLE)) AS m FROM trl GROUP BY patient_id"),
    ("pq", "SELECT quantile_cont(m, 0.05) AS p5, quantile_cont(m, 0.95) AS p95 FROM per"),
    ("info", "SELECT mean AS los_mean, std AS los_std, median AS los_median, p95 AS large_los, "
             "(SELECT AVG(m) FROM per WHERE m >= p5 AND m <= p95) * 0.5 AS threshold FROM lst, pq"),
)


def _los_info(spark, sf):
    adm = admissions_los(spark, sf)
    train = splits.split_filter(adm, customer_splits(spark, sf), "patient_id", "train")
    return panel.los_info(train, "patient_id", "los")


@register("los_info", oracle("SELECT * FROM info", ("f_admissions",), ctes=_LOS_CTES,
                             dbl=("los_mean", "los_std", "los_median", "large_los", "threshold")))
def q_los_info(spark, sf):
    return _los_info(spark, sf)


@register("reverse_los", oracle(
    "SELECT record_id, (los - los_mean) / (los_std + 1e-12) AS los_z, "
    "((los - los_mean) / (los_std + 1e-12)) * los_std + los_mean AS los_back FROM adm, info",
    ("f_admissions",), ctes=_LOS_CTES, dbl=("los_z", "los_back")))
def q_reverse_los(spark, sf):
    info = _los_info(spark, sf)
    adm = admissions_los(spark, sf).select("record_id", "los")
    z = panel.los_normalize(adm, info, "los", "los_z")
    return panel.reverse_los(z, info, "los_z", "los_back").select("record_id", "los_z", "los_back")


@register("los_normalize_preds", oracle(
    "SELECT record_id, lab_quantity / 5 AS pred_los, (lab_quantity / 5 - los_mean) / (los_std + 1e-12) AS pred_z "
    "FROM adm, info", ("f_admissions",), ctes=_LOS_CTES, dbl=("pred_los", "pred_z")))
def q_los_normalize_preds(spark, sf):
    info = _los_info(spark, sf)
    adm = admissions_los(spark, sf).select("record_id", (F.col("lab_quantity") / 5).alias("pred_los"))
    return panel.los_normalize(adm, info, "pred_los", "pred_z")

# ---------------------------------------------------------------- splits


@register("first_label_per_id", oracle("SELECT id, label FROM cohort", ("f_admissions",),
                                       ctes=tuple(S.customer_cohort_ctes())))
def q_first_label(spark, sf):
    return customer_cohort(spark, sf)


@register("random_holdout", oracle(
    "SELECT id FROM (SELECT id, ROW_NUMBER() OVER (ORDER BY " + S.sql_hash("id") + ", id) AS rn FROM cohort) "
    "WHERE rn <= 200", ("f_admissions",), ctes=tuple(S.customer_cohort_ctes())))
def q_random_holdout(spark, sf):
    return splits.random_holdout(customer_cohort(spark, sf), 200).where("in_test").select("id")


@register("stratified_holdout", oracle("SELECT id, label FROM s_test WHERE in_test", ("f_admissions",), ctes=_CUST))
def q_stratified_holdout(spark, sf):
    return splits.stratified_holdout(customer_cohort(spark, sf), 200).where("in_test").select("id", "label")


@register("stratified_cap", oracle("SELECT id, label FROM kept", ("f_admissions",), ctes=tuple(S.customer_cap_ctes())))
def q_stratified_cap(spark, sf):
    t = splits.stratified_holdout(customer_cohort(spark, sf), 200)
    pool = t.where(~F.col("in_test")).select("id", "label")
    return splits.stratified_cap(pool, 10000).where("kept").select("id", "label")


@register("stratified_fraction", oracle("SELECT id, label, split FROM splits", ("f_admissions",), ctes=_CUST))
def q_stratified_fraction(spark, sf):
    return customer_splits(spark, sf)


@register("split_filter", oracle(
    "SELECT record_id, patient_id FROM f_admissions WHERE patient_id IN (SELECT id FROM splits WHERE split = 'test')",
    ("f_admissions",), ctes=_CUST))
def q_split_filter(spark, sf):
    adm = fixture(spark, sf, "f_admissions")
    return splits.split_filter(adm, customer_splits(spark, sf), "patient_id", "test").select("record_id", "patient_id")


@register("leakage_check", oracle(
    "SELECT id, COUNT(DISTINCT split) AS n_splits FROM splits GROUP BY id HAVING COUNT(DISTINCT split) > 1",
    ("f_admissions",), ctes=_CUST))
def q_leakage_check(spark, sf):
    return splits.leakage_check(customer_splits(spark, sf))


@register("split_sizes", oracle(
    "SELECT s.split, COUNT(*) AS n_rows, COUNT(DISTINCT a.patient_id) AS n_ids FROM f_admissions a "
    "JOIN splits s ON s.id = a.patient_id GROUP BY s.split", ("f_admissions",), ctes=_CUST))
def q_split_sizes(spark, sf):
    return splits.split_sizes(customer_splits(spark, sf), fixture(spark, sf, "f_admissions"), "patient_id")


_FEW = _CUST + (
    ("tv", "SELECT *, " + S.sql_hash("id", 42, "shot") + " AS _h FROM splits WHERE split <> 'test'"),
    ("few", "SELECT id, label, split FROM splits WHERE split = 'test' UNION ALL "
            "SELECT id, label, split FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY split, label ORDER BY _h, id) AS rn "
            "FROM tv) WHERE rn <= 5"),
)


@register("few_shot", oracle("SELECT * FROM few", ("f_admissions",), ctes=_FEW))
def q_few_shot(spark, sf):
    return splits.few_shot(customer_splits(spark, sf), 5)


@register("epoch_subset", oracle(
    "SELECT epoch, id FROM (SELECT epoch, id, ROW_NUMBER() OVER (PARTITION BY epoch ORDER BY "
    "('0x' || substr(md5('42|epoch|' || CAST(epoch AS VARCHAR) || '|' || CAST(id AS VARCHAR)), 1, 8))::BIGINT, id) AS rn "
    "FROM (SELECT id FROM splits WHERE split = 'train') t, (SELECT CAST(range AS INT) AS epoch FROM range(0, 3)) r) WHERE rn <= 2000",
    ("f_admissions",), ctes=_CUST))
def q_epoch_subset(spark, sf):
    train = customer_splits(spark, sf).where(F.col("split") == "train")
    return splits.epoch_subset(train, epochs=3, size=2000)
