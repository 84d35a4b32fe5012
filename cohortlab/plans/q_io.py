"""Registered queries: sources, sinks, incremental skip and streaming ingest
(ops 3-8, 110, 112, 113). Each writes to a fresh folder under the shared
checkpoint root and reads the written table back."""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.functions import templates as TPL
from cohortlab.operators import metrics, prompts
from cohortlab.plans import sqlparts as S
from cohortlab.plans.common import admissions_los, customer_splits
from cohortlab.plans.q_eval import _CONF_SQL
from cohortlab.plans.registry import oracle, register
from cohortlab.session import scratch_dir
from cohortlab.sources import io
from cohortlab.sources.tables import fixture, read_table
from cohortlab.streaming.ingest import ingest_available

RUN = "structured/mimic-iv/mortality/m/0shot_list"


@register("read_fixed_width", oracle("SELECT code, title FROM f_codes WHERE len(code) <= 4", ("f_codes",)))
def q_read_fixed_width(spark, sf):
    path = scratch_dir(spark, "codes")
    io.write_fixed_width(fixture(spark, sf, "f_codes"), path, "id", "code", "title", volumes=True)
    return io.read_fixed_width(spark, path)


def _response_records(spark, sf):
    parsed = prompts.parse_response(fixture(spark, sf, "f_responses"), "response")
    return parsed.select(F.lit(RUN).alias("run"), "id", F.lit(TPL.SYSTEM_PROMPT["mimic-iv"]).alias("system_prompt"),
                         "response", F.when(F.col("status") == "ok", F.col("think")).alias("think"),
                         prompts.clamp_invalid_pred(F.col("pred"), "mortality").alias("pred"),
                         F.lit(None).cast("double").alias("label"))


@register("read_response_json", oracle(
    "SELECT d.doc_id AS id, COALESCE(CASE WHEN p.pred < 0 THEN 0.501 ELSE p.pred END, 0.501) AS pred, p.think "
    "FROM documents d LEFT JOIN parsed p ON p.id = d.doc_id", ("f_responses",), ctes=(("parsed", S.PARSE_SQL),),
    dbl=("pred",)))
def q_read_response_json(spark, sf):
    path = scratch_dir(spark, "responses")
    io.write_response_json(_response_records(spark, sf), path)
    res = io.read_response_json(spark, path)
    ids = read_table(spark, sf, "documents", ["doc_id"]).select(F.col("doc_id").alias("id"))
    j = ids.join(res.select("id", "pred", "think"), "id", "left")
    return j.select("id", F.coalesce("pred", F.lit(TPL.DEFAULT_BINARY_PRED)).alias("pred"), "think")


@register("write_parquet", oracle(
    "SELECT record_id, patient_id, GREATEST(datediff('day', record_date, discharge_date), 0) AS los FROM f_admissions",
    ("f_admissions",)))
def q_write_parquet(spark, sf):
    path = scratch_dir(spark, "cohort")
    io.write_parquet(admissions_los(spark, sf).select("record_id", "patient_id", "los"), path)
    return spark.read.parquet(path)


@register("write_split_tables", oracle(
    "SELECT a.record_id, a.patient_id, s.split FROM f_admissions a JOIN splits s ON s.id = a.patient_id",
    ("f_admissions",), ctes=tuple(S.customer_split_ctes())))
def q_write_split_tables(spark, sf):
    path = scratch_dir(spark, "splits")
    adm = fixture(spark, sf, "f_admissions").select("record_id", "patient_id")
    sp = customer_splits(spark, sf).select(F.col("id").alias("patient_id"), "split")
    io.write_parquet(adm.join(sp, "patient_id"), path, ["split"])
    return spark.read.parquet(path).select("record_id", "patient_id", "split")


@register("write_metric_csv", oracle(_CONF_SQL.format(src="f_preds"), ("f_preds",),
                                     dbl=("accuracy", "precision", "recall", "f1")))
def q_write_metric_csv(spark, sf):
    path = scratch_dir(spark, "metrics")
    io.write_metric_csv(metrics.confusion_metrics(fixture(spark, sf, "f_preds"), ["model"]), path)
    schema = "model string, accuracy double, precision double, recall double, f1 double"
    return spark.read.option("header", True).schema(schema).csv(path)


@register("write_prompts", oracle(
    "SELECT CASE WHEN lang = 'en' THEN 'mimic-iv' ELSE 'mimic-iii' END AS run, doc_id AS id, "
    "md5('" + TPL.NOTE_INSTRUCTION_MORTALITY.replace("'", "''") + "' || chr(10) || chr(10) || "
    "CASE WHEN lang = 'en' THEN 'Discharge Summary Note:' || chr(10) ELSE 'Admission Summary Note:' || chr(10) END || text) "
    "AS prompt_md5, md5('" + TPL.NOTE_SYSTEM_PROMPT.replace("'", "''") + "') AS system_md5 FROM documents"))
def q_write_prompts(spark, sf):
    path = scratch_dir(spark, "prompts")
    d = read_table(spark, sf, "documents", ["doc_id", "lang", "text"])
    ds = F.when(F.col("lang") == "en", F.lit("mimic-iv")).otherwise(F.lit("mimic-iii"))
    t = d.select(ds.alias("run"), F.col("doc_id").alias("id"), F.lit(TPL.NOTE_SYSTEM_PROMPT).alias("system_prompt"),
                 prompts.build_note_prompt(F.col("text"), ds, TPL.NOTE_INSTRUCTION_MORTALITY).alias("user_prompt"))
    io.write_parquet(t, path, ["run"])
    return spark.read.parquet(path).select("run", "id", F.md5("user_prompt").alias("prompt_md5"),
                                           F.md5("system_prompt").alias("system_md5"))


@register("write_run_summary", oracle(
    "SELECT model, COUNT(*) AS n, CAST(SUM(label) AS BIGINT) AS n_pos, AVG(pred) AS mean_pred FROM f_preds GROUP BY model",
    ("f_preds",), dbl=("mean_pred",)))
def q_write_run_summary(spark, sf):
    path = scratch_dir(spark, "runs")
    s = io.run_summary(fixture(spark, sf, "f_preds"), ["model"])
    s.write.mode("overwrite").json(path)
    return spark.read.schema("model string, n long, n_pos long, mean_pred double").json(path)


def _run_configs(spark, sf):
    """One row per run of f_preds: what its predictions were made with."""
    return fixture(spark, sf, "f_preds").groupBy("model").agg(F.count_distinct("pred").alias("n_scores"), F.min("id").alias("first_id"))


@register("run_records", oracle("SELECT model, id, pred, CAST(label AS DOUBLE) AS label FROM f_preds", ("f_preds",), dbl=("pred",)))
def q_run_records(spark, sf):
    path = scratch_dir(spark, "run-records")
    io.write_run_records(fixture(spark, sf, "f_preds"), _run_configs(spark, sf), path, ["model"])
    return io.read_run_records(spark, path, ["model"])


@register("run_manifest", oracle(
    "SELECT model, COUNT(DISTINCT pred) AS n_scores, MIN(id) AS first_id, COUNT(*) AS n, CAST(SUM(label) AS BIGINT) AS n_pos, "
    "AVG(pred) AS mean_pred, true AS bounded FROM f_preds GROUP BY model", ("f_preds",), dbl=("mean_pred",)))
def q_run_manifest(spark, sf):
    path = scratch_dir(spark, "run-records")
    io.write_run_records(fixture(spark, sf, "f_preds"), _run_configs(spark, sf), path, ["model"], chunk=500)
    m = io.read_run_manifest(spark, path)
    return m.select("model", "n_scores", "first_id", "n", "n_pos", "mean_pred", (F.col("largest_chunk") <= 500).alias("bounded"))


@register("incremental_skip", oracle("SELECT id FROM f_responses WHERE id NOT IN (SELECT id FROM f_codes)", ("f_responses", "f_codes")))
def q_incremental_skip(spark, sf):
    """Done is what an earlier run left in its result folder, whatever it says: only its id column is read."""
    path = scratch_dir(spark, "results")
    io.write_parquet(fixture(spark, sf, "f_codes").select(F.lit(RUN).alias("run"), "id", F.col("title").alias("response")), path, ["run"])
    todo = fixture(spark, sf, "f_responses").select("id")
    return io.incremental_skip(todo, spark.read.parquet(path), ["id"])


@register("stream_response_ingest", oracle(
    f"SELECT '{RUN}' AS run, id, think, pred, status FROM parsed", ("f_responses",),
    ctes=(("parsed", S.PARSE_SQL),), dbl=("pred",)))
def q_stream_ingest(spark, sf):
    root = scratch_dir(spark, "stream")
    src = os.path.join(root, "in")
    raw = fixture(spark, sf, "f_responses").select(F.lit(RUN).alias("run"), "id", "response",
                                                   F.lit(None).cast("double").alias("label"),
                                                   F.current_timestamp().alias("received_at"))
    # two deliveries of the same responses, the second one late and to a stream with another checkpoint:
    # every (run, id) must be there once, as it came first
    raw.write.mode("append").json(src)
    ingest_available(spark, src, os.path.join(root, "out"), os.path.join(root, "ckpt"))
    raw.withColumn("received_at", F.lit("2001-01-01").cast("timestamp")).write.mode("append").json(src)
    out = ingest_available(spark, src, os.path.join(root, "out"), os.path.join(root, "ckpt-renewed"))
    return out.select("run", "id", "think", "pred", "status")
