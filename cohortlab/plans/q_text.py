"""Registered queries: sequences, prompts, response parsing, joins (ops 43-50, 52-55, 57-69)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from cohortlab.functions import templates as TPL
from cohortlab.functions.exprs import nested_text, with_global
from cohortlab.operators import joins, prompts, sequences
from cohortlab.plans import sqlparts as S
from cohortlab.plans.common import LAB_FEATURES, build_panel
from cohortlab.plans.registry import oracle, register
from cohortlab.sources.tables import fixture, read_table

_PANEL_ALL = tuple(S.panel_ctes())
_PANEL_FIX = ("f_patients", "f_visits")


def _row_sql(cols, digits=6):
    return "concat_ws(',', " + ", ".join(f"COALESCE(printf('%.{digits}f', {c}), 'null')" for c in cols) + ")"

# ---------------------------------------------------------------- sequences


@register("pack_sequences", oracle(
    "SELECT id, COUNT(*) AS n_visits, string_agg(" + _row_sql(LAB_FEATURES) + ", ';' ORDER BY record_date) AS x_ts "
    "FROM panel GROUP BY id", _PANEL_FIX, ctes=_PANEL_ALL))
def q_pack_sequences(spark, sf):
    p = sequences.pack_sequences(build_panel(spark, sf), "id", "record_date", LAB_FEATURES)
    return p.select("id", F.size("x_ts").cast("bigint").alias("n_visits"), nested_text("x_ts").alias("x_ts"))


_CHUNK = 8
_CHUNK_CTE = ("pchunk", f"SELECT *, CAST(FLOOR((ROW_NUMBER() OVER (PARTITION BY id ORDER BY record_date) - 1) / {_CHUNK}) AS INT) AS chunk FROM panel")


@register("pack_chunks", oracle(
    f"SELECT id, chunk, CAST(chunk * {_CHUNK} AS BIGINT) AS start, CAST(COUNT(*) AS INT) AS n, string_agg(" + _row_sql(LAB_FEATURES)
    + ", ';' ORDER BY record_date) AS x_ts FROM pchunk GROUP BY id, chunk", _PANEL_FIX, ctes=_PANEL_ALL + (_CHUNK_CTE,)))
def q_pack_chunks(spark, sf):
    p = sequences.pack_chunks(build_panel(spark, sf), "id", "record_date", LAB_FEATURES, size=_CHUNK)
    return p.select("id", "chunk", F.col("offset").alias("start"), "n", nested_text("x_ts").alias("x_ts"))


@register("record_time_list", oracle(
    "SELECT id, string_agg(strftime(record_date, '%Y-%m-%d'), ',' ORDER BY record_date) AS record_time "
    "FROM f_visits GROUP BY id", ("f_visits",)))
def q_record_time_list(spark, sf):
    r = sequences.record_time_list(fixture(spark, sf, "f_visits"), "id", "record_date")
    return r.select("id", F.array_join("record_time", ",").alias("record_time"))


@register("first_note", oracle(
    "SELECT source, md5(FIRST(text ORDER BY doc_id) FILTER (WHERE text IS NOT NULL)) AS note_md5, "
    "FIRST(doc_id ORDER BY doc_id) FILTER (WHERE text IS NOT NULL) AS first_doc_id FROM documents GROUP BY source"))
def q_first_note(spark, sf):
    d = read_table(spark, sf, "documents", ["doc_id", "source", "text"])
    n = sequences.first_note(d.withColumn("doc_text", F.struct("doc_id", "text")).withColumn(
        "doc_text", F.when(F.col("text").isNotNull(), F.col("doc_text"))), "source", "doc_id", "doc_text")
    return n.select("source", F.md5(F.col("x_note.text")).alias("note_md5"),
                    F.col("x_note.doc_id").alias("first_doc_id"))


_MASK_COLS = ["sex", "age"] + LAB_FEATURES


@register("assemble_records", oracle(
    "SELECT p.id, p.n_visits, p.x_ts, m.missing_mask, m.record_time, md5(d.text) AS note_md5, pt.outcome AS y_mortality "
    "FROM (SELECT id, COUNT(*) AS n_visits, string_agg(" + _row_sql(LAB_FEATURES) + ", ';' ORDER BY record_date) AS x_ts "
    "FROM panel GROUP BY id) p "
    "LEFT JOIN (SELECT id, string_agg(concat_ws(',', " + ", ".join(f"CAST({c} IS NULL AS INT)" for c in _MASK_COLS)
    + "), ';' ORDER BY record_date) AS missing_mask, string_agg(strftime(record_date, '%Y-%m-%d'), ',' ORDER BY record_date) "
    "AS record_time FROM f_visits GROUP BY id) m ON m.id = p.id "
    "LEFT JOIN documents d ON d.doc_id = p.id LEFT JOIN f_patients pt ON pt.id = p.id", _PANEL_FIX, ctes=_PANEL_ALL))
def q_assemble_records(spark, sf):
    from cohortlab.operators import panel as P
    visits = fixture(spark, sf, "f_visits")
    x = sequences.pack_sequences(build_panel(spark, sf), "id", "record_date", LAB_FEATURES).select(
        "id", F.size("x_ts").cast("bigint").alias("n_visits"), nested_text("x_ts").alias("x_ts"))
    mm = sequences.pack_sequences(P.missing_mask(visits, _MASK_COLS), "id", "record_date", [],
                                  extra=["missing_mask"]).select(
        "id", nested_text("missing_mask", None).alias("missing_mask"),
        F.array_join(F.transform("record_time", lambda t: F.date_format(t, "yyyy-MM-dd")), ",").alias("record_time"))
    note = read_table(spark, sf, "documents", ["doc_id", "text"]).select(
        F.col("doc_id").alias("id"), F.md5("text").alias("note_md5"))
    lab = fixture(spark, sf, "f_patients").select("id", F.col("outcome").alias("y_mortality"))
    return sequences.assemble_records([x, mm, note, lab], "id")


def _padded(spark, sf):
    p = sequences.pack_sequences(build_panel(spark, sf), "id", "record_date", LAB_FEATURES, extra=["error"])
    p = p.withColumn("batch", F.floor(F.col("id") / 32))
    return sequences.pad_sequences(p, "batch", "x_ts", len(LAB_FEATURES))


_PAD_CTES = _PANEL_ALL + (
    ("pk", "SELECT id, CAST(FLOOR(id / 32) AS BIGINT) AS batch, COUNT(*) AS length, "
           "string_agg(" + _row_sql(LAB_FEATURES) + ", ';' ORDER BY record_date) AS x_ts, "
           "LAST(error ORDER BY record_date) AS last_error FROM panel GROUP BY id"),
    ("pb", "SELECT *, MAX(length) OVER (PARTITION BY batch) AS max_len FROM pk"),
)


@register("pad_sequences", oracle(
    "SELECT id, batch, length, max_len, x_ts || repeat(';" + ",".join(["0.000000"] * len(LAB_FEATURES))
    + "', CAST(max_len - length AS BIGINT)) AS padded FROM pb", _PANEL_FIX, ctes=_PAD_CTES))
def q_pad_sequences(spark, sf):
    p = _padded(spark, sf)
    return p.select("id", F.col("batch").cast("bigint").alias("batch"), F.col("length").cast("bigint").alias("length"),
                    F.col("max_len").cast("bigint").alias("max_len"), nested_text("padded").alias("padded"))


@register("length_mask", oracle(
    "SELECT id, repeat('1,', CAST(length AS BIGINT)) || repeat('0,', CAST(max_len - length AS BIGINT)) AS mask "
    "FROM pb", _PANEL_FIX, ctes=_PAD_CTES))
def q_length_mask(spark, sf):
    p = _padded(spark, sf)
    m = sequences.length_mask(F.col("length"), F.col("max_len"))
    return p.select("id", F.concat(F.array_join(F.transform(m, lambda b: b.cast("int").cast("string")), ","),
                                   F.lit(",")).alias("mask"))


@register("last_prediction", oracle("SELECT id, last_error AS last_pred FROM pk", _PANEL_FIX, ctes=_PAD_CTES,
                                    dbl=("last_pred",)))
def q_last_prediction(spark, sf):
    p = _padded(spark, sf)
    steps = F.concat(F.col("error"), F.array_repeat(F.lit(0.0), F.col("max_len") - F.col("length")))
    return p.select("id", sequences.last_prediction(steps, F.col("length")).alias("last_pred"))

# ---------------------------------------------------------------- prompts


_SCALES = {"eye": TPL.GCS_EYE, "motor": TPL.GCS_MOTOR, "verbal": TPL.GCS_VERBAL}


def _decode_sql(scale: dict) -> str:
    return ("CASE WHEN masked THEN 'NaN' ELSE CASE code " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in scale.items())
            + " ELSE 'NaN' END END")


@register("decode_categorical", oracle(
    "SELECT event_id, " + ", ".join(f"{_decode_sql(m)} AS {n}_label" for n, m in _SCALES.items())
    + " FROM (SELECT event_id, CAST(FLOOR(value) AS BIGINT) % 7 AS code, event_type = 'error' AS masked FROM events)"))
def q_decode_categorical(spark, sf):
    """Codes on all three scales; the cells of error events are masked."""
    e = read_table(spark, sf, "events", ["event_id", "event_type", "value"])
    code, masked = F.floor("value").cast("bigint") % 7, F.col("event_type") == "error"
    return e.select("event_id", *[prompts.decode_categorical(code, m, masked).alias(f"{n}_label") for n, m in _SCALES.items()])


UNITS = {"click": "count", "error": "/", "purchase": "USD", "signup": "count", "view_": "count"}
RANGES = {"click": "0 - 50", "error": "/", "purchase": "10 - 90", "signup": "/", "view_": "0 - 100"}


def _lookup(spark):
    rows = [(f, UNITS[f], RANGES[f]) for f in LAB_FEATURES]
    return prompts.feature_lookup(spark.createDataFrame(rows, "feature string, unit string, range string"))


def _sql_vals(f, unit=None):
    v = f"COALESCE(CAST({f} AS VARCHAR), 'NaN')"
    return f"({v} || ' {unit}')" if unit else v


_LIST_SQL = "concat_ws(chr(10), " + ", ".join(
    f"'- {f} (Unit: {UNITS[f]}. Reference Range: {RANGES[f]}.): [' || string_agg({_sql_vals(f)}, ', ' ORDER BY record_date) || ']'"
    for f in LAB_FEATURES) + ")"


def _text_sql_feature(f):
    u = UNITS[f]
    lst = f"list({_sql_vals(f, u if u != '/' else None)} ORDER BY record_date)"
    return (f"'The feature `{f}` has ' || CAST(COUNT(*) AS VARCHAR) || CASE WHEN COUNT(*) > 1 THEN ' visits' ELSE ' visit' END "
            f"|| ' of values ' || CASE WHEN COUNT(*) > 1 THEN array_to_string(list_slice({lst}, 1, COUNT(*) - 1), ', ') "
            f"|| ' and ' || {lst}[-1] ELSE {lst}[-1] END || "
            + (f"', with a reference range of {RANGES[f]}.'" if RANGES[f] != "/" else "'.'"))


_TEXT_SQL = "concat_ws(' ', " + ", ".join(_text_sql_feature(f) for f in LAB_FEATURES) + ")"


def _visits(spark, sf):
    v = fixture(spark, sf, "f_visits")
    return with_global(prompts.patient_visits(v, "id", "record_date", ["sex", "age"] + LAB_FEATURES), _lookup(spark))


@register("format_features_list", oracle(f"SELECT id, {_LIST_SQL} AS detail FROM f_visits GROUP BY id", ("f_visits",)))
def q_format_list(spark, sf):
    v = _visits(spark, sf)
    return v.select("id", prompts.format_features_list(F.col("visits"), LAB_FEATURES, F.col("units"), F.col("ranges")).alias("detail"))


@register("format_features_text", oracle(f"SELECT id, {_TEXT_SQL} AS detail FROM f_visits GROUP BY id", ("f_visits",)))
def q_format_text(spark, sf):
    v = _visits(spark, sf)
    return v.select("id", prompts.format_features_text(F.col("visits"), LAB_FEATURES, F.col("units"), F.col("ranges")).alias("detail"))


def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_fill(template: str, values: dict[str, str]) -> str:
    parts = re.split(r"\{([A-Z_]+)\}", template)
    out = []
    for i, p in enumerate(parts):
        if i % 2 == 0:
            if p:
                out.append(_sql_lit(p))
        else:
            out.append(f"COALESCE(CAST({values[p]} AS VARCHAR), '')")
    return " || ".join(out)


_PROMPT_VALUES = {
    "LENGTH": "COUNT(*)",
    "RECORD_TIME_LIST": "string_agg(strftime(record_date, '%Y-%m-%d'), ', ' ORDER BY record_date)",
    "SEX": "CASE WHEN FIRST(sex ORDER BY record_date) = 1 THEN 'male' ELSE 'female' END",
    "AGE": "FIRST(age ORDER BY record_date)",
    "TASK_DESCRIPTION": _sql_lit(TPL.TASK_DESCRIPTION["mortality"]),
    "RESPONSE_FORMAT": _sql_lit(TPL.RESPONSE_FORMAT_MORTALITY),
    "EXAMPLE": "''",
    "DETAIL": _LIST_SQL,
}


@register("build_prompt", oracle(
    f"SELECT id, {_sql_fill(TPL.USER_PROMPT, _PROMPT_VALUES)} AS user_prompt FROM f_visits GROUP BY id", ("f_visits",)))
def q_build_prompt(spark, sf):
    v = _visits(spark, sf)
    detail = prompts.format_features_list(F.col("visits"), LAB_FEATURES, F.col("units"), F.col("ranges"))
    return v.select("id", prompts.build_prompt(F.col("visits"), "record_date", detail, TPL.USER_PROMPT,
                                               TPL.TASK_DESCRIPTION["mortality"], TPL.RESPONSE_FORMAT_MORTALITY,
                                               "").alias("user_prompt"))


_TASKS = [("mimic-iv", "mortality"), ("mimic-iv", "readmission"), ("tjh", "los")]


def _task_prompt_sql(dataset, task, n_shot):
    values = {**_PROMPT_VALUES, "TASK_DESCRIPTION": _sql_lit(TPL.TASK_DESCRIPTION[task]),
              "RESPONSE_FORMAT": _sql_lit(TPL.RESPONSE_FORMAT[task]), "DETAIL": _TEXT_SQL if n_shot else _LIST_SQL,
              "EXAMPLE": _sql_lit(TPL.EXAMPLE[dataset][task].strip()) if n_shot else "''"}
    return (f"SELECT id, '{dataset}' AS dataset, '{task}' AS task, {n_shot} AS n_shot, md5({_sql_fill(TPL.USER_PROMPT, values)}) AS prompt_md5 "
            "FROM f_visits GROUP BY id")


@register("build_prompt_tasks", oracle(" UNION ALL ".join(_task_prompt_sql(d, t, n) for d, t in _TASKS for n in (0, 1)), ("f_visits",)))
def q_build_prompt_tasks(spark, sf):
    """Op 60 for every task, without and with its example (then with details as sentences)."""
    v = _visits(spark, sf)
    args = [F.col("visits"), LAB_FEATURES, F.col("units"), F.col("ranges")]
    detail = [prompts.format_features_list(*args), prompts.format_features_text(*args)]
    one = [F.struct(F.lit(d).alias("dataset"), F.lit(t).alias("task"), F.lit(n).alias("n_shot"),
                    F.md5(prompts.build_prompt(F.col("visits"), "record_date", detail[n], TPL.USER_PROMPT, TPL.TASK_DESCRIPTION[t],
                                               TPL.RESPONSE_FORMAT[t], TPL.EXAMPLE[d][t] if n else "")).alias("prompt_md5"))
           for d, t in _TASKS for n in (0, 1)]
    return v.select("id", F.inline(F.array(*one)))


_NOTE_DS = "CASE WHEN lang = 'en' THEN 'mimic-iv' ELSE 'mimic-iii' END"


@register("build_note_prompt", oracle(
    f"SELECT doc_id AS id, {_sql_lit(TPL.NOTE_INSTRUCTION_MORTALITY + chr(10) + chr(10))} || "
    f"CASE WHEN lang = 'en' THEN {_sql_lit(TPL.NOTE_HEADER['mimic-iv'])} ELSE {_sql_lit(TPL.NOTE_HEADER['mimic-iii'])} END "
    f"|| text AS user_prompt FROM documents"))
def q_build_note_prompt(spark, sf):
    d = read_table(spark, sf, "documents", ["doc_id", "lang", "text"])
    ds = F.when(F.col("lang") == "en", F.lit("mimic-iv")).otherwise(F.lit("mimic-iii"))
    return d.select(F.col("doc_id").alias("id"),
                    prompts.build_note_prompt(F.col("text"), ds, TPL.NOTE_INSTRUCTION_MORTALITY).alias("user_prompt"))


_TRUNC_SQL = "array_to_string(list_slice(regexp_extract_all(text, '\\S+'), 1, 512), ' ')"


_MM_VALUES = {**_PROMPT_VALUES, "NOTE": "FIRST(nt)", "TASK_DESCRIPTION": _sql_lit(TPL.MM_TASK_DESCRIPTION["mortality"]),
              "RESPONSE_FORMAT": _sql_lit(TPL.MM_RESPONSE_FORMAT["mortality"])}


@register("build_multimodal_prompt", oracle(
    "SELECT v.id, o.ord AS note_order, CASE WHEN o.ord = 'note_first' THEN v.pn ELSE v.pe END AS user_prompt "
    "FROM (SELECT id, " + _sql_fill(TPL.USER_PROMPT_NOTE_FIRST, _MM_VALUES) + " AS pn, "
    + _sql_fill(TPL.USER_PROMPT_EHR_FIRST, _MM_VALUES) + " AS pe "
    "FROM (SELECT f.*, d.text AS nt FROM f_visits f JOIN documents d ON d.doc_id = f.id) "
    "GROUP BY id) v, (VALUES ('note_first'), ('ehr_first')) o(ord)", ("f_visits",)))
def q_build_multimodal_prompt(spark, sf):
    docs = read_table(spark, sf, "documents", ["doc_id", "text"]).select(F.col("doc_id").alias("id"), F.col("text").alias("nt"))
    rec = _visits(spark, sf).join(docs, "id")
    detail = prompts.format_features_list(F.col("visits"), LAB_FEATURES, F.col("units"), F.col("ranges"))
    rec = rec.withColumn("note_order", F.explode(F.array(F.lit("note_first"), F.lit("ehr_first"))))

    def mk(t):
        return prompts.build_prompt(F.col("visits"), "record_date", detail, t, TPL.MM_TASK_DESCRIPTION["mortality"],
                                    TPL.MM_RESPONSE_FORMAT["mortality"], "", extra={"NOTE": F.col("nt")})
    return rec.select("id", "note_order", F.when(F.col("note_order") == "note_first", mk(TPL.USER_PROMPT_NOTE_FIRST))
                      .otherwise(mk(TPL.USER_PROMPT_EHR_FIRST)).alias("user_prompt"))


@register("truncate_note", oracle(
    f"SELECT doc_id AS id, {_TRUNC_SQL} AS note, LEAST(len(regexp_extract_all(text, '\\S+')), 512) AS n_tokens FROM documents"))
def q_truncate_note(spark, sf):
    d = read_table(spark, sf, "documents", ["doc_id", "text"])
    return d.select(F.col("doc_id").alias("id"), prompts.truncate_note(F.col("text"), 512).alias("note"),
                    F.least(F.size(prompts.tokens(F.col("text"))), F.lit(512)).cast("bigint").alias("n_tokens"))


@register("task_prefix", oracle(
    "SELECT doc_id AS id, 'Predict patient mortality based on the following clinical note: ' || text AS text FROM documents"))
def q_task_prefix(spark, sf):
    d = read_table(spark, sf, "documents", ["doc_id", "text"])
    return d.select(F.col("doc_id").alias("id"), prompts.task_prefix(F.col("text"), "mortality").alias("text"))


# ---------------------------------------------------------------- grid, setting names

_DT = [("mimic-iv", "mortality"), ("mimic-iv", "readmission"), ("mimic-iv", "los"),
       ("tjh", "mortality"), ("tjh", "readmission"), ("tjh", "los")]
_VALID = {"readmission": {"mimic-iv"}, "los": {"tjh"}}
_SETTINGS = [dict(n_shot=n, unit=u, rng=r, fmt=f) for n in (0, 1) for u in (False, True) for r in (False, True)
             for f in ("list", "text")]
_GRID_SQL = (
    "SELECT m.model, p.dataset, p.task, s.n_shot, s.unit, s.rng, s.fmt FROM (SELECT DISTINCT model FROM f_preds) m, "
    "(VALUES ('mimic-iv', 'mortality'), ('mimic-iv', 'readmission'), ('tjh', 'mortality'), ('tjh', 'los')) p(dataset, task), "
    "(SELECT CAST(n AS INT) AS n_shot, u AS unit, r AS rng, f AS fmt FROM (VALUES (0), (1)) a(n), (VALUES (false), (true)) b(u), "
    "(VALUES (false), (true)) c(r), (VALUES ('list'), ('text')) d(f)) s")


def _grid(spark, sf):
    models = fixture(spark, sf, "f_preds").select("model").distinct()
    g = joins.experiment_grid(models, _DT, _VALID, _SETTINGS)
    return g.withColumn("n_shot", F.col("n_shot").cast("int"))


@register("experiment_grid", oracle(_GRID_SQL, ("f_preds",)))
def q_experiment_grid(spark, sf):
    return _grid(spark, sf)


@register("setting_name", oracle(
    "SELECT model, dataset, task, CAST(n_shot AS VARCHAR) || 'shot' || CASE WHEN unit THEN '_unit' ELSE '' END || "
    "CASE WHEN rng THEN '_range' ELSE '' END || '_' || fmt AS setting FROM (" + _GRID_SQL + ")", ("f_preds",)))
def q_setting_name(spark, sf):
    g = _grid(spark, sf)
    return g.select("model", "dataset", "task",
                    prompts.setting_name(F.col("n_shot"), F.col("unit"), F.col("rng"), F.col("fmt")).alias("setting"))

# ---------------------------------------------------------------- responses


def _parsed(spark, sf):
    return prompts.parse_response(fixture(spark, sf, "f_responses"), "response")


@register("parse_response", oracle("SELECT id, think, pred, status FROM parsed", ("f_responses",),
                                   ctes=(("parsed", S.PARSE_SQL),), dbl=("pred",)))
def q_parse_response(spark, sf):
    return _parsed(spark, sf).select("id", "think", "pred", "status")


@register("clamp_invalid_pred", oracle(
    "SELECT id, CASE WHEN pred < 0 THEN 0.501 ELSE pred END AS pred_binary, CASE WHEN pred < 0 THEN 0.0 ELSE pred END "
    "AS pred_los, pred AS pred_note FROM parsed", ("f_responses",), ctes=(("parsed", S.PARSE_SQL),),
    dbl=("pred_binary", "pred_los", "pred_note")))
def q_clamp(spark, sf):
    p = _parsed(spark, sf)
    return p.select("id", prompts.clamp_invalid_pred(F.col("pred"), "mortality").alias("pred_binary"),
                    prompts.clamp_invalid_pred(F.col("pred"), "los").alias("pred_los"), F.col("pred").alias("pred_note"))


@register("label_pick", oracle(
    "SELECT patient_id AS id, FIRST(outcome ORDER BY record_date, record_id) AS first_label, "
    "LAST(outcome ORDER BY record_date, record_id) AS last_label FROM f_admissions GROUP BY patient_id", ("f_admissions",)))
def q_label_pick(spark, sf):
    a = fixture(spark, sf, "f_admissions")
    return prompts.first_last_label(a, "patient_id", ["record_date", "record_id"], "outcome").withColumnRenamed(
        "patient_id", "id")


@register("token_usage", oracle(
    "SELECT conv_id, CAST(SUM(CASE WHEN role = 'user' THEN len(regexp_extract_all(text, '\\S+')) ELSE 0 END) AS BIGINT) "
    "AS prompt_tokens, CAST(SUM(CASE WHEN role = 'assistant' THEN len(regexp_extract_all(text, '\\S+')) ELSE 0 END) "
    "AS BIGINT) AS completion_tokens "
    "FROM conversations GROUP BY conv_id"))
def q_token_usage(spark, sf):
    c = read_table(spark, sf, "conversations", ["conv_id", "role", "text"])
    return prompts.token_usage(c, ["conv_id"], "role", "text").select(
        "conv_id", F.col("prompt_tokens").cast("bigint").alias("prompt_tokens"),
        F.col("completion_tokens").cast("bigint").alias("completion_tokens"))

# ---------------------------------------------------------------- joins


@register("join_lookup", oracle(
    "SELECT c.c_custkey AS id, COALESCE(n.n_name, CAST(c.c_nationkey AS VARCHAR)) AS nation, "
    "COALESCE(CASE WHEN r.r_regionkey IS NOT NULL THEN r.r_name END, 'unknown') AS region "
    "FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey"))
def q_join_lookup(spark, sf):
    c = read_table(spark, sf, "customer", ["c_custkey", "c_nationkey"])
    n = read_table(spark, sf, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    r = read_table(spark, sf, "region", ["r_regionkey", "r_name"])
    # dimension lookups are combined first, so the fact side is joined once
    dim = joins.join_lookup(n, r, "n_regionkey", "r_regionkey", "r_name", "region").select(
        "n_nationkey", "n_name", F.when(F.col("n_regionkey").isNull(), F.lit("unknown")).otherwise(F.col("region"))
        .alias("region"))
    j = c.join(dim, c["c_nationkey"] == dim["n_nationkey"], "left")
    return j.select(F.col("c_custkey").alias("id"),
                    F.coalesce(F.col("n_name"), F.col("c_nationkey").cast("string")).alias("nation"),
                    F.coalesce(F.col("region"), F.lit("unknown")).alias("region"))


@register("append_results", oracle(
    "SELECT 'scored ' || model AS modality, id, pred, CAST(label AS INT) AS label, NULL::VARCHAR AS status FROM f_preds "
    "UNION ALL SELECT 'generated', id, pred, NULL::INT, status FROM parsed", ("f_preds", "f_responses"),
    ctes=(("parsed", S.PARSE_SQL),), dbl=("pred",)))
def q_append_results(spark, sf):
    a = fixture(spark, sf, "f_preds").select(
        F.concat(F.lit("scored "), F.col("model")).alias("modality"), "id", "pred", F.col("label").cast("int").alias("label"))
    b = _parsed(spark, sf).select(F.lit("generated").alias("modality"), "id", "pred", "status")
    return joins.append_results([a, b])


@register("join_modalities", oracle(
    "SELECT id, sqrt(list_sum(list_transform(e1, lambda x: CAST(x AS DOUBLE) * x))) AS ehr_norm, "
    "sqrt(list_sum(list_transform(e2, lambda x: CAST(x AS DOUBLE) * x))) AS note_norm, score AS label FROM f_pairs",
    ("f_pairs",), dbl=("ehr_norm", "note_norm", "label")))
def q_join_modalities(spark, sf):
    pairs = fixture(spark, sf, "f_pairs")

    def norm(c):
        return F.sqrt(F.aggregate(F.transform(c, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0),
                                  lambda a, b: a + b))
    ehr = pairs.select("id", norm(F.col("e1")).alias("ehr_norm"))
    note = pairs.select("id", norm(F.col("e2")).alias("note_norm"))
    lab = pairs.select("id", F.col("score").alias("label"))
    return joins.join_modalities(joins.require_equal_counts(ehr, note, lab), note, lab)
