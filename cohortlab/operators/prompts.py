"""Family E: prompt tables and response parsing (ops 57-69), all built-in string,
array and JSON expressions (no Python UDF)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.functions.exprs import py_float_text
from cohortlab.functions.jsonscan import json_spans
from cohortlab.functions.templates import DEFAULT_BINARY_PRED, NOTE_HEADER, TASK_PREFIX

RESPONSE_SCHEMA = T.StructType([T.StructField("think", T.StringType()), T.StructField("answer", T.StringType())])
TOKEN_PATTERN = r"\S+"


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """Replace ``{NAME}`` placeholders by column values (null -> empty)."""
    parts = re.split(r"\{([A-Z_]+)\}", template)
    cols = []
    for i, p in enumerate(parts):
        if i % 2 == 0:
            if p:
                cols.append(F.lit(p))
        else:
            cols.append(F.coalesce(values[p].cast("string"), F.lit("")))
    return F.concat(*cols)


def decode_categorical(code: Column, mapping: dict[int, str], masked: Column | None = None) -> Column:
    """Op 57: code -> label; unknown code or masked cell -> 'NaN'."""
    m = F.create_map(*[x for k, v in sorted(mapping.items()) for x in (F.lit(k), F.lit(v))])
    out = F.coalesce(F.try_element_at(m, code.cast("int")), F.lit("NaN"))
    return F.when(masked, F.lit("NaN")).otherwise(out) if masked is not None else out


def patient_visits(visits: DataFrame, id_col: str, time_col: str, cols: list[str]) -> DataFrame:
    """Time-ordered visit structs per patient (bounded by one patient's record)."""
    return visits.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct(time_col, *cols))).alias("visits"))


def feature_lookup(lookup: DataFrame) -> DataFrame:
    """Units and reference ranges of a table ``(feature, unit, range)`` as one row of two maps
    (one entry per feature of the data dictionary); null cells are left out."""
    def entries(c: str) -> Column:
        return F.map_from_entries(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("feature", c)))).alias(f"{c}s")
    return lookup.agg(entries("unit"), entries("range"))


def _value_texts(visits: Column, feature: str) -> Column:
    return F.transform(visits, lambda v: F.coalesce(py_float_text(v[feature]), F.lit("NaN")))


def _known(lookup: Column | None, feature: str) -> Column:
    return F.lit(None).cast("string") if lookup is None else F.try_element_at(lookup, F.lit(feature))


def format_features_list(visits: Column, features: list[str], units: Column | None = None,
                         ranges: Column | None = None) -> Column:
    """Op 58: one line per feature ``- f (Unit: u. Reference Range: r.): [v1, v2]``; ``units`` and
    ``ranges`` are maps by feature, and what they don't hold is left out."""
    def line(f: str) -> Column:
        notes = F.concat_ws(" ", F.concat(F.lit("Unit: "), _known(units, f), F.lit(".")),
                            F.concat(F.lit("Reference Range: "), _known(ranges, f), F.lit(".")))
        name = F.concat_ws(" ", F.lit(f"- {f}"), F.when(notes != "", F.concat(F.lit("("), notes, F.lit(")"))))
        return F.concat(name, F.lit(": ["), F.array_join(_value_texts(visits, f), ", "), F.lit("]"))
    return F.concat_ws("\n", *[line(f) for f in features])


def format_features_text(visits: Column, features: list[str], units: Column | None = None,
                         ranges: Column | None = None) -> Column:
    """Op 59: a sentence per feature, ``The feature `f` has n visits of values a, b and c u, with a
    reference range of r.``; '/' in the lookup stands for none."""
    def sentence(f: str) -> Column:
        unit, span = (F.nullif(_known(m, f), F.lit("/")) for m in (units, ranges))
        values = F.transform(_value_texts(visits, f), lambda t: F.concat_ws(" ", t, unit))
        n = F.size(values)
        listed = F.concat_ws(" and ", F.nullif(F.array_join(F.slice(values, 1, n - 1), ", "), F.lit("")), F.element_at(values, -1))
        head = F.concat(F.lit(f"The feature `{f}` has "), n.cast("string"), F.when(n > 1, F.lit(" visits")).otherwise(F.lit(" visit")))
        return F.concat(F.concat_ws(", with a reference range of ", F.concat(head, F.lit(" of values "), listed), span), F.lit("."))
    return F.concat_ws(" ", *[sentence(f) for f in features])


def record_time_text(visits: Column, time_field: str, sep: str = ", ") -> Column:
    """``yyyy-MM-dd`` visit dates in time order."""
    return F.array_join(F.transform(visits, lambda v: F.date_format(v[time_field], "yyyy-MM-dd")), sep)


def build_prompt(visits: Column, time_field: str, detail: Column, template: str, task_description: str,
                 response_format: str, example: str = "", sex_field: str = "sex", age_field: str = "age",
                 extra: dict[str, Column] | None = None) -> Column:
    """Op 60/62: fill a user-prompt template from a patient's visit array."""
    first = F.element_at(visits, 1)
    values = {
        "LENGTH": F.size(visits), "RECORD_TIME_LIST": record_time_text(visits, time_field),
        "SEX": F.when(first[sex_field] == 1, F.lit("male")).otherwise(F.lit("female")),
        "AGE": first[age_field], "TASK_DESCRIPTION": F.lit(task_description),
        "RESPONSE_FORMAT": F.lit(response_format), "EXAMPLE": F.lit(example.strip()), "DETAIL": detail,
    }
    values.update(extra or {})
    return fill_template(template, values)


def build_note_prompt(note: Column, dataset: Column, instruction: str) -> Column:
    """Op 61: instruction, blank line, dataset-specific note header, note."""
    header = F.when(dataset == "mimic-iv", F.lit(NOTE_HEADER["mimic-iv"])).when(
        dataset == "mimic-iii", F.lit(NOTE_HEADER["mimic-iii"]))
    return F.concat(F.lit(instruction.strip() + "\n\n"), header, note)


def tokens(text: Column) -> Column:
    """Whitespace tokens of a text (the stand-in for a model tokenizer)."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), 0)


def truncate_note(text: Column, max_tokens: int = 512) -> Column:
    """Op 63: first ``max_tokens`` whitespace tokens, re-joined by single spaces."""
    return F.array_join(F.slice(tokens(text), 1, max_tokens), " ")


def task_prefix(note: Column, task: str) -> Column:
    """Op 64: prepend the fine-tuning task sentence."""
    return F.concat(F.lit(TASK_PREFIX.replace("{TASK}", task)), note)


def setting_name(n_shot: Column, unit: Column, rng: Column, fmt: Column, order: Column | None = None) -> Column:
    """Op 65: ``{n}shot[_unit][_range]_{format}[_{order}]``."""
    parts = [n_shot.cast("string"), F.lit("shot"), F.when(unit, F.lit("_unit")).otherwise(F.lit("")),
             F.when(rng, F.lit("_range")).otherwise(F.lit("")), F.lit("_"), fmt]
    if order is not None:
        parts.append(F.when(order.isNotNull(), F.concat(F.lit("_"), order)).otherwise(F.lit("")))
    return F.concat(*parts)


def parse_response(df: DataFrame, text_col: str = "response") -> DataFrame:
    """Op 66: pull ``think`` and ``answer`` out of a free-text reply.

    What stands before a closing ``</think>`` tag is set aside. Then the JSON is taken
    from the text around it (prose, code fences, closed or not): a list of objects
    yields its last one; else the span from the first ``{`` to the last ``}``; if that is
    no JSON, the last flat object; where none of them has both keys, the last complete JSON value that has
    (``json_spans``: nested objects, several in a reply, broken ones between). Both keys are required
    (else status 'failed', no pred); a non-numeric answer gives pred -1.
    """
    text = F.regexp_replace(F.col(text_col), r"(?s)^.*</think>", "")
    many = F.regexp_extract(text, r"(?s)\[\s*\{.*\}\s*\]", 0)
    one, tail = F.regexp_extract(text, r"(?s)\{.*\}", 0), F.regexp_extract(text, r"(?s)^.*(\{[^{}]*\})", 1)

    def alone(body: Column, kind: T.DataType) -> Column:
        """The parsed body, null unless it is one JSON value and nothing else."""
        boxed = F.from_json(F.concat(F.lit("["), body, F.lit("]")), T.ArrayType(kind))
        return F.when((body != "") & (F.size(boxed) == 1), F.get(boxed, F.lit(0)))
    listed = (many != "") & (F.position(many, text) < F.instr(text, "{"))
    obj = F.when(listed, F.element_at(alone(many, T.ArrayType(RESPONSE_SCHEMA)), -1)).otherwise(
        F.coalesce(alone(one, RESPONSE_SCHEMA), alone(tail, RESPONSE_SCHEMA)))
    full = lambda r: r["think"].isNotNull() & r["answer"].isNotNull()
    scanned = F.transform(json_spans(text), lambda s: F.when(s.startswith("["), F.try_element_at(F.from_json(s, T.ArrayType(RESPONSE_SCHEMA)), F.lit(-1)))
                          .otherwise(F.from_json(s, RESPONSE_SCHEMA)))
    d = df.withColumn("_r", obj)
    # the scanner reads a reply character by character: only where the patterns found nothing
    d = d.withColumn("_r", F.when(full(F.col("_r")), F.col("_r")).when(text.contains("{"), F.try_element_at(F.filter(scanned, full), F.lit(-1))))
    ok = F.col("_r.think").isNotNull() & F.col("_r.answer").isNotNull()
    return d.select(*df.columns, F.when(ok, F.col("_r.think")).alias("think"),
                    F.when(ok, F.coalesce(F.col("_r.answer").try_cast("double"), F.lit(-1.0))).alias("pred"),
                    F.when(ok, F.lit("ok")).otherwise(F.lit("failed")).alias("status"))


def clamp_invalid_pred(pred: Column, task: str) -> Column:
    """Op 67: negative pred -> 0.501 (binary tasks) or 0.0 (LOS); null stays null."""
    repl = F.lit(0.0) if task == "los" else F.lit(DEFAULT_BINARY_PRED)
    return F.when(pred < 0, repl).otherwise(pred)


def label_pick(labels: Column, last: bool = True) -> Column:
    """Op 68: label of the last (or first) visit."""
    return F.element_at(labels, -1 if last else 1)


def first_last_label(df: DataFrame, id_col: str, order: list[str], label: str) -> DataFrame:
    """Op 68 as an aggregate: first and last label per id in ``order`` (partial
    aggregation, so an id with very many rows is combined map-side)."""
    o = F.struct(*[F.col(c) for c in order])
    return df.groupBy(id_col).agg(F.min_by(F.col(label), o).alias("first_label"),
                                  F.max_by(F.col(label), o).alias("last_label"))


def token_usage(df: DataFrame, run_cols: list[str], role_col: str, text_col: str,
                prompt_role: str = "user", completion_role: str = "assistant") -> DataFrame:
    """Op 69: prompt and completion token totals per run (whitespace tokens)."""
    n = F.size(tokens(F.col(text_col)))
    return df.groupBy(*run_cols).agg(
        F.sum(F.when(F.col(role_col) == prompt_role, n).otherwise(0)).alias("prompt_tokens"),
        F.sum(F.when(F.col(role_col) == completion_role, n).otherwise(0)).alias("completion_tokens"))
