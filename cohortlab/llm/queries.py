"""Registered queries of this subpackage: production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlab.llm import (decontaminate, filter_audit, fingerprints, html_extract, language_id, line_runs, ngram_jaccard, oracles, pii, piece_codec,
                           quality, token_align, token_counts, unit_dedup)
from cohortlab.llm.common import read_table


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.report(read_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(read_table(spark, sf_dir, "documents"))


def op5_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_dedup.report(read_table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read_table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.drop("rid")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.report(read_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.report(read_table(spark, sf_dir, "documents"))


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(read_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.report(read_table(spark, sf_dir, "documents"))


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.report(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_quality": op3_quality,
    "op4_fingerprints": op4_fingerprints,
    "op5_unit_dedup": op5_unit_dedup,
    "op6_pii": op6_pii,
    "op7_decontaminate": op7_decontaminate,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_piece_codec": op10_piece_codec,
    "op11_filter_audit": op11_filter_audit,
    "op12_language_id": op12_language_id,
    "op13_token_align": op13_token_align,
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(oracles.SQL)
