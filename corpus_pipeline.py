"""From raw documents to token counts: five stages, each one of the numbered operators.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns
a DataFrame. Its rows are written as Parquet and read again as the next one's ``docs``.
All but the last return the columns of ``docs``.

1. quality classifier: documents that it rejects go;
2. line dedup: lines found in three documents stay in the one with the largest doc_id;
3. n-gram Jaccard join: of each group of near copies the smallest doc_id stays;
4. benchmark decontamination: documents that hold a window of an item go;
5. SentencePiece: ids and decoded text of what is left, as counts and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlab.llm import decontaminate, line_runs, ngram_jaccard, piece_codec, quality
from cohortlab.llm.common import read_table, written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_runs.dedup_documents(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_jaccard.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def token_digests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_codec.digests(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", one_of_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("SentencePiece encoding and decoding", token_digests),
]

#: SQL can neither train the classifier nor encode: tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0]}", "zstd")
    return STAGES[-1][1](spark, docs, sf_dir)
