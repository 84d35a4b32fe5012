"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.session import scratch_dir

SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    The written table cuts the lineage: it is on shared storage, so a lost
    executor costs a re-read only.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished jobs (it follows the driver's garbage)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def row_hash(col: str = "text") -> Column:
    """With ``doc_id`` it names a row: rows equal in both are the same document twice."""
    return F.xxhash64(text_or_empty(col))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does the same to pure ASCII text, and faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """``(node, label)`` for every node of ``edges(a, b)``; label = smallest node reachable.

    Rounds of "smallest label among the neighbours", then "label of the label",
    until nothing changes. Every step is a grouped aggregate or a join, and each
    round is written to the shared folder. Nothing is collected but one count.
    """
    both = written(
        edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b"), F.col("a"))).distinct(),
        f"{name}-edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m"))
                     .select(F.col("a").alias("node"), F.least("a", "m").alias("label")), f"{name}-labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("nl")), "b")
                .groupBy("a").agg(F.min("nl").alias("nl")))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("hl"))
        step = (labels.join(hop, "label", "left")
                .join(near.withColumnRenamed("a", "node"), "node", "left")
                .select("node", F.least("label", "hl", "nl").alias("new"), "label"))
        step = written(step, f"{name}-round")
        changed = step.where("new <> label").limit(1).count()
        labels = step.select("node", F.col("new").alias("label"))
        if not changed:
            return labels
