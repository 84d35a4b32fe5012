"""Line dedup over levelled sorted runs of line digests (operator 8, native).

A *run* is a Parquet table ``(key, n_docs, max_doc)`` sorted by the line's digest:
in how many documents of its batches the line occurs, and the largest ``doc_id``
holding it. Batches come in descending ``doc_id`` order. Each batch is merge-anti-joined
with the runs' settled lines (already in ``min_docs`` documents, so its fate is known)
and adds the rest as a run of its own at level 0; when a level holds ``fanout`` runs,
they are merged into one run of the next level.

Defined results: null and empty text is one empty line. Rows that share a ``doc_id``
are one document when lines are counted; each row is filtered by itself. A row without
``doc_id`` is no document: it is counted nowhere and keeps all its lines. Extra columns
are not read (query) or passed through untouched (``dedup_documents``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm.common import SPACES, ascii_lower, row_hash, text_or_empty, written


class LineRuns:
    """The levelled store. ``levels[i]`` lists the runs (written tables) of level i."""

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout, self.levels = spark, fanout, []

    def merged(self) -> DataFrame | None:
        """All runs as one table with one row a key (not written)."""
        runs = [r for level in self.levels for r in level]
        return _merge(runs) if runs else None

    def unseen(self, batch: DataFrame, min_docs: int = 1) -> DataFrame:
        """Merge-anti-join: the batch's keys that the runs don't yet hold ``min_docs`` times."""
        seen = self.merged()
        if seen is None:
            return batch
        return batch.join(seen.where(F.col("n_docs") >= min_docs).select("key").hint("merge"), "key", "left_anti")

    def add(self, batch: DataFrame, settled: int) -> None:
        """Add what of ``batch(key, n_docs, max_doc)`` isn't settled as a sorted run; compact."""
        self._put(0, _sorted_run(self.unseen(batch, settled), "run0"))

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._put(level + 1, _sorted_run(_merge(runs), f"run{level + 1}"))


def _merge(runs: list[DataFrame]) -> DataFrame:
    if len(runs) == 1:
        return runs[0]
    return (reduce(DataFrame.unionByName, runs).groupBy("key")
            .agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc")))


def _sorted_run(df: DataFrame, name: str) -> DataFrame:
    return written(df.select("key", "n_docs", "max_doc").sortWithinPartitions("key"), f"lines-{name}")


def long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(doc_id, rid, pos, key)`` of every line whose key has ``min_chars`` code points or more."""
    lines = (docs.where("doc_id IS NOT NULL")
             .select("doc_id", row_hash().alias("rid"), F.posexplode(F.split(text_or_empty(), "\n", -1)).alias("pos", "line"))
             .where(F.char_length("line") >= min_chars)
             .withColumn("line", F.btrim("line", F.lit(SPACES)))
             .where(F.char_length("line") >= min_chars))
    return lines.select("doc_id", "rid", "pos", F.unhex(F.md5(ascii_lower(F.col("line")))).alias("key"))


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4,
                  fanout: int = 3) -> DataFrame:
    """``(doc_id, rid, drops)``: positions of the lines that each document row loses."""
    spark = docs.sparkSession
    lines = written(long_lines(docs, min_chars), "lines")
    cuts = lines.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0]
    edges = [None, *sorted(set(cuts or []), reverse=True), None]
    store = LineRuns(spark, fanout)
    for upper, lower in zip(edges[:-1], edges[1:]):  # descending ranges of doc_id
        part = lines
        if upper is not None:
            part = part.where(F.col("doc_id") <= upper)
        if lower is not None:
            part = part.where(F.col("doc_id") > lower)
        store.add(part.groupBy("key").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("max_doc")),
                  min_docs)
    heavy = store.merged().where(F.col("n_docs") >= min_docs).select("key", "max_doc")
    return (lines.join(heavy, (lines["key"] == heavy["key"]) & (F.col("doc_id") < F.col("max_doc")), "left_semi")
            .groupBy("doc_id", "rid").agg(F.collect_set("pos").alias("drops")))


def kept_text(docs: DataFrame, **params) -> DataFrame:
    """``(row, n_lines, n_dropped, kept)`` of each row of ``docs``; ``row`` holds its columns."""
    drops = dropped_lines(docs, **params)
    rows = docs.select("doc_id", row_hash().alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    cut = (rows.join(drops, ["doc_id", "rid"], "left")
           .select("row", F.split(F.coalesce(F.col("row.text"), F.lit("")), "\n", -1).alias("parts"),
                   F.coalesce("drops", F.array().cast("array<int>")).alias("drops")))
    left = F.array_except(F.transform("parts", lambda _, i: i), F.col("drops"))
    return cut.select("row", F.size("parts").cast("long").alias("n_lines"), F.size("drops").cast("long").alias("n_dropped"),
                      F.array_join(F.transform(left, lambda i: F.get("parts", i)), "\n").alias("kept"))


def dedup_documents(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with each text cut to its kept lines; ``n_chars`` follows where there is one."""
    out = kept_text(docs, **params)
    new = {"text": F.when(F.col("row.text").isNotNull(), F.col("kept"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("kept").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def report(docs: DataFrame, **params) -> DataFrame:
    """The query's digest columns."""
    return kept_text(docs.select("doc_id", "text"), **params).select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
