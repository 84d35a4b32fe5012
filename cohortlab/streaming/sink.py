"""A keyed, idempotent sink: rows taken once per key, however often and wherever from they are delivered.

Layout below one folder of shared storage::

    log/<token>/     one JSON row per commit: what became visible, and what it replaces
    runs/<token>/    its rows as Parquet, partitioned by ``bucket`` (hash of the key)

A *delivery* appends a run of its own and reads nothing of the sink. Its token names the stream
(the id that Structured Streaming keeps in the checkpoint) and the micro-batch, so a retry finds its own commit and does
nothing, a killed attempt without a commit is overwritten by the next, and another checkpoint is another
stream: it can't touch what is there. A run is visible once its log row is, and that is one small file.

Repeated keys are settled by commit order: the first delivery wins. That is done when rows are read and when runs are
merged: ``fanout`` runs of a level become one run of the next with one row per key, so a
row is rewritten a logarithmic number of times, a reader meets at most ``fanout`` runs per level, and the keys that a
delivery reads do not grow with the sink (there are none). ``lookup`` reads only the buckets of the asked keys.

One writer at a time; readers can run beside it. Merged runs stay until ``vacuum`` empties them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_RECORD = T.StructType([
    T.StructField("token", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("level", T.IntegerType()),
    T.StructField("buckets", T.IntegerType()), T.StructField("replaces", T.ArrayType(T.StringType()))])


@dataclass(frozen=True)
class Commit:
    token: str
    seq: int
    level: int


class KeyedSink:
    """The sink at ``path`` for rows of ``schema`` with one row per ``keys`` (null equals null)."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int = 64, fanout: int = 8):
        self.spark, self.path, self.keys, self.fanout = spark, path, keys, fanout
        self.schema = schema
        self.stored = T.StructType([*schema.fields, T.StructField("_seq", T.LongType()), T.StructField("bucket", T.IntegerType())])
        start = spark.createDataFrame([("start", 0, -1, buckets, [])], LOG_RECORD)
        start.coalesce(1).write.mode("ignore").json(f"{path}/log/start")  # the number of buckets is the first writer's
        found = [r.buckets for r in self._log() if r.token == "start"]
        if not found:  # a first writer died between the folder and its row: nothing was committed behind it
            start.coalesce(1).write.mode("overwrite").json(f"{path}/log/start")
        self.buckets = found[0] if found else buckets

    # --- the log ------------------------------------------------------------------
    def _log(self):
        """Every commit: one row per delivery or merge, of a few words each."""
        return (self.spark.read.schema(LOG_RECORD).option("recursiveFileLookup", "true").json(f"{self.path}/log")
                .where("token IS NOT NULL").collect())

    def commits(self) -> list[Commit]:
        """The visible runs, oldest first."""
        log = self._log()
        gone = {t for r in log for t in r.replaces}
        return sorted((Commit(r.token, r.seq, r.level) for r in log if r.level >= 0 and r.token not in gone), key=lambda c: (c.seq, c.token))

    def _publish(self, token: str, seq: int, level: int, replaces: list[str]) -> None:
        row = self.spark.createDataFrame([(token, seq, level, self.buckets, replaces)], LOG_RECORD)
        row.coalesce(1).write.mode("overwrite").json(f"{self.path}/log/{token}")

    # --- writing ------------------------------------------------------------------
    def bucket_of(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, token: str) -> None:
        out = rows.select(*self.schema.fieldNames(), "_seq", self.bucket_of().alias("bucket"))
        out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/runs/{token}")

    def deliver(self, rows: DataFrame, token: str) -> bool:
        """Commit ``rows`` (one per key) as the delivery ``token``; False if that delivery is there already."""
        log = self._log()
        if any(r.token == token for r in log):
            return False
        seq = max(r.seq for r in log) + 1
        self._write(rows.withColumn("_seq", F.lit(seq).cast("long")), token)
        self._publish(token, seq, 0, [])
        self._compact()
        return True

    def _compact(self) -> None:
        """Merge full levels, the lowest first."""
        level = 0
        while True:
            runs = [c for c in self.commits() if c.level == level]
            if len(runs) < self.fanout:
                if level >= max((c.level for c in self.commits()), default=0):
                    return
                level += 1
                continue
            names, last = [c.token for c in runs], runs[-1].seq
            token = f"merge-{level + 1}-{runs[0].seq}-{last}"
            self._write(self._first_of(self._rows(runs)), token)
            self._publish(token, last, level + 1, names)

    def vacuum(self) -> int:
        """Empty the runs that merges have replaced (when no reader of an older state is left); their number."""
        gone = [t for r in self._log() for t in r.replaces]
        nothing = self.spark.createDataFrame([], self.stored).drop("bucket")
        for token in gone:
            nothing.write.mode("overwrite").parquet(f"{self.path}/runs/{token}")
        return len(gone)

    # --- reading ------------------------------------------------------------------
    def _rows(self, runs: list[Commit]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.stored)
        # each run is a table of its own: its folder is where partition columns begin
        parts = [self.spark.read.schema(self.stored).parquet(f"{self.path}/runs/{c.token}") for c in runs]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _first_of(self, rows: DataFrame) -> DataFrame:
        """One row per key: the earliest delivery's."""
        others = [n for n in self.schema.fieldNames() if n not in self.keys]
        first = rows.groupBy(*self.keys).agg(F.min(F.struct("_seq", *others)).alias("_r"))
        return first.select(*[F.col(n) if n in self.keys else F.col(f"_r.{n}").alias(n) for n in self.schema.fieldNames()], "_r._seq")

    def read(self) -> DataFrame:
        """Every key once, as first delivered."""
        return self._first_of(self._rows(self.commits())).drop("_seq")

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The sink's rows for the keys of ``wanted``, reading the buckets of those keys only."""
        keys = wanted.select(*self.keys).distinct()
        touched = [r.b for r in keys.select(self.bucket_of().alias("b")).distinct().collect()]  # at most `buckets` numbers
        rows = self._rows(self.commits()).where(F.col("bucket").isin(touched)) if touched else self._rows([])
        renamed = keys.withColumnsRenamed({k: f"_w_{k}" for k in self.keys})
        on = [F.col(k).eqNullSafe(F.col(f"_w_{k}")) for k in self.keys]
        return self._first_of(rows.join(renamed, on, "left_semi")).drop("_seq")
