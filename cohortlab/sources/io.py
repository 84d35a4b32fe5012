"""Sources and sinks: fixed-width code files, response JSON, parquet/CSV sinks,
incremental skip (ops 3-8, 112, 113).

Writes go to folders the caller names (on a cluster: shared storage); results
are partitioned by run instead of one file per patient.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.functions.exprs import join_null_safe

# Column slices of the code order file (0-based [start, end)).
CODE_FILE_SLICES = {"order": (0, 6), "code": (6, 14), "flag": (14, 16), "short_title": (16, 77), "title": (77, None)}
MAX_CODE_LEN = 4
ORDERS_PER_VOLUME = 1_000_000  # orders have six digits

RESPONSE_RECORD = T.StructType([
    T.StructField("run", T.StringType()), T.StructField("id", T.LongType()),
    T.StructField("system_prompt", T.StringType()), T.StructField("user_prompt", T.StringType()),
    T.StructField("response", T.StringType()), T.StructField("think", T.StringType()),
    T.StructField("pred", T.DoubleType()), T.StructField("label", T.DoubleType()),
])


def read_fixed_width(spark: SparkSession, path: str, max_code_len: int = MAX_CODE_LEN) -> DataFrame:
    """Op 3: slice each line at fixed offsets, trim, keep codes of length <= max."""
    line = F.col("value")

    def cut(name):
        s, e = CODE_FILE_SLICES[name]
        return F.trim(F.substring(line, s + 1, (e - s) if e is not None else 1 << 20))
    d = spark.read.text(path).select(cut("code").alias("code"), cut("title").alias("title"))
    return d.where(F.length("code") <= max_code_len)


def write_fixed_width(df: DataFrame, path: str, order: str, code: str, title: str, flag: str | None = None,
                      volumes: bool = False) -> None:
    """Writer of the same layout (used to stage code files for op 3). Fields that don't fit fail the job:
    an order of over 6 digits, a code of over 8 or a flag of over 2 characters.

    ``volumes``: whole numbers of any size are orders; each million goes to a folder ``volume=<order div 1000000>`` of its own,
    with the last six digits as order in the line. Readers of ``path`` get the lines of all volumes."""
    def fits(c, width: int, name: str):
        return F.when(F.length(c) <= width, c).otherwise(F.raise_error(F.concat(F.lit(f"{name} too long: "), c)))
    f = fits(F.col(flag).cast("string"), 2, "flag") if flag else F.lit("0")
    within = F.pmod(F.col(order).cast("long"), F.lit(ORDERS_PER_VOLUME)) if volumes else F.col(order)
    number = fits(within.cast("string"), 6, "order")
    number = F.when(F.length(number) < 5, F.lpad(number, 5, "0")).otherwise(number)
    line = F.concat(F.rpad(number, 6, " "), F.rpad(fits(F.col(code), 8, "code"), 8, " "),
                    F.rpad(f, 2, " "), F.rpad(F.substring(F.col(title), 1, 60), 61, " "), F.col(title))
    if not volumes:
        return df.select(line.alias("value")).write.mode("overwrite").text(path)
    volume = F.round((F.col(order).cast("long") - within) / ORDERS_PER_VOLUME).cast("long")
    df.select(line.alias("value"), volume.alias("volume")).write.mode("overwrite").partitionBy("volume").text(path)


def read_response_json(spark: SparkSession, path: str) -> DataFrame:
    """Op 4: response records with optional fields, read with an explicit schema
    (absent ``think``/``pred`` come back as null)."""
    return spark.read.schema(RESPONSE_RECORD).json(path)


def write_response_json(df: DataFrame, path: str) -> None:
    """Response records as JSON lines partitioned by run (null fields omitted)."""
    df.write.mode("overwrite").partitionBy("run").json(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Ops 5, 6, 112: parquet sink, optionally partitioned (e.g. by split or run)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_metric_csv(df: DataFrame, path: str) -> None:
    """Op 7: metric table as CSV with a header (metric tables are small: one file)."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def run_summary(preds: DataFrame, run_cols: list[str], pred: str = "pred", label: str = "label") -> DataFrame:
    """Op 113: one record per run (count, positives, mean prediction); the
    predictions themselves stay rows partitioned by run, never one array."""
    return preds.groupBy(*run_cols).agg(F.count(F.lit(1)).alias("n"),
                                        F.sum(F.col(label).cast("long")).alias("n_pos"),
                                        F.avg(F.col(pred).cast("double")).alias("mean_pred"))


def write_run_records(preds: DataFrame, configs: DataFrame, path: str, run_cols: list[str], id_col: str = "id",
                      pred: str = "pred", label: str = "label", chunk: int = 1_000) -> None:
    """Op 113: each run's config, predictions and labels as records of at most ``chunk`` rows, and a manifest.

    ``chunks/`` holds ``(run_cols, chunk, ids, preds, labels)``; a run's rows are dealt by hash of the id, so no task
    gets a whole run, and cut to the bound. ``manifest/`` holds one row per run: its columns of ``configs``,
    counts, mean prediction and the number of chunks a reader must find.
    """
    rows = preds.select(*run_cols, F.col(id_col).alias("id"), F.col(pred).cast("double").alias("pred"), F.col(label).cast("double").alias("label"))
    sizes = rows.groupBy(*run_cols).agg(F.count("*").alias("_n"))
    deal = F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") * 2 / chunk).cast("long"))  # about half full: few are cut again
    dealt = join_null_safe(rows, sizes, run_cols).withColumn("_part", deal)
    w = Window.partitionBy(*run_cols, "_part").orderBy("id", "pred", "label")
    cut = dealt.withColumn("_piece", F.floor((F.row_number().over(w) - 1) / chunk))
    one = F.struct("id", "pred", "label")
    packed = cut.groupBy(*run_cols, "_part", "_piece").agg(F.array_sort(F.collect_list(one)).alias("_r"))
    packed.select(*run_cols, F.concat_ws("-", "_part", "_piece").alias("chunk"), F.size("_r").alias("n"), F.col("_r.id").alias("ids"),
                  F.col("_r.pred").alias("preds"), F.col("_r.label").alias("labels")).write.mode("overwrite").parquet(f"{path}/chunks")
    chunks = preds.sparkSession.read.parquet(f"{path}/chunks")
    total = chunks.groupBy(*run_cols).agg(
        F.sum("n").alias("n"), F.sum(F.aggregate("labels", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))).cast("long").alias("n_pos"),
        (F.sum(F.aggregate("preds", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))))
         / F.sum(F.size(F.filter("preds", lambda x: x.isNotNull())))).alias("mean_pred"),
        F.count("*").alias("n_chunks"), F.max("n").alias("largest_chunk"))
    join_null_safe(configs, total, run_cols, "left").write.mode("overwrite").parquet(f"{path}/manifest")


def read_run_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest")


def read_run_records(spark: SparkSession, path: str, run_cols: list[str]) -> DataFrame:
    """Op 113: ``(run_cols, id, pred, label)`` of all runs; fails if a run's chunks are not those of its manifest."""
    chunks, manifest = spark.read.parquet(f"{path}/chunks"), read_run_manifest(spark, path)
    there = chunks.groupBy(*run_cols).agg(F.count("*").alias("_chunks"), F.sum("n").alias("_rows"))
    whole = join_null_safe(manifest.select(*run_cols, "n", "n_chunks"), there, run_cols, "left")
    same = F.col("_chunks").eqNullSafe(F.col("n_chunks")) & F.col("_rows").eqNullSafe(F.col("n"))
    sure = whole.select(*run_cols, F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("chunks of a run are missing"))).alias("_sure"))
    rows = join_null_safe(chunks, sure, run_cols).where("_sure")
    return rows.select(*run_cols, F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("preds").alias("pred"), F.col("labels").alias("label"))))


def incremental_skip(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Op 8: rows whose result already exists, whatever it says, are skipped (anti join)."""
    return todo.join(done.select(*keys), keys, "left_anti")
