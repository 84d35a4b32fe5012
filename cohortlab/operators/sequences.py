"""Family D: packed per-patient records, padding and masks (ops 43-50).

Packing is one ``groupBy(id)`` with ``collect_list`` of structs sorted by time:
a group is one patient's record, so its size is bounded by that record. ``pack_chunks`` cuts
records at a number of visits, so that no row and no task holds a whole long record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.exprs import join_null_safe
from cohortlab.functions.ordered import ordered_cumsum


def pack_sequences(df: DataFrame, id_col: str, time_col: str, features: list[str],
                   labels: list[str] | None = None, extra: list[str] | None = None) -> DataFrame:
    """Op 43: per id, visits in time order as ``x_ts`` (array of feature arrays),
    ``record_time`` (array of times) and one array per label column."""
    labels, extra = labels or [], extra or []
    v = F.struct(F.col(time_col).alias("t"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"),
                 *[F.col(c).alias(c) for c in labels + extra])
    g = df.groupBy(id_col).agg(F.array_sort(F.collect_list(v)).alias("_v"))
    out = [F.col(id_col), F.transform("_v", lambda s: s["x"]).alias("x_ts"),
           F.transform("_v", lambda s: s["t"]).alias("record_time")]
    def field(c):
        return F.transform("_v", lambda s: s[c])
    out += [field(c).alias(f"y_{c}" if c in labels else c) for c in labels + extra]
    return g.select(*out)


def visit_positions(df: DataFrame, id_col: str, time_col: str, ties: list[str], out: str = "position") -> DataFrame:
    """0-based place of each visit in its id's time order (equal times by ``ties``), without sorting a long record in one
    task: running counts of the id's distinct times, and places within one time."""
    when = F.unix_micros(F.col(time_col).cast("timestamp"))
    d = df.withColumn("_t", when)
    per = d.where("_t IS NOT NULL").groupBy(id_col, "_t").agg(F.count("*").alias("_n"))
    before = ordered_cumsum(per, [id_col], "_t", ["_n"]).select(id_col, "_t", (F.col("_n_cum") - F.col("_n")).cast("long").alias("_before"))
    within = F.row_number().over(Window.partitionBy(id_col, "_t").orderBy(*ties)) - 1 if ties else (
        F.row_number().over(Window.partitionBy(id_col, "_t").orderBy("_t")) - 1)
    placed = join_null_safe(d, before, [id_col, "_t"], "left")  # visits without a time come first, as in a sorted array
    first = d.where("_t IS NULL").groupBy(id_col).agg(F.count("*").alias("_untimed"))
    placed = join_null_safe(placed, first, [id_col], "left")
    shift = F.when(F.col("_t").isNull(), F.lit(0)).otherwise(F.coalesce("_untimed", F.lit(0)) + F.col("_before"))
    return placed.withColumn(out, (shift + within).cast("long")).drop("_t", "_before", "_untimed")


def pack_chunks(df: DataFrame, id_col: str, time_col: str, features: list[str], labels: list[str] | None = None,
                extra: list[str] | None = None, size: int = 256) -> DataFrame:
    """Ops 43, 46 in bounded records: ``(id, chunk, offset, n, x_ts, record_time, ...)`` with at most ``size`` visits each.

    The columns are those of ``pack_sequences``; an id's chunks in order, one behind the other, are its record there.
    """
    labels, extra = labels or [], extra or []
    placed = visit_positions(df, id_col, time_col, [*features, *labels, *extra])
    v = F.struct(F.col("position"), F.col(time_col).alias("t"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"),
                 *[F.col(c).alias(c) for c in labels + extra])
    g = (placed.groupBy(id_col, F.floor(F.col("position") / size).cast("int").alias("chunk"))
         .agg(F.array_sort(F.collect_list(v)).alias("_v")))

    def field(c):
        return F.transform("_v", lambda s: s[c])
    return g.select(id_col, "chunk", (F.col("chunk").cast("long") * size).alias("offset"), F.size("_v").alias("n"), field("x").alias("x_ts"),
                    field("t").alias("record_time"), *[field(c).alias(f"y_{c}" if c in labels else c) for c in labels + extra])


def pad_chunks(chunks: DataFrame, id_col: str, batch_col: str, width: int, size: int = 256) -> DataFrame:
    """Op 48 over chunks (with the ``batch_col`` of their id): every id gets the chunks of its batch's longest record.

    ``(id, batch, chunk, length, max_len, padded, mask)``: zero vectors behind the id's own visits, ``mask`` tells them apart.
    """
    length = chunks.groupBy(id_col, batch_col).agg(F.sum("n").alias("length"))
    longest = length.groupBy(batch_col).agg(F.max("length").alias("max_len"))
    every = (join_null_safe(length, longest, [batch_col])
             .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.ceil(F.col("max_len") / size).cast("int") - 1))))
    d = join_null_safe(every, chunks.select(id_col, "chunk", "n", "x_ts"), [id_col, "chunk"], "left")
    own, all_ = F.coalesce("n", F.lit(0)), F.least(F.lit(size), F.col("max_len") - F.col("chunk") * size).cast("int")
    zero = F.array_repeat(F.lit(0.0), width)
    return d.select(id_col, batch_col, "chunk", "length", "max_len",
                    F.concat(F.coalesce("x_ts", F.array().cast("array<array<double>>")), F.array_repeat(zero, all_ - own)).alias("padded"),
                    F.transform(F.sequence(F.lit(0), all_ - 1), lambda i: i < own).alias("mask"))


def record_time_list(df: DataFrame, id_col: str, time_col: str) -> DataFrame:
    """Op 44: time-ordered ``yyyy-MM-dd`` list per id."""
    return df.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.col(time_col))),
                                              lambda t: F.date_format(t, "yyyy-MM-dd")).alias("record_time"))


def first_note(df: DataFrame, id_col: str, time_col: str, note_col: str, tiebreak: str | None = None) -> DataFrame:
    """Op 45: first non-null note of each id in time order."""
    order = F.struct(F.col(time_col), F.col(tiebreak)) if tiebreak else F.col(time_col)
    return df.groupBy(id_col).agg(
        F.min_by(F.col(note_col), F.when(F.col(note_col).isNotNull(), order)).alias("x_note"))


def assemble_records(parts: list[DataFrame], id_col: str = "id") -> DataFrame:
    """Op 46: combine per-id pieces by joining on the id (never by position)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, id_col, "left")
    return out


def pad_sequences(df: DataFrame, batch_col: str, seq_col: str, width: int, out: str = "padded") -> DataFrame:
    """Op 48: pad every sequence to its batch's longest with zero vectors; keep the true length."""
    w = Window.partitionBy(batch_col)
    zero = F.array_repeat(F.lit(0.0), width)
    d = df.withColumn("length", F.size(seq_col)).withColumn("max_len", F.max("length").over(w))
    return d.withColumn(out, F.concat(F.col(seq_col), F.array_repeat(zero, F.col("max_len") - F.col("length"))))


def length_mask(length: Column, max_len: Column) -> Column:
    """Op 49: boolean mask ``position < length`` for positions 0..max_len-1."""
    return F.when(max_len > 0, F.transform(F.sequence(F.lit(0), max_len - 1), lambda i: i < length)) \
            .otherwise(F.array().cast("array<boolean>"))


def last_prediction(values: Column, length: Column) -> Column:
    """Op 50: value at the last valid step of a padded per-step sequence."""
    return F.element_at(F.slice(values, 1, length), -1)
