"""Column-expression helpers shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS_STD = 1e-12  # z-score epsilon


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """pandas treats NaN as missing; Spark treats it as a value. Normalise to null."""
    c = col(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def safe_div(num, den, default: float = 0.0) -> Column:
    """num / den with division by zero (or null) mapped to ``default``."""
    return F.coalesce(F.try_divide(col(num), col(den)), F.lit(float(default)))


def hash_order(id_col, seed: int = 42, salt: str | None = None) -> Column:
    """Deterministic 32-bit draw order of an id: first 8 hex digits of md5(seed|[salt|]id).

    The same number is computable in any SQL engine with md5, so splits and
    samples are reproducible outside Spark.
    """
    prefix = f"{seed}|" if salt is None else f"{seed}|{salt}|"
    digest = F.md5(F.concat(F.lit(prefix), col(id_col).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def fmt_num(c, digits: int = 2) -> Column:
    """Fixed-point text of a number; null stays null."""
    c = col(c)
    return F.when(c.isNull(), F.lit(None)).otherwise(F.format_string(f"%.{digits}f", c))


def array_text(c, digits: int | None = 6, sep: str = ",") -> Column:
    """Array -> text for stable comparison (numbers fixed-point, null -> 'null')."""
    def one(x):
        if digits is None:
            return F.coalesce(x.cast("string"), F.lit("null"))
        return F.coalesce(F.format_string(f"%.{digits}f", x), F.lit("null"))
    return F.array_join(F.transform(col(c), lambda x: F.when(x.isNull(), F.lit("null")).otherwise(one(x))), sep)


def nested_text(c, digits: int | None = 6) -> Column:
    """array<array<number>> -> 'a,b;c,d'."""
    def row(r):
        def one(x):
            if digits is None:
                return x.cast("string")
            return F.format_string(f"%.{digits}f", x)
        return F.array_join(F.transform(r, lambda x: F.when(x.isNull(), F.lit("null")).otherwise(one(x))), ",")
    return F.array_join(F.transform(col(c), row), ";")


def common_prefix_len(a, b) -> Column:
    """Length of the longest common prefix of two strings (no UDF).

    Counts leading positions i where every position <= i matches, via a fold
    over 1..min(len) that stops growing at the first mismatch.
    """
    a, b = col(a), col(b)
    n = F.least(F.length(a), F.length(b))
    idx = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    folded = F.aggregate(
        idx,
        F.struct(F.lit(0).alias("len"), F.lit(True).alias("ok")),
        lambda acc, i: F.struct(
            F.when(acc["ok"] & (F.substring(a, i, 1) == F.substring(b, i, 1)) & (i <= n),
                   acc["len"] + 1).otherwise(acc["len"]).alias("len"),
            (acc["ok"] & (F.substring(a, i, 1) == F.substring(b, i, 1)) & (i <= n)).alias("ok"),
        ),
    )
    return folded["len"]


def py_float_text(c) -> Column:
    """Shortest round-trip text of a double, written the way Python's ``str`` does.

    Spark's cast gives the same digits but switches to ``1.0E-4`` style outside
    [1e-3, 1e7); this rewrites those cases to Python's layout ('0.0001',
    '10000000.0', '1e-05', '1e+16').
    """
    c = col(c).cast("double")
    s = c.cast("string")
    mant = F.substring_index(s, "E", 1)
    exp = F.substring_index(s, "E", -1).cast("int")
    neg = mant.startswith("-")
    m = F.regexp_replace(mant, "^-", "")
    digits = F.regexp_replace(F.regexp_replace(m, r"\.", ""), "0+$", "")
    digits = F.when(digits == "", F.lit("0")).otherwise(digits)
    nd = F.length(digits)
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits)
    big = F.when(nd <= exp + 1, F.concat(digits, F.repeat(F.lit("0"), exp + 1 - nd), F.lit(".0"))) \
           .otherwise(F.concat(F.substring(digits, 1, exp + 1), F.lit("."), F.substring(digits, exp + 2, 1 << 20)))
    sci_m = F.when(nd == 1, digits).otherwise(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 1 << 20)))
    sci = F.concat(sci_m, F.lit("e"), F.format_string("%+03d", exp))
    body = F.when((exp >= -4) & (exp <= -1), small).when((exp >= 7) & (exp <= 15), big).otherwise(sci)
    body = F.concat(F.when(neg, F.lit("-")).otherwise(F.lit("")), body)
    return (F.when(c.isNull(), F.lit(None)).when(F.isnan(c), F.lit("nan"))
             .when(c == float("inf"), F.lit("inf")).when(c == float("-inf"), F.lit("-inf"))
             .when(s.contains("E"), body).otherwise(s))


def with_global(df, row):
    """Append the columns of ``row`` to every row of ``df``.

    ``row`` must be a global aggregate: a single row (statistics, quotas, centre
    list) or a handful of rows fixed by parameters (one per probability). Its
    size does not grow with the data, so it is broadcast; this is a column
    append, never a data x data product.
    """
    from pyspark.sql import functions as _F
    return df.crossJoin(_F.broadcast(row))


def join_null_safe(left, right, keys: list[str], how: str = "inner"):
    """Join on ``keys`` where null equals null; the right side's keys are not repeated."""
    if not keys:
        return with_global(left, right)
    from pyspark.sql import functions as _F
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [_F.col(f"`{k}`").eqNullSafe(_F.col(f"`_right_{k}`")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])
