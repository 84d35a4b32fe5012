"""Registry of named queries: a Spark plan plus (optionally) its DuckDB oracle.

Each query reads the driver's tables (or fixtures derived from them), applies
operators from ``cohortlab.operators`` and presents the result for comparison:
doubles rounded to 6 places, dates as ISO text.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.sources.tables import oracle_fixture_sql


@dataclass
class QuerySpec:
    key: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, QuerySpec] = {}


def present(df: DataFrame) -> DataFrame:
    """Round doubles to 6 dp and render dates as text (same as the oracle)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def oracle(body: str, fixtures: tuple[str, ...] = (), ctes: tuple[tuple[str, str], ...] = (),
           dbl: tuple[str, ...] = (), txt: tuple[str, ...] = ()) -> str:
    """Compose DuckDB SQL: fixture CTEs + extra CTEs + body, doubles rounded,
    dates cast to text."""
    parts = [f"{n} AS (\n{oracle_fixture_sql(n)}\n)" for n in fixtures]
    parts += [f"{n} AS (\n{s.strip()}\n)" for n, s in ctes]
    head = ("WITH " + ",\n".join(parts) + "\n") if parts else ""
    if dbl or txt:
        repl = [f'ROUND(CAST("{c}" AS DOUBLE), 6) AS "{c}"' for c in dbl]
        repl += [f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in txt]
        return f"{head}SELECT * REPLACE ({', '.join(repl)}) FROM (\n{body.strip()}\n) q"
    return head + body.strip()


def register(key: str, sql: str | None = None):
    def deco(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(spark, sf_dir))
        REGISTRY[key] = QuerySpec(key, build, sql)
        return fn
    return deco
