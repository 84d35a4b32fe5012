"""Run registered Spark queries and their DuckDB oracles side by side.

Usage: python tests/oracle_compare.py [sf_dir] [key ...]
Compares row count, column names and an order-insensitive hash of the rows
(floats formatted to 6 places).
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        if math.isnan(v):
            return "null"
        v = round(v, 6)
        # 6 decimals, and at most 12 significant digits (huge values differ in the last ulp)
        return f"{v:.6f}" if abs(v) < 1e6 else f"{v:.12g}"
    if hasattr(v, "item"):
        return _cell(v.item())
    return str(v)


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_cell(r[i]) for i in order) for r in rows)
    return [columns[i] for i in order], hashlib.md5("\n".join(lines).encode()).hexdigest(), lines


def compare(spark, con, key, build, sql, sf_dir):
    t0 = time.time()
    sdf = build(spark, sf_dir)
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    s_cols, s_hash, s_lines = canon(sdf.columns, s_rows)
    if sql is None:
        return dict(key=key, ok=None, rows=len(s_rows), spark_sec=round(t1 - t0, 2))
    res = con.execute(sql)
    d_cols_raw = [d[0] for d in res.description]
    d_rows = res.fetchall()
    d_cols, d_hash, d_lines = canon(d_cols_raw, d_rows)
    ok = (s_cols == d_cols and len(s_rows) == len(d_rows) and s_hash == d_hash)
    out = dict(key=key, ok=ok, rows=(len(s_rows), len(d_rows)), spark_sec=round(t1 - t0, 2))
    if not ok:
        out["cols"] = (s_cols, d_cols)
        diff_s = sorted(set(s_lines) - set(d_lines))[:3]
        diff_d = sorted(set(d_lines) - set(s_lines))[:3]
        out["diff"] = (diff_s, diff_d)
    return out


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:]
    from cohortlab.session import get_session
    import __spark_entry__ as E
    spark = get_session("local[8]", 8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for k in (keys or list(qs)):
        try:
            r = compare(spark, con, k, qs[k], sqls.get(k), sf_dir)
        except Exception as exc:  # report and continue
            r = dict(key=k, ok=False, error=repr(exc)[:600])
        if r.get("ok") is False:
            bad += 1
        print(r, flush=True)
    print(f"FAILED {bad} of {len(keys or qs)}")


if __name__ == "__main__":
    main()
