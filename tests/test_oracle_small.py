"""Every registered query against its DuckDB oracle on the smallest scale,
plus the entry() smoke check."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from oracle_compare import compare

SLOW = {"fit_gbt", "fit_random_forest", "full_vs_few", "kmeans", "lloyd_kmeans", "fit_mlp_on_embeddings",
        "fit_fused_mlp"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "id" in df.columns


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("key", sorted(k for k in E.queries() if k not in SLOW))
def test_query_matches_oracle(spark, duck_small, key):
    r = compare(spark, duck_small, key, E.queries()[key], E.oracle_sql().get(key), SF_SMALL)
    assert r["ok"] in (True, None), r


@pytest.mark.parametrize("key", sorted(E.oracle_sql()))
def test_result_types_match_oracle(spark, duck_small, key):
    sdf = E.queries()[key](spark, SF_SMALL)
    spark_types = {n: TYPES.get(t, t) for n, t in sdf.dtypes}
    duck_types = {r[0]: r[1] for r in duck_small.execute(f"DESCRIBE {E.oracle_sql()[key]}").fetchall()}
    assert spark_types == duck_types
