"""Readers for the driver's parquet tables and the stand-in fixtures.

Fixtures (FIXTURES.md §2) are written once as SQL that runs unchanged on Spark
and DuckDB, so the oracle and the Spark job start from the same rows.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Fixture definitions shared by Spark and the DuckDB oracle.
# Each maps a name to (base tables used, SQL text).
FIXTURE_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "f_events": (("events",), """
SELECT user_id AS id, CAST(ts AS DATE) AS record_date, event_id, event_type AS feature, value
FROM events"""),
    "f_visits": (("events",), """
SELECT user_id AS id, CAST(ts AS DATE) AS record_date,
       CAST(user_id % 2 AS INT) AS sex, CAST(20 + (user_id * 7) % 70 AS INT) AS age,
       AVG(CASE WHEN event_type = 'click' THEN value END) AS click,
       AVG(CASE WHEN event_type = 'error' THEN value END) AS error,
       AVG(CASE WHEN event_type = 'purchase' THEN value END) AS purchase,
       AVG(CASE WHEN event_type = 'signup' THEN value END) AS signup,
       AVG(CASE WHEN event_type = 'view' THEN value END) AS view_
FROM events GROUP BY user_id, CAST(ts AS DATE)"""),
    "f_patients": (("events",), """
SELECT user_id AS id, CAST(user_id % 2 AS INT) AS sex, CAST(20 + (user_id * 7) % 70 AS INT) AS age,
       CASE WHEN AVG(CASE WHEN event_type = 'error' THEN value END) > 50 THEN 1 ELSE 0 END AS outcome,
       MAX(CAST(ts AS DATE)) AS discharge_date
FROM events GROUP BY user_id"""),
    "f_admissions": (("orders", "lineitem"), """
SELECT o_orderkey AS record_id, o_custkey AS patient_id, CAST(o_orderdate AS DATE) AS record_date,
       MIN(CAST(l_shipdate AS DATE)) AS discharge_date,
       CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS outcome, AVG(l_quantity) AS lab_quantity
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY o_orderkey, o_custkey, CAST(o_orderdate AS DATE), o_orderstatus"""),
    "f_sparse_ids": (("conversations",), """
SELECT CAST(conv_id * 1000000 + turn AS BIGINT) AS src_row,
       CASE WHEN turn = 0 THEN conv_id END AS id_sparse, role
FROM conversations"""),
    "f_documents": (("documents",), """
SELECT doc_id AS id, lang AS dataset, text AS note, n_chars FROM documents"""),
    "f_preds": (("documents", "labels"), """
SELECT d.doc_id AS id, m.model, CASE WHEN m.model = 'm0' THEN l.quality ELSE l.toxic END AS label,
       CASE WHEN m.model = 'm0' THEN LEAST(CAST(1 AS DOUBLE), FLOOR(d.n_chars / 40) / 100)
            ELSE LEAST(CAST(1 AS DOUBLE), FLOOR((d.doc_id * 37) % 101) / 100) END AS pred,
       CASE WHEN d.lang = 'en' THEN 1 ELSE 0 END AS attr
FROM documents d JOIN labels l ON l.doc_id = d.doc_id
CROSS JOIN (SELECT 'm0' AS model UNION ALL SELECT 'm1' AS model) m"""),
    "f_responses": (("events",), """
SELECT event_id AS id, CASE event_id % 9
  WHEN 0 THEN '{"think": "t", "answer": 0.' || LPAD(k, 2, '0') || '}'
  WHEN 1 THEN '```json {"think": "t", "answer": 0.' || LPAD(k, 2, '0') || '} ```'
  WHEN 2 THEN '[{"think": "a", "answer": 0.10}, {"think": "b", "answer": 0.' || LPAD(k, 2, '0') || '}]'
  WHEN 3 THEN 'I do not know'
  WHEN 4 THEN 'Here is my assessment [1].' || chr(10) || '{"think": "t", "answer": 0.' || LPAD(k, 2, '0') || '}'
  WHEN 5 THEN '```json' || chr(10) || '{"think": "t", "answer": 0.' || LPAD(k, 2, '0') || '}'
  WHEN 6 THEN '<think>a {draft}</think>{"think": "u ```x``` v", "answer": 0.' || LPAD(k, 2, '0') || '}'
  WHEN 7 THEN '{"think": "first", "answer": 0.01} or rather {"think": "last", "answer": 0.' || LPAD(k, 2, '0') || '}'
  ELSE '{"think": "t", "answer": "high"}' END AS response
FROM (SELECT event_id, REGEXP_EXTRACT(props, '[0-9]+', 0) AS k FROM events) e"""),
    "f_codes": (("part",), """
SELECT p_partkey AS id,
       UPPER(SUBSTR(MD5(CAST(p_partkey AS STRING)), 1, CAST(3 + p_partkey % 3 AS INT))) AS code,
       p_name AS title, CAST(p_size % 10 AS INT) AS cluster
FROM part"""),
    "f_embeddings": (("embeddings",), """
SELECT vec_id AS id, embedding, label AS cluster FROM embeddings"""),
    "f_pairs": (("embeddings",), """
SELECT a.vec_id AS id, a.embedding AS e1, b.embedding AS e2,
       CAST(4 - LEAST(4, ABS(a.label - b.label)) AS DOUBLE) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
WHERE a.vec_id % 2 = 0"""),
    # Synthetic demographics of the scored documents (sensitive attributes).
    "f_demographics": (("documents",), """
SELECT doc_id AS id, CAST(doc_id % 2 AS INT) AS gender, CAST(20 + (doc_id * 7) % 70 AS INT) AS age,
       CASE lang WHEN 'en' THEN 'WHITE' WHEN 'de' THEN 'WHITE - OTHER EUROPEAN'
                 WHEN 'fr' THEN 'BLACK/AFRICAN' ELSE 'HISPANIC/LATINO' END AS race
FROM documents"""),
    # Every dimension is a class score; the label is one of the first ten classes.
    "f_scores": (("embeddings",), """
SELECT vec_id AS id, embedding AS scores, label FROM embeddings"""),
}


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan with optional column list (pruned at the reader)."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def register_tables(spark: SparkSession, sf_dir: str, names) -> None:
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build one fixture DataFrame. Views are re-bound on every call, and the
    returned DataFrame is analysed immediately, so it keeps pointing at ``sf_dir``."""
    tables, sql = FIXTURE_SQL[name]
    register_tables(spark, sf_dir, tables)
    return spark.sql(sql)


def oracle_fixture_sql(name: str) -> str:
    return FIXTURE_SQL[name][1].strip()
