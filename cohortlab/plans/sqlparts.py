"""DuckDB SQL fragments for the oracle side (independent of the Spark code)."""

from __future__ import annotations

PANEL_FEATURES = ["age", "click", "error", "purchase", "signup", "view_"]
LAB_FEATURES = ["click", "error", "purchase", "signup", "view_"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def sql_hash(id_expr: str, seed: int = 42, salt: str | None = None) -> str:
    prefix = f"{seed}|" if salt is None else f"{seed}|{salt}|"
    return f"('0x' || substr(md5('{prefix}' || CAST({id_expr} AS VARCHAR)), 1, 8))::BIGINT"


def strat_ctes(src: str, out: str, target: str, salt: str | None, flag: str,
               strata: str = "label") -> list[tuple[str, str]]:
    """Stratified first-q-in-hash-order selection with largest-remainder quotas."""
    return [
        (f"{out}_h", f"SELECT *, {sql_hash('id', 42, salt)} AS _h FROM {src}"),
        (f"{out}_c", f"SELECT {strata}, COUNT(*) AS n_c, SUM(COUNT(*)) OVER () AS n_all "
                     f"FROM {out}_h GROUP BY {strata}"),
        (f"{out}_t", f"SELECT *, LEAST(n_all, CAST({target} AS BIGINT)) AS tgt FROM {out}_c"),
        (f"{out}_f", f"SELECT *, (tgt * n_c) // n_all AS fl, (tgt * n_c) % n_all AS rem FROM {out}_t"),
        (f"{out}_q", f"SELECT {strata}, fl + CASE WHEN ROW_NUMBER() OVER (ORDER BY rem DESC, {strata}) "
                     f"<= tgt - SUM(fl) OVER () THEN 1 ELSE 0 END AS quota FROM {out}_f"),
        (out, f"SELECT h.* EXCLUDE (_h), ROW_NUMBER() OVER (PARTITION BY h.{strata} ORDER BY h._h, h.id) "
              f"<= q.quota AS {flag} FROM {out}_h h JOIN {out}_q q USING ({strata})"),
    ]


def customer_cohort_ctes() -> list[tuple[str, str]]:
    """Cohort of customers (patients) labelled by their first admission outcome."""
    return [("cohort", "SELECT patient_id AS id, FIRST(outcome ORDER BY record_date, record_id) AS label "
                       "FROM f_admissions GROUP BY patient_id")]


def customer_split_ctes() -> list[tuple[str, str]]:
    ctes = customer_cohort_ctes()
    ctes += strat_ctes("cohort", "s_test", "200", None, "in_test")
    ctes += [("pool", "SELECT id, label FROM s_test WHERE NOT in_test")]
    ctes += strat_ctes("pool", "s_val", "CEIL(n_all * 0.125)", "val", "v")
    ctes += [("splits", "SELECT id, label, 'test' AS split FROM s_test WHERE in_test UNION ALL "
                        "SELECT id, label, CASE WHEN v THEN 'val' ELSE 'train' END AS split FROM s_val")]
    return ctes


def customer_cap_ctes() -> list[tuple[str, str]]:
    """At most 10,000 of the ids outside the test set."""
    ctes = customer_cohort_ctes()
    ctes += strat_ctes("cohort", "s_test", "200", None, "in_test")
    ctes += [("pool", "SELECT id, label FROM s_test WHERE NOT in_test")]
    ctes += strat_ctes("pool", "s_cap", "10000", "cap", "kept")
    return ctes + [("kept", "SELECT id, label FROM s_cap WHERE kept")]


def panel_split_ctes() -> list[tuple[str, str]]:
    ctes = [("pc", "SELECT id, outcome AS label FROM f_patients")]
    ctes += strat_ctes("pc", "ps", "CEIL(n_all * 0.125)", "val", "v")
    ctes += [("psplit", "SELECT id, label, CASE WHEN v THEN 'val' ELSE 'train' END AS split FROM ps")]
    return ctes


def trimmed_stats_ctes(src: str, features: list[str], out: str = "st") -> list[tuple[str, str]]:
    lng = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM {src}" for f in features)
    names = ", ".join(f"('{f}')" for f in features)
    keep = "value > lo AND value < hi"
    return [
        (f"{out}_l", lng),
        (f"{out}_f", f"SELECT * FROM (VALUES {names}) t(feature)"),
        (f"{out}_q", f"SELECT f.feature, quantile_cont(l.value, 0.05) AS lo, quantile_cont(l.value, 0.95) AS hi "
                     f"FROM {out}_f f LEFT JOIN {out}_l l ON l.feature = f.feature GROUP BY f.feature"),
        (f"{out}_0", f"SELECT q.feature, AVG(value) FILTER (WHERE {keep}) AS mean, "
                     f"STDDEV_SAMP(value) FILTER (WHERE {keep}) AS std, MEDIAN(value) FILTER (WHERE {keep}) AS median "
                     f"FROM {out}_q q LEFT JOIN {out}_l l ON l.feature = q.feature GROUP BY q.feature"),
        (out, f"SELECT feature, COALESCE(mean, 0) AS mean, COALESCE(std, 0) AS std, COALESCE(median, 0) AS median, "
              f"(COALESCE(median, 0) - COALESCE(mean, 0)) / (COALESCE(std, 0) + 1e-12) AS default_fill FROM {out}_0"),
    ]


def wide_stats_cte(src: str, features: list[str], out: str) -> tuple[str, str]:
    cols = ", ".join(f"MAX({k}) FILTER (WHERE feature = '{f}') AS {f}__{k}"
                     for f in features for k in ("mean", "std", "default_fill"))
    return (out, f"SELECT {cols} FROM {src}")


def panel_ctes() -> list[tuple[str, str]]:
    """f_visits -> train stats -> z-score -> clip -> LOCF (the flagship panel)."""
    ctes = panel_split_ctes()
    ctes += [("tr", "SELECT * FROM f_visits WHERE id IN (SELECT id FROM psplit WHERE split = 'train')")]
    ctes += trimmed_stats_ctes("tr", PANEL_FEATURES)
    ctes += [wide_stats_cte("st", PANEL_FEATURES, "sw")]
    z = ", ".join(f"(CAST({f} AS DOUBLE) - {f}__mean) / ({f}__std + 1e-12) AS {f}" for f in PANEL_FEATURES)
    ctes += [("zs", f"SELECT id, record_date, sex, {z} FROM f_visits, sw")]
    clip = ", ".join(f"CASE WHEN ABS({f}) > 1e4 THEN 0.0 ELSE {f} END AS {f}" for f in PANEL_FEATURES)
    ctes += [("zc", f"SELECT id, record_date, sex, {clip} FROM zs")]
    locf = ", ".join(
        f"COALESCE(LAST_VALUE({f} IGNORE NULLS) OVER (PARTITION BY id ORDER BY record_date "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), {f}__default_fill) AS {f}" for f in LAB_FEATURES)
    ctes += [("panel", f"SELECT id, record_date, sex, age, {locf} FROM zc, sw")]
    return ctes


PARSE_SQL = r"""
SELECT id, response, think, CASE WHEN think IS NOT NULL THEN COALESCE(TRY_CAST(answer AS DOUBLE), -1.0) END AS pred,
       CASE WHEN think IS NULL THEN 'failed' ELSE 'ok' END AS status
FROM (SELECT id, response, answer, CASE WHEN answer IS NOT NULL THEN think END AS think
      FROM (SELECT id, response, json_extract_string(body, '$.think') AS think, json_extract_string(body, '$.answer') AS answer
            FROM (SELECT id, response,
                         CASE WHEN many <> '' AND instr(t, many) < instr(t, '{')
                              THEN CASE WHEN json_valid(many) THEN CAST(json_extract(many, '$[#-1]') AS VARCHAR) END
                              WHEN one <> '' AND json_valid(one) THEN one
                              WHEN tail <> '' AND json_valid(tail) THEN tail END AS body
                  FROM (SELECT id, response, t, regexp_extract(t, '(?s)\[\s*\{.*\}\s*\]', 0) AS many,
                               regexp_extract(t, '(?s)\{.*\}', 0) AS one, regexp_extract(t, '(?s)^.*(\{[^{}]*\})', 1) AS tail
                        FROM (SELECT id, response, regexp_replace(response, '(?s)^.*</think>', '') AS t FROM f_responses)))))"""
