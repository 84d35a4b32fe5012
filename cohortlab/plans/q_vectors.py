"""Registered queries: similarity, rank correlation, clustering, code trees (ops 89-102, 111)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab.operators import vectors as V
from cohortlab.operators.knn import knn_graph
from cohortlab.plans.registry import oracle, register
from cohortlab.session import materialize
from cohortlab.sources.tables import fixture

# ---------------------------------------------------------------- similarity

_SIM_CTES = (
    ("ux", "SELECT id, score, unnest(e1)::DOUBLE AS a, unnest(e2)::DOUBLE AS b FROM f_pairs"),
    ("sims", "SELECT id, MAX(score) AS score, SUM(a * b) / (SQRT(SUM(a * a)) * SQRT(SUM(b * b))) AS cosine, "
             "-SUM(ABS(a - b)) AS l1, -SQRT(SUM((a - b) * (a - b))) AS l2 FROM ux GROUP BY id"),
    ("lng", "SELECT id, score, m.method, m.sim FROM sims, LATERAL (VALUES ('cosine', cosine), ('l1', l1), ('l2', l2)) m(method, sim)"),
    ("pr", "SELECT method, ROUND_EVEN(CORR(score, sim), 2) AS pearson_corr, "
           "ROUND_EVEN(SQRT(GREATEST(0, 1 - CORR(score, sim))), 2) AS pearson_dist FROM lng GROUP BY method"),
    ("rk", "SELECT method, RANK() OVER (PARTITION BY method ORDER BY score) + (COUNT(*) OVER (PARTITION BY method, score) - 1) / 2.0 AS rx, "
           "RANK() OVER (PARTITION BY method ORDER BY sim) + (COUNT(*) OVER (PARTITION BY method, sim) - 1) / 2.0 AS ry FROM lng"),
    ("sp", "SELECT method, ROUND_EVEN(CORR(rx, ry), 2) AS spearman_corr FROM rk GROUP BY method"),
    ("kp", "SELECT a.method, COUNT(*) AS n0, SUM(CASE WHEN a.score = b.score THEN 1 ELSE 0 END) AS n1, "
           "SUM(CASE WHEN a.sim = b.sim THEN 1 ELSE 0 END) AS n2, SUM(SIGN(a.score - b.score) * SIGN(a.sim - b.sim)) AS s "
           "FROM lng a JOIN lng b ON a.method = b.method AND a.id < b.id GROUP BY a.method"),
    ("kd", "SELECT method, ROUND_EVEN(s / SQRT((n0 - n1) * (n0 - n2)), 2) AS kendall_corr FROM kp"),
)


def _pairs(spark, sf):
    return fixture(spark, sf, "f_pairs")


@register("cosine_l1_l2", oracle("SELECT id, cosine, l1, l2 FROM sims", ("f_pairs",), ctes=_SIM_CTES,
                                 dbl=("cosine", "l1", "l2")))
def q_cosine(spark, sf):
    return V.cosine_l1_l2(_pairs(spark, sf), "e1", "e2").select("id", "cosine", "l1", "l2")


def _long(spark, sf):
    s = V.cosine_l1_l2(_pairs(spark, sf), "e1", "e2")
    return s.select("id", F.col("score").cast("double").alias("score"), F.inline(F.array(
        *[F.struct(F.lit(m).alias("method"), F.col(m).alias("sim")) for m in ("cosine", "l1", "l2")])))


@register("pearson", oracle("SELECT * FROM pr", ("f_pairs",), ctes=_SIM_CTES, dbl=("pearson_corr", "pearson_dist")))
def q_pearson(spark, sf):
    return V.pearson(_long(spark, sf), ["method"], "score", "sim")


@register("spearman", oracle("SELECT * FROM sp", ("f_pairs",), ctes=_SIM_CTES, dbl=("spearman_corr",)))
def q_spearman(spark, sf):
    return V.spearman(_long(spark, sf), ["method"], "score", "sim")


@register("kendall", oracle("SELECT * FROM kd", ("f_pairs",), ctes=_SIM_CTES, dbl=("kendall_corr",)))
def q_kendall(spark, sf):
    return V.kendall_tau_b(_long(spark, sf), ["method"], "score", "sim")


@register("similarity_report", oracle(
    "SELECT 'pairs' AS model, pr.method, pearson_corr, pearson_dist, spearman_corr, kendall_corr FROM pr "
    "JOIN sp ON sp.method = pr.method JOIN kd ON kd.method = pr.method", ("f_pairs",), ctes=_SIM_CTES,
    dbl=("pearson_corr", "pearson_dist", "spearman_corr", "kendall_corr")))
def q_similarity_report(spark, sf):
    p = _pairs(spark, sf).withColumn("model", F.lit("pairs"))
    return V.similarity_report(p, ["model"], "e1", "e2", "score")

# ---------------------------------------------------------------- clustering


_EMB_CTES = (
    ("ex", "SELECT id, cluster, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM f_embeddings"),
    ("cen", "SELECT cluster AS c, pos, AVG(v) AS m FROM ex GROUP BY cluster, pos"),
    ("dist", "SELECT e.id, c.c, SUM((e.v - c.m) * (e.v - c.m)) AS d FROM ex e JOIN cen c ON c.pos = e.pos GROUP BY e.id, c.c"),
    ("near", "SELECT id, arg_min(c, (d, c)) AS center FROM dist GROUP BY id"),
    ("cd", "SELECT cluster, pos, COUNT(*) AS n, SUM(v) AS s, SUM(v * v) AS ss FROM ex GROUP BY cluster, pos"),
    ("gd", "SELECT pos, SUM(s) / SUM(n) AS mu FROM cd GROUP BY pos"),
    ("chp", "SELECT SUM(n * (s / n - mu) * (s / n - mu)) AS b, SUM(ss - s * (s / n)) AS w, COUNT(DISTINCT cluster) AS k "
            "FROM cd JOIN gd USING (pos)"),
    ("ch", "SELECT CASE WHEN w = 0 THEN 1.0 ELSE (b / (k - 1)) / (w / ((SELECT COUNT(*) FROM f_embeddings) - k)) END AS ch FROM chp"),
)


def _emb(spark, sf):
    return fixture(spark, sf, "f_embeddings")


@register("nearest_center", oracle("SELECT * FROM near", ("f_embeddings",), ctes=_EMB_CTES))
def q_nearest_center(spark, sf):
    e = _emb(spark, sf)
    centres = V.cluster_centres(e, "cluster", "embedding")
    return V.nearest_center(e.select("id", "embedding"), "embedding", centres).select("id", "center")


@register("calinski_harabasz", oracle("SELECT * FROM ch", ("f_embeddings",), ctes=_EMB_CTES, dbl=("ch",)))
def q_calinski_harabasz(spark, sf):
    return V.calinski_harabasz(_emb(spark, sf), [], "cluster", "embedding")


_KS = [10, 20, 30, 40, 50]


@register("kmeans", oracle("SELECT k, id, true AS valid, true AS all_used, true AS fixed_point FROM f_embeddings, (VALUES " + ", ".join(
    f"({k})" for k in _KS) + ") v(k)", ("f_embeddings",)))
def q_kmeans(spark, sf):
    """Every point has one of the k clusters, each cluster has points, and its centre is their mean."""
    e = _emb(spark, sf)
    centres, out = V.kmeans_sweep(e, "id", "embedding", _KS, seed=42)
    out = materialize(out)
    means = out.join(e.select("id", "embedding"), "id").select("k", "cluster", F.posexplode("embedding").alias("d", "x")).groupBy("k", "cluster", "d").agg(F.avg("x").alias("mean"))
    held = centres.select("k", "cluster", F.posexplode("centre").alias("d", "x"))
    fixed = held.join(means, ["k", "cluster", "d"], "left").groupBy("k").agg(
        F.bool_and(F.coalesce(F.abs(F.col("x") - F.col("mean")) < 1e-9, F.lit(False))).alias("fixed_point"))
    used = out.groupBy("k").agg((F.count_distinct("cluster") == F.col("k")).alias("all_used"))
    return out.join(used, "k").join(fixed, "k").select(
        "k", "id", ((F.col("cluster") >= 0) & (F.col("cluster") < F.col("k"))).alias("valid"), "all_used", "fixed_point")


@register("lloyd_kmeans", oracle("SELECT id, true AS fixed_point FROM f_embeddings", ("f_embeddings",)))
def q_lloyd(spark, sf):
    """Every point with the check that its centre is the mean of the points that have it."""
    centres, assigned = V.lloyd_kmeans(_emb(spark, sf), "id", "embedding", k=10, max_iter=1000, seed=42)
    means = V.cluster_centres(assigned, "center", "embedding").select(F.col("cluster").alias("center"), F.col("centre").alias("mean"))
    near = F.forall(F.zip_with("mean", "centre", lambda a, b: F.abs(a - b) < 1e-9), lambda x: x)
    fixed = means.join(centres.select(F.col("cluster").alias("center"), "centre"), "center").select("center", near.alias("fixed_point"))
    return assigned.join(fixed, "center").select("id", "fixed_point")


# ---------------------------------------------------------------- codes

def _lcp_sql(a: str, b: str) -> str:
    return (f"list_sum(list_transform(range(1, LEAST(len({a}), len({b})) + 1), "
            f"lambda i: CASE WHEN {a}[1:i] = {b}[1:i] THEN 1 ELSE 0 END))")


def _path_sql(c: str) -> str:
    return (f"list_concat(['root', {c}[1:1], {c}[1:3]], "
            f"CASE WHEN len({c}) > 3 THEN list_transform(range(4, len({c}) + 1), lambda L: {c}[1:L]) ELSE [] END)")


_CODE_CTES = (
    ("cp", "SELECT a.id AS id_a, b.id AS id_b, a.code AS code_a, b.code AS code_b FROM f_codes a JOIN f_codes b ON b.id = a.id + 1"),
    ("ccd", "SELECT cluster, COUNT(*) AS n_codes FROM f_codes GROUP BY cluster"),
    ("cpair", "SELECT a.cluster, AVG(len(a.code) + len(b.code) - 2 * " + _lcp_sql("a.code", "b.code") + ") AS md "
              "FROM f_codes a JOIN f_codes b ON a.cluster = b.cluster AND a.id < b.id GROUP BY a.cluster"),
    ("ccdist", "SELECT c.cluster, c.n_codes, CASE WHEN c.n_codes <= 1 THEN 0.0 ELSE p.md END AS mean_distance "
               "FROM ccd c LEFT JOIN cpair p ON p.cluster = c.cluster"),
)


def _codes(spark, sf):
    return fixture(spark, sf, "f_codes")


@register("code_distance", oracle(
    "SELECT id_a, id_b, CAST(len(code_a) + len(code_b) - 2 * " + _lcp_sql("code_a", "code_b") + " AS BIGINT) AS dist FROM cp",
    ("f_codes",), ctes=_CODE_CTES))
def q_code_distance(spark, sf):
    c = _codes(spark, sf)
    a = c.select(F.col("id").alias("id_a"), F.col("code").alias("code_a"))
    b = c.select(F.col("id").alias("id_b"), F.col("code").alias("code_b"))
    j = a.join(b, F.col("id_b") == F.col("id_a") + 1)
    return j.select("id_a", "id_b", V.code_distance(F.col("code_a"), F.col("code_b")).cast("bigint").alias("dist"))


@register("cluster_code_distance", oracle("SELECT * FROM ccdist", ("f_codes",), ctes=_CODE_CTES,
                                          dbl=("mean_distance",)))
def q_cluster_code_distance(spark, sf):
    return V.cluster_code_distance(_codes(spark, sf), ["cluster"], "code").select("cluster", "n_codes", "mean_distance")


@register("cluster_report", oracle(
    "SELECT 'given' AS model, 10 AS k, ch, COALESCE((SELECT AVG(mean_distance) FROM ccdist WHERE mean_distance > 0), 0.0) "
    "AS average_distance FROM ch", ("f_embeddings", "f_codes"), ctes=_EMB_CTES + _CODE_CTES,
    dbl=("ch", "average_distance")))
def q_cluster_report(spark, sf):
    ch = V.calinski_harabasz(_emb(spark, sf), [], "cluster", "embedding")
    dist = V.cluster_code_distance(_codes(spark, sf), ["cluster"], "code")
    r = V.cluster_report(ch, dist, [])
    return r.select(F.lit("given").alias("model"), F.lit(10).alias("k"), "ch", "average_distance")


@register("code_tree", oracle(
    "SELECT DISTINCT p[i] AS parent, p[i + 1] AS child, CAST(i AS INT) AS depth FROM "
    "(SELECT " + _path_sql("code") + " AS p FROM f_codes) t, LATERAL (SELECT unnest(range(1, len(p))) AS i) r",
    ("f_codes",)))
def q_code_tree(spark, sf):
    return V.code_tree(_codes(spark, sf), "code")


@register("tree_distance", oracle(
    "SELECT id_a, id_b, CAST(len(pa) + len(pb) - 2 * list_sum(list_transform(range(1, LEAST(len(pa), len(pb)) + 1), "
    "lambda i: CASE WHEN pa[i] = pb[i] THEN 1 ELSE 0 END)) AS BIGINT) AS dist FROM (SELECT id_a, id_b, "
    + _path_sql("code_a") + " AS pa, " + _path_sql("code_b") + " AS pb FROM cp)", ("f_codes",), ctes=_CODE_CTES))
def q_tree_distance(spark, sf):
    c = _codes(spark, sf)
    a = c.select(F.col("id").alias("id_a"), F.col("code").alias("code_a"))
    b = c.select(F.col("id").alias("id_b"), F.col("code").alias("code_b"))
    j = a.join(b, F.col("id_b") == F.col("id_a") + 1)
    return j.select("id_a", "id_b", V.tree_distance(F.col("code_a"), F.col("code_b")).cast("bigint").alias("dist"))


@register("knn_graph", oracle(
    "SELECT id, nbr, rank, dist FROM (SELECT a.id, b.id AS nbr, SQRT(SUM((x.a - x.b) * (x.a - x.b))) AS dist, "
    "ROW_NUMBER() OVER (PARTITION BY a.id ORDER BY SQRT(SUM((x.a - x.b) * (x.a - x.b))), b.id) AS rank "
    "FROM f_embeddings a JOIN f_embeddings b ON a.id <> b.id, "
    "LATERAL (SELECT unnest(a.embedding)::DOUBLE AS a, unnest(b.embedding)::DOUBLE AS b) x GROUP BY a.id, b.id) "
    "WHERE rank <= 20 AND id % 100 = 0", ("f_embeddings",), dbl=("dist",)))
def q_knn_graph(spark, sf):
    e = _emb(spark, sf)
    # the search's query set: every hundredth id, against all points
    g = knn_graph(e, "id", "embedding", k=20, queries=e.where("id % 100 = 0"))
    return g.select("id", "nbr", F.col("rank").cast("bigint").alias("rank"), "dist")
