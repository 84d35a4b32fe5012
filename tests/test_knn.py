"""Op 102: pruned search against all distances, ties, copies, skewed cells, and the share of distances computed."""

from __future__ import annotations

import numpy as np
import pytest

from cohortlab.operators.knn import knn_graph, knn_search, local_topk


def brute(rows, k, asked=None):
    out = {}
    for i, v in rows:
        if v is None or (asked is not None and i not in asked):
            continue
        d = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), j) for j, w in rows if w is not None and j != i)
        out[i] = [(j, round(x, 9)) for x, j in d[:k]]
    return out


def found(edges):
    out = {}
    for r in sorted(edges.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["id"], []).append((r["nbr"], round(r["dist"], 9)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<double>")


def clustered(n, dim, groups, seed=1):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(groups, dim)) * 10
    return [(i, (centres[i % groups] + draw.normal(size=dim) * 0.3).tolist()) for i in range(n)]


@pytest.mark.parametrize("pivots,block", [(1, 50_000), (7, 40), (60, 1000)])
def test_same_edges_as_all_distances(spark, pivots, block):
    rows = clustered(300, 5, 6) + [(1000 + i, [float(i % 3), 0.0, 0.0, 0.0, 0.0]) for i in range(40)] + [(2000, None)]
    edges, work = knn_search(frame(spark, rows), "id", "v", k=7, block=block, pivots=pivots)
    assert found(edges) == brute(rows, 7)
    assert work.count() == 340 and work.where("compared > points").count() == 0


def test_more_ties_than_k_at_the_cut(spark):
    rows = [(0, [0.0, 0.0])] + [(i, [float(np.cos(i)), float(np.sin(i))]) for i in range(1, 60)] + [(100 + i, [3.0, 0.0]) for i in range(200)]
    got = found(knn_graph(frame(spark, rows), "id", "v", k=4, queries=frame(spark, rows).where("id IN (0, 150, 299)"), pivots=9, block=30))
    assert got[150] == [(j, 0.0) for j in (100, 101, 102, 103)] and got[299] == got[150]
    assert got[0] == brute(rows, 4, {0})[0]


def test_clusters_are_cut_before_distances_are_computed(spark):
    rows = clustered(4000, 16, 50)
    asked = frame(spark, rows).where("id % 40 = 0")
    edges, work = knn_search(frame(spark, rows), "id", "v", k=10, queries=asked, pivots=64)
    some = {i for i, _ in rows if i % 400 == 0}
    got = found(edges)
    assert len(got) == 100 and {i: got[i] for i in some} == brute(rows, 10, some)
    share = work.selectExpr("sum(compared) / sum(points) AS share").first().share
    assert share < 0.2


def test_a_cell_with_most_points_is_many_tiles(spark):
    rows = [(i, [1.0, 1.0]) for i in range(500)] + clustered(100, 2, 4)[::-1]
    rows = [(i, v) for i, (_, v) in enumerate(rows)]
    got = found(knn_graph(frame(spark, rows), "id", "v", k=3, pivots=10, block=50))
    assert got == brute(rows, 3)


def test_small_tables_are_one_tile(spark):
    rows = clustered(90, 3, 4) + [(500, None)]
    edges, work = knn_search(frame(spark, rows), "id", "v", k=6)
    assert found(edges) == brute(rows, 6) and {(r.compared, r.points) for r in work.collect()} == {(90, 90)}


def test_few_points_and_none(spark):
    assert knn_graph(frame(spark, []), "id", "v").count() == 0
    assert knn_graph(frame(spark, [(1, [1.0])]), "id", "v").count() == 0
    assert found(knn_graph(frame(spark, [(1, [1.0]), (2, [3.0]), (3, None)]), "id", "v", k=5)) == {1: [(2, 2.0)], 2: [(1, 2.0)]}


def test_rounding_of_far_points_loses_no_neighbour():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(2000, 8)) * 1e-3 + 1e6  # expanded distances cancel almost wholly
    ids = np.arange(2000)
    at, dist = local_topk(x[7], np.delete(x, 7, 0), np.delete(ids, 7), 10)
    exact = np.sqrt(((np.delete(x, 7, 0) - x[7]) ** 2).sum(axis=1))
    assert np.array_equal(at, np.lexsort((np.delete(ids, 7), exact))[:10]) and np.array_equal(dist, exact[at])
