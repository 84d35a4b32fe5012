"""Op 102: exact k nearest neighbours with metric pruning.

Points are dealt to cells around a bounded number of pivots and keep their distance ``r`` to their
own pivot. For a query at distance ``dq`` from a cell's pivot, the triangle inequality bounds the distance to every
point of the cell before any is computed:

* a whole cell is cut if ``dq - r_max``, ``r_min - dq`` or half of how much farther the query is from this pivot
  than from its nearest one exceeds what is needed;
* within a cell, only the points with ``|dq - r|`` up to what is needed are read: a slice, as points lie in order of ``r``.

What is needed is the k-th smallest distance of a first round, which searches each query's nearest
cells up to k points; the second round searches the cells that remain. Cells are split into tiles of
a bounded size, points and queries alike, so a cell that holds a third of all points is many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.exprs import hash_order
from cohortlab.session import write_once

MAX_PIVOTS = 1024  # pivots and their cells' figures reach the driver and every task: MAX_PIVOTS x dim numbers
SMALL = 20_000     # points up to which one tile is all there is to search: no pivots unless asked for
SLICE = 500_000    # numbers that a task holds of its queries' distances to pivots, or sends on of their vectors, at a time
_SLACK = 1e-9      # relative; bounds are widened by it, so rounding never cuts a neighbour


_FOUND = "id {0}, nbr {0}, dist double, compared bigint"


def _id_kind(kind: str) -> str:
    return "int64" if kind in ("bigint", "int") else "object"


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Euclidean distances, centre by centre (no expansion, so no cancellation)."""
    return np.stack([np.sqrt(((x - c) ** 2).sum(axis=1)) for c in centres], axis=1)


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float, copy=False)


def _slices(batches: Iterator[pd.DataFrame], centres: np.ndarray) -> Iterator[pd.DataFrame]:
    """The rows, few enough at a time that a slice's distances to all pivots are at most SLICE numbers."""
    rows = max(1, SLICE // len(centres))
    for b in batches:
        for lo in range(0, len(b), rows):
            yield b.iloc[lo:lo + rows]


def _visits(b: pd.DataFrame, at: np.ndarray, cell: np.ndarray, dq: np.ndarray, need: np.ndarray, dim: int) -> Iterator[pd.DataFrame]:
    """Rows ``at`` of ``b``, each with a cell, in frames of at most SLICE vector components: a query may visit every cell."""
    rows = max(1, SLICE // max(dim, 1))
    for lo in range(0, len(at), rows):
        one = slice(lo, lo + rows)
        yield b.iloc[at[one]].assign(cell=cell[one].astype(np.int32), dq=dq[one], need=need[one])


def _assigner(centres: np.ndarray):
    def assign(batches: Iterator[pd.DataFrame]):
        for b in _slices(batches, centres):
            d = _distances(_stack(b["v"]), centres)
            cell = d.argmin(axis=1)
            yield b.assign(cell=cell.astype(np.int32), r=d[np.arange(len(b)), cell])
    return assign


class _Cells:
    """Figures of every cell, and what they prove about a query."""

    def __init__(self, centres: np.ndarray, n: np.ndarray, r_min: np.ndarray, r_max: np.ndarray):
        self.centres, self.n, self.r_min, self.r_max = centres, n, r_min, r_max

    def nearest(self, dq: np.ndarray, k: int) -> np.ndarray:
        """The nearest cells of one query that hold k points together."""
        order = np.argsort(dq, kind="stable")
        held = np.cumsum(self.n[order])
        return order[:int(np.searchsorted(held, k)) + 1]

    def at_least(self, dq: np.ndarray) -> np.ndarray:
        """Lower bounds of the distances (rows: queries, columns: cells)."""
        ring = np.maximum(dq - self.r_max, self.r_min - dq)
        plane = (dq - dq.min(axis=1, keepdims=True)) / 2  # a point is no nearer to another pivot than to its own
        return np.maximum(np.maximum(ring, plane), 0.0)


def _first_visits(cells: _Cells, k: int):
    def plan(batches: Iterator[pd.DataFrame]):
        for b in _slices(batches, cells.centres):
            dq = _distances(_stack(b["v"]), cells.centres)
            chosen = [cells.nearest(row, k + 1) for row in dq]  # the query itself may be one of them
            at = np.repeat(np.arange(len(b)), [len(c) for c in chosen])
            cell = np.concatenate(chosen)
            yield from _visits(b, at, cell, dq[at, cell], np.full(len(at), np.inf), cells.centres.shape[1])
    return plan


def _other_visits(cells: _Cells, k: int):
    def plan(batches: Iterator[pd.DataFrame]):
        for b in _slices(batches, cells.centres):
            dq = _distances(_stack(b["v"]), cells.centres)
            need = b["need"].to_numpy() * (1 + _SLACK) + _SLACK * dq.max(axis=1)
            open_ = (cells.at_least(dq) <= need[:, None]) & (cells.n > 0)
            for i, row in enumerate(dq):
                open_[i, cells.nearest(row, k + 1)] = False
            at, cell = np.nonzero(open_)
            yield from _visits(b, at, cell, dq[at, cell], need[at], cells.centres.shape[1])
    return plan


def local_topk(q: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of one query's k nearest ``points``, equal distances by smaller id.

    Distances are ranked by their expanded form first; everything within its rounding error of the k-th is then
    measured directly, so neither rounding nor ties can lose a neighbour.
    """
    if len(points) > 4 * k:
        squares = (points * points).sum(axis=1)
        d2 = squares + (q @ q) - 2 * (points @ q)
        error = 4 * np.finfo(float).eps * (len(q) + 4) * (squares.max() + q @ q)
        kept = np.flatnonzero(d2 <= np.partition(d2, k - 1)[k - 1] + 2 * error)
    else:
        kept = np.arange(len(points))
    exact = np.sqrt(((points[kept] - q) ** 2).sum(axis=1))
    order = np.lexsort((ids[kept], exact))[:k]
    return kept[order], exact[order]


def _searcher(k: int, id_kind: str):
    kinds = {"id": id_kind, "nbr": "Int64" if id_kind == "int64" else "object", "dist": "float64", "compared": "int64"}

    def frame(**columns) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series(columns[c], dtype=kind) for c, kind in kinds.items()})

    def search(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(points):
            return frame(id=[], nbr=[], dist=[], compared=[])
        points = points.sort_values("r", kind="stable")
        x, r, ids = _stack(points["v"]), points["r"].to_numpy(), points["id"].to_numpy()
        asked, nbrs, dists, compared = queries["id"].to_numpy(), [], [], np.zeros(len(queries), np.int64)
        for i, (qid, v, dq, need) in enumerate(zip(asked, _stack(queries["v"]), queries["dq"], queries["need"])):
            lo, hi = np.searchsorted(r, dq - need, "left"), np.searchsorted(r, dq + need, "right")
            mine = np.arange(lo, hi)
            mine = mine[ids[lo:hi] != qid]
            at, dist = local_topk(v, x[mine], ids[mine], k) if mine.size else (np.empty(0, int), np.empty(0))
            nbrs.append(ids[mine[at]])
            dists.append(dist)
            compared[i] = hi - lo
        found = frame(id=np.repeat(asked, [len(n) for n in nbrs]), nbr=np.concatenate(nbrs), dist=np.concatenate(dists), compared=np.zeros(sum(map(len, nbrs)), np.int64))
        none = np.full(len(asked), None, object)
        return pd.concat([frame(id=asked, nbr=none, dist=np.full(len(asked), np.nan), compared=compared), found], ignore_index=True)
    return search


def _search(visits: DataFrame, members: DataFrame, sizes: dict[int, int], k: int, block: int) -> DataFrame:
    """``(id, nbr, dist, compared)``: each visited tile's k nearest, and a row without neighbour with the distances it took."""
    spark = visits.sparkSession
    kind = visits.schema["id"].dataType.simpleString()
    visits = write_once(visits, "knn-visits")
    asked = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row per cell
    tiles = spark.createDataFrame([(c, math.ceil(sizes[c] / block), math.ceil(n / block)) for c, n in asked.items()],
                                  "cell int, pt int, qt int")
    deal = lambda n: F.pmod(F.xxhash64("id", F.lit("tile")), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = visits.join(F.broadcast(tiles), "cell").select("id", "v", "dq", "need", "cell", deal("qt").alias("qtile"), every("pt").alias("ptile"))
    p = members.join(F.broadcast(tiles), "cell").select("id", "v", "r", "cell", deal("pt").alias("ptile"), every("qt").alias("qtile"))
    keys = ["cell", "ptile", "qtile"]
    return q.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInPandas(
        _searcher(k, _id_kind(kind)), schema=_FOUND.format(kind))


def knn_search(points: DataFrame, id_col: str, vec: str, k: int = 20, queries: DataFrame | None = None,
               block: int = 50_000, pivots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges ``(id, nbr, rank, dist)`` and, per query, ``(id, compared, points)``: how many distances were computed for it."""
    spark = points.sparkSession
    kind = points.schema[id_col].dataType.simpleString()
    p = points.where(F.col(vec).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v"))
    n = p.count()
    asked = p if queries is None else p.join(queries.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    w = Window.partitionBy("id").orderBy("dist", "nbr")
    if n <= SMALL and pivots is None:
        # both sides may be the same table: columns get names of their own
        one = lambda d, c: d.select(F.col("id").alias("id"), F.col("v").alias("v"), F.lit(0.0).alias(c), F.lit(float("inf")).alias("need"),
                                    F.lit(0).alias("cell")).groupBy("cell")
        found = one(asked, "dq").cogroup(one(p, "r")).applyInPandas(_searcher(k, _id_kind(kind)), schema=_FOUND.format(kind))
        edges = found.where("nbr IS NOT NULL").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("compared")
        return edges, found.where("nbr IS NULL").groupBy("id").agg(F.sum("compared").alias("compared")).withColumn("points", F.lit(n).cast("long"))
    wanted = min(MAX_PIVOTS, pivots or max(1, math.ceil(math.sqrt(n))))
    drawn = p.withColumn("_h", hash_order("id", 42, "pivot")).orderBy("_h", "id").limit(wanted).select("v").collect()
    if not drawn:
        return (spark.createDataFrame([], f"id {kind}, nbr {kind}, dist double, rank int"),
                spark.createDataFrame([], f"id {kind}, compared bigint, points bigint"))
    centres = np.unique(np.array([r.v for r in drawn]), axis=0)
    members = write_once(p.mapInPandas(_assigner(centres), f"id {kind}, v array<double>, cell int, r double"), "knn-cells")
    figures = members.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).collect()
    size, lo, hi = np.zeros(len(centres), np.int64), np.full(len(centres), np.inf), np.zeros(len(centres))
    for f in figures:
        size[f["cell"]], lo[f["cell"]], hi[f["cell"]] = f["n"], f["lo"], f["hi"]
    cells, sizes = _Cells(centres, size, lo, hi), dict(enumerate(size.tolist()))

    plan = f"id {kind}, v array<double>, cell int, dq double, need double"
    first = write_once(_search(asked.mapInPandas(_first_visits(cells, k), plan), members, sizes, k, block), "knn-first")
    ranked = first.where("nbr IS NOT NULL").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    need = ranked.groupBy("id").agg(F.when(F.count("*") == k, F.max("dist")).otherwise(F.lit(float("inf"))).alias("need"))
    # a query whose first cells held nothing but itself needs everything
    rest = asked.join(need, "id", "left").select("id", "v", F.coalesce("need", F.lit(float("inf"))).alias("need"))
    second = write_once(_search(rest.mapInPandas(_other_visits(cells, k), plan), members, sizes, k, block), "knn-second")
    both = first.unionByName(second)
    edges = both.where("nbr IS NOT NULL").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    work = both.groupBy("id").agg(F.sum("compared").alias("compared")).withColumn("points", F.lit(n).cast("long"))
    return edges.drop("compared"), work


def knn_graph(points: DataFrame, id_col: str, vec: str, k: int = 20, queries: DataFrame | None = None,
              block: int = 50_000, pivots: int | None = None) -> DataFrame:
    """Exact k nearest neighbours (Euclidean, no self) as edges ``(id, nbr, rank, dist)``, equal distances by smaller id.

    ``queries(id_col)`` names the points to search for (cluster centres, a sample); without
    it every point is a query. Rows without a vector are no points.
    """
    return knn_search(points, id_col, vec, k, queries, block, pivots)[0]
