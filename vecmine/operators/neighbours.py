"""Neighbour queries: k nearest, range, box."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distances import measure
from .pairs import Block, batch_of, bound, chunks, nearest, pack, plan_tiles, shape_of, tile_reduce
from .slabs import near_reduce, supported


def knn_join(points: DataFrame, k: int, metric: str = "euclidean", exclude_equal: bool = False, **params) -> DataFrame:
    """(id, neighbour, score, rank) of every point's k nearest other points."""
    return nearest(points, points, k, metric, same=True, exclude_equal=exclude_equal, **params)


def _box_gap(L: Block, R: Block) -> float:
    """A lower bound of any Euclidean, Chebyshev or Manhattan distance between two blocks (per-axis gap)."""
    gap = np.maximum(R.X.min(axis=0) - L.X.max(axis=0), L.X.min(axis=0) - R.X.max(axis=0))
    return float(np.nanmax(np.r_[gap, 0.0]))


def _bounded_below(metric: str) -> bool:
    return metric in ("euclidean", "manhattan", "chebyshev")


def range_join(points: DataFrame, eps: float, metric: str = "euclidean", **params) -> DataFrame:
    """(id, other, distance) with id < other and distance < eps. Under a norm, only blocks of points that may be near meet."""
    metric = bound(points, metric)
    schema = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("distance", pa.float64())])

    def kernel(L: Block, R: Block):
        if _bounded_below(metric) and L.key != R.key and _box_gap(L, R) >= eps:
            return
        for part, dist in chunks(L, R, metric, **params):
            near = measure(metric).badness_np(dist) < eps
            if L.key == R.key:
                near &= np.arange(part.start, part.stop)[:, None] < np.arange(len(R))[None, :]
            i, j = np.nonzero(near)
            a, b = L.ids[part][i], R.ids[j]
            yield batch_of(schema, np.minimum(a, b), np.maximum(a, b), dist[i, j])

    return _pairs_within(points, kernel, "id long, other long, distance double", eps, metric)


def _pairs_within(points: DataFrame, kernel, schema: str, eps: float, metric: str) -> DataFrame:
    """The kernel over pairs of blocks: all that may hold near points under a norm, else all pairs."""
    if supported(metric):
        return near_reduce(points, None, kernel, schema, eps, metric)
    n, d = shape_of(points)
    plan = plan_tiles(points.sparkSession, d, n)
    return tile_reduce(pack(points, plan.left_rows), None, kernel, schema, plan)


def neighbour_counts(points: DataFrame, eps: float, metric: str = "euclidean", **params) -> DataFrame:
    """(id, degree): how many points, the point itself included, are nearer than eps. No pair leaves a task."""
    metric = bound(points, metric)
    schema = pa.schema([("id", pa.int64()), ("degree", pa.int64())])

    def kernel(L: Block, R: Block):
        if _bounded_below(metric) and L.key != R.key and _box_gap(L, R) >= eps:
            return
        left, right = np.zeros(len(L), dtype=np.int64), np.zeros(len(R), dtype=np.int64)
        for part, dist in chunks(L, R, metric, **params):
            near = dist < eps
            found = np.count_nonzero(near)
            if found * 16 <= near.size:  # few: counted one by one, and often none
                i, j = np.nonzero(near) if found else (np.zeros(0, np.int64),) * 2
                left[part] = np.bincount(i, minlength=len(near))
                right += np.bincount(j, minlength=len(R))
            else:
                left[part] = near.sum(axis=1)
                right += near.sum(axis=0)
        yield batch_of(schema, L.ids, left)
        if L.key != R.key:
            yield batch_of(schema, R.ids, right)

    parts = _pairs_within(points, kernel, "id long, degree long", eps, metric)
    return parts.groupBy("id").agg(F.sum("degree").alias("degree"))


def box_range(points: DataFrame, low: list[float], high: list[float]) -> DataFrame:
    """Points inside an axis-parallel box, borders included."""
    inside = F.lit(True)
    for i, (a, b) in enumerate(zip(low, high)):
        inside = inside & F.get("features", i).between(F.lit(float(a)), F.lit(float(b)))
    return points.where(inside)
