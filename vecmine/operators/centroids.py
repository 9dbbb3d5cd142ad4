"""Per-cluster means and nearest-representative assignment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distances import block_distance, measure
from ..session import collect_bounded
from .pairs import CHUNK_CELLS, bound, matrix, nearest


def cluster_sizes(points: DataFrame, key: str = "prediction") -> DataFrame:
    return points.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def centroids(points: DataFrame, key: str = "prediction") -> DataFrame:
    """(key, n, centroid): vectors are summed inside each task, so a shuffle moves one row per task and cluster."""
    vec = array_to_vector("features")
    grouped = points.groupBy(key).agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(vec).alias("m"))
    return grouped.select(key, "n", vector_to_array("m").alias("centroid"))


def dims_of(points: DataFrame) -> int:
    row = points.select(F.size("features").alias("d")).first()
    return row["d"] if row else 0


class Representatives:
    """k vectors, either on the executors (checked size) or as a DataFrame for the tile join."""

    def __init__(self, reps: DataFrame, dims: int):
        """`reps` has columns (id long, features array<double>)."""
        self.frame = reps
        rows = collect_bounded(reps, 8 * dims + 16)
        self.local = None
        if rows is not None:
            rows = sorted(rows, key=lambda r: r["id"])
            self.local = (np.array([r["id"] for r in rows], dtype=np.int64),
                          np.array([r["features"] for r in rows], dtype=np.float64))


def nearest_index(X: np.ndarray, reps: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(position, score) of the nearest representative of every row, first wins ties."""
    pos = np.empty(len(X), dtype=np.int64)
    score = np.empty(len(X))
    step = max(1, CHUNK_CELLS // max(1, len(reps)))
    for s in range(0, len(X), step):
        d = block_distance(metric, X[s:s + step], reps)
        bad = measure(metric).badness_np(d)
        p = np.argmin(np.where(np.isnan(bad), np.inf, bad), axis=1)
        pos[s:s + step] = p
        score[s:s + step] = d[np.arange(len(p)), p]
    return pos, score


def assign_nearest(points: DataFrame, reps: Representatives, metric: str = "euclidean",
                   out: str = "prediction", dist: str = "distance") -> DataFrame:
    """Points with the id of the closest representative and its distance."""
    metric = bound(points, metric)
    base = points.drop(out, dist)
    if reps.local is not None:
        shared = points.sparkSession.sparkContext.broadcast(reps.local)

        @F.arrow_udf("struct<rep: bigint, score: double>")
        def closest(v: pa.Array) -> pa.Array:
            ids, M = shared.value
            pos, score = nearest_index(matrix(v), M, metric)
            return pa.StructArray.from_arrays([pa.array(ids[pos]), pa.array(score)], names=["rep", "score"])

        hit = base.withColumn("_hit", closest("features"))
        return hit.withColumns({out: F.col("_hit.rep"), dist: F.col("_hit.score")}).drop("_hit")
    found = nearest(base, reps.frame, 1, metric).select(
        "id", F.col("neighbour").alias(out), F.col("score").alias(dist))
    return base.join(found, "id")
