"""Generated point sets; every value is a hash of (id, coordinate, seed), so any partitioning gives the same points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.hashing import hash_uniform
from ..session import one_row
from ..operators.stats import as_row, attribute_stats


def _cells(id_col: Column, dims: int, seed: str) -> Column:
    return F.array(*[hash_uniform(id_col, f"{seed}:{a}") for a in range(dims)])


def _normals(id_col: Column, dims: int, seed: str) -> Column:
    """Standard normal values from pairs of uniforms."""
    def one(a):
        u1 = F.greatest(hash_uniform(id_col, f"{seed}:{a}:r"), F.lit(1e-15))
        return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * hash_uniform(id_col, f"{seed}:{a}:t"))
    return F.array(*[one(a) for a in range(dims)])


def ball_points(spark: SparkSession, elements: int, dims: int = 3, outliers: int = 4, minor: float = 1.0,
                major: float = 10_000.0, seed: int = 1) -> DataFrame:
    """`elements` points uniform in a ball of radius `minor`, and `outliers` on a sphere of radius `major`.

    Direction from normals, radius from the d-th root of a uniform: every row is accepted, so no oversampling.
    """
    rows = spark.range(elements + outliers)
    far = F.col("id") >= elements
    way = _normals(F.col("id"), dims, f"{seed}:way")
    radius = F.when(far, F.lit(float(major))).otherwise(
        F.lit(float(minor)) * F.pow(hash_uniform(F.col("id"), f"{seed}:radius"), F.lit(1.0 / dims)))
    drawn = rows.select("id", way.alias("w"), radius.alias("r"), far.alias("outlier")).withColumn("l", V.norm(F.col("w")))
    return drawn.select("id", F.transform("w", lambda x: x / F.col("l") * F.col("r")).alias("features"), "outlier")


def uniform_points(spark: SparkSession, elements: int, dims: int, seed: int = 1) -> DataFrame:
    return spark.range(elements).select("id", _cells(F.col("id"), dims, f"{seed}:uni").alias("features"))


def gaussian_points(spark: SparkSession, elements: int, dims: int, seed: int = 1) -> DataFrame:
    return spark.range(elements).select("id", _normals(F.col("id"), dims, f"{seed}:gauss").alias("features"))


def random_points_in_box(points: DataFrame, elements: int, dims: int, seed: int = 1) -> DataFrame:
    """Uniform points inside the bounding box of a data set."""
    box = one_row(as_row(attribute_stats(points).select("attr", "min", "max")))
    drawn = uniform_points(points.sparkSession, elements, dims, seed).withColumn("s", box)
    return drawn.select("id", F.transform("features", lambda u, i: F.get("s.min", i) + u * (
        F.get("s.max", i) - F.get("s.min", i))).alias("features"))


def clustered_points(spark: SparkSession, elements: int, k: int, dims: int = 3, outliers: int = 4, minor: float = 1.0, major: float = 10_000.0,
                     seed: int = 1, iterations: int = 100) -> DataFrame:
    """`ball_points` with the k-means cluster of every point as `prediction`, ready to be exported as a clustering."""
    from ..operators.clustering import kmeans

    return kmeans(ball_points(spark, elements, dims, outliers, minor, major, seed), k, iterations, seed=seed)
