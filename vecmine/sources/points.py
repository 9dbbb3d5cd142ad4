"""Canonical point layout: (id long, features array<double>, label string?, prediction long?)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import row_key
from ..session import collect_bounded


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return balanced(spark.read.parquet(f"{folder}/{name}.parquet"))


def balanced(df: DataFrame) -> DataFrame:
    """Spread an input with fewer splits than cores (small or badly split files); larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def embedding_points(spark: SparkSession, folder: str) -> DataFrame:
    """64-D points; the table's label doubles as a given clustering."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("features"),
        F.col("label").cast("string").alias("label"),
        F.col("label").cast("bigint").alias("prediction"),
    )


def lineitem_points(spark: SparkSession, folder: str) -> DataFrame:
    """4-D points with the return flag as class; the id is derived from the columns that identify a row."""
    key = row_key(
        F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"),
        F.col("l_shipdate").cast("date").cast("string"),
    )
    return table(spark, folder, "lineitem").select(
        key.alias("id"),
        F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("features"),
        F.col("l_returnflag").alias("label"),
        F.ascii("l_returnflag").cast("bigint").alias("prediction"),
    )


def long_form(points: DataFrame, *keep: str) -> DataFrame:
    """(keep..., attr, value): one row per cell, the form attribute-wise aggregates use."""
    return points.select(*keep, F.posexplode("features").alias("attr", "value"))


def spread(points: DataFrame, dims: int, *keep: str, prefix: str = "f") -> DataFrame:
    """Vector cells as columns f0..f{d-1}."""
    return points.select(*keep, *[F.get("features", i).alias(f"{prefix}{i}") for i in range(dims)])


def class_index(points: DataFrame) -> DataFrame:
    """(label, class_index): rank of each class in natural order."""
    names = points.select("label").where(F.col("label").isNotNull()).distinct()
    rows = collect_bounded(names, 64)
    if rows is not None:
        ranked = sorted(r["label"] for r in rows)
        return points.sparkSession.createDataFrame(pa.table({
            "label": pa.array(ranked, pa.string()), "class_index": pa.array(range(len(ranked)), pa.int32())}))
    from ..operators.series import number_rows

    one = names.withColumn("k", F.lit(0))
    return number_rows(one, "k", ["label"]).select("label", F.col("pos").cast("int").alias("class_index"))


def merge_points(*sets: DataFrame) -> DataFrame:
    merged = sets[0]
    for other in sets[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    return merged
