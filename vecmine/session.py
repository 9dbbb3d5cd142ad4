"""Session helpers: lineage cuts in the shared folder and size checks for broadcasts."""

from __future__ import annotations

import gc
import os
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

# A side is shipped to every executor only when its payload is below this many bytes.
BROADCAST_BYTES = 32 * 1024 * 1024


def broadcast_limit(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.vecmine.broadcastBytes", str(BROADCAST_BYTES)))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; fall back to a scratch one in local mode only."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="vecmine-checkpoint-")
    sc.setCheckpointDir(shared)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` reliably so later stages and lost executors restart from files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release_unused(spark: SparkSession) -> None:
    """Let go of shuffle files that no live DataFrame needs any more. Spark deletes them when the driver's JVM collects
    their handles, which a driver with little to do would put off while the executors' disks fill up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def narrowed(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """A materialised `df` of `rows` small rows in no more partitions than they are worth: few rows in many partitions
    would make every following exchange write a file per partition."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // most)))


def collect_bounded(df: DataFrame, row_bytes: int) -> list | None:
    """Rows of `df` when they fit the broadcast limit, else None. Never pulls more than the limit + 1 row."""
    most = max(1, broadcast_limit(df.sparkSession) // max(1, row_bytes))
    rows = df.limit(most + 1).collect()
    return rows if len(rows) <= most else None


def one_row(df: DataFrame) -> Column:
    """All columns of a one-row aggregate as a scalar struct, usable in another DataFrame without a join."""
    return df.select(F.struct(*[F.col(c) for c in df.columns]).alias("s")).scalar()


def parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def scratch_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder for written tables, below the shared checkpoint folder."""
    import uuid

    ensure_checkpoint_dir(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return os.path.join(base, f"{tag}-{uuid.uuid4().hex}")


def settle_small(df: DataFrame, row_bytes: int = 64) -> tuple[DataFrame, list | None]:
    """Evaluate a small aggregate once. Within the broadcast limit it comes back as a local relation marked for
    broadcast (plus its rows); beyond it the DataFrame itself comes back and joins shuffle."""
    rows = collect_bounded(df, row_bytes)
    if rows is None:
        return df, None
    local = df.sparkSession.createDataFrame(
        pa.Table.from_pylist([r.asDict() for r in rows], schema=to_arrow_schema(df.schema)), df.schema)
    return F.broadcast(local), rows
