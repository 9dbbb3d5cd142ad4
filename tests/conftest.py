import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("features", T.ArrayType(T.DoubleType())),
    T.StructField("label", T.StringType()), T.StructField("prediction", T.LongType()),
])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.vecmine.tileWork", "4000")  # several tiles even for tiny inputs
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """(features, clusters) to points; labels are the cluster ids as text."""
    def build(rows, clusters=None, labels=None):
        clusters = clusters if clusters is not None else [0] * len(rows)
        labels = labels if labels is not None else [str(c) for c in clusters]
        data = [(i, [float(x) for x in r], lab, int(c)) for i, (r, c, lab) in enumerate(zip(rows, clusters, labels))]
        return spark.createDataFrame(data, SCHEMA)
    return build


@pytest.fixture
def tiles_only(spark):
    """Nothing fits the broadcast limit: every operator must take its other way."""
    spark.conf.set("spark.vecmine.broadcastBytes", "1")
    yield
    spark.conf.unset("spark.vecmine.broadcastBytes")


@pytest.fixture(scope="session")
def blobs():
    """120 points in 5-D around three centres of different weight, with some exact copies."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(3, 5)) * 3
    code = rng.choice(3, size=120, p=[0.6, 0.3, 0.1])
    X = centres[code] + rng.normal(size=(120, 5))
    X[10:20] = X[10]
    code[10:20] = code[10]
    return X, code
