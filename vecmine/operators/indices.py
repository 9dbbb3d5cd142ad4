"""Cluster-quality indices. Pairwise ones share one aggregate over all pairs; the rest need per-cluster sums only."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distances as D
from ..functions import vectors as V
from ..functions.special import log_gamma
from ..session import settle_small
from .centroids import centroids, dims_of
from .pairs import Block, batch_of, chunks, pack, plan_tiles, shape_of, tile_reduce

# Which score is better, per index ("larger", "smaller" or "smaller magnitude").
DIRECTION = {
    "sse": "smaller", "avg_pairwise_sim": "larger", "centroid_sim": "larger", "trace_scatter": "smaller",
    "hybrid_centroid": "larger", "hybrid_pairwise": "larger", "minmaxcut": "smaller", "c_index": "smaller",
    "gamma": "larger", "gplus": "smaller", "tau": "larger", "wb": "smaller", "point_biserial": "larger",
    "aic": "smaller magnitude", "bic": "larger",
}


def better(index: str, new: float, old: float) -> bool:
    way = DIRECTION[index]
    if way == "larger":
        return new > old
    return new < old if way == "smaller" else abs(new) < abs(old)


def _upper(L: Block, R: Block, part: slice) -> np.ndarray | None:
    """Inside one block only positions i < j count."""
    if L.key != R.key:
        return None
    rows = np.arange(part.start, part.stop)
    return rows[:, None] < np.arange(len(R))[None, :]


_PAIR = pa.schema([("prediction", pa.int64()), ("fw", pa.int64()), ("dw", pa.float64()), ("dw2", pa.float64()),
                   ("wmin", pa.float64()), ("wmax", pa.float64()), ("fb", pa.int64()), ("db", pa.float64()),
                   ("db2", pa.float64()), ("dout", pa.float64())])


def pair_statistics(points: DataFrame, metric: str = "euclidean", **params) -> DataFrame:
    """Per cluster over unordered pairs: within (fw, dw, dw2, wmin, wmax), between pairs booked on the lower cluster
    id (fb, db, db2), and `dout`, the total distance of its points to all points of other clusters."""
    n, d = shape_of(points)
    plan = plan_tiles(points.sparkSession, d, n)

    def kernel(L: Block, R: Block):
        classes = np.unique(np.r_[L.cols["prediction"], R.cols["prediction"]])
        lc = np.searchsorted(classes, L.cols["prediction"])
        rc = np.searchsorted(classes, R.cols["prediction"])
        k = len(classes)
        acc = {f.name: np.zeros(k) for f in _PAIR if f.name != "prediction"}
        acc["wmin"][:], acc["wmax"][:] = np.inf, -np.inf

        def book(name, codes, values):
            acc[name] += np.bincount(codes, weights=values, minlength=k)

        for part, dist in chunks(L, R, metric, **params):
            a, b = lc[part][:, None], rc[None, :]
            keep = _upper(L, R, part)
            same, low, high = a == b, a < b, a > b
            if keep is not None:
                same, low, high = same & keep, low & keep, high & keep
            d2 = dist * dist
            book("fw", lc[part], same.sum(axis=1))
            book("dw", lc[part], np.where(same, dist, 0).sum(axis=1))
            book("dw2", lc[part], np.where(same, d2, 0).sum(axis=1))
            np.minimum.at(acc["wmin"], lc[part], np.where(same, dist, np.inf).min(axis=1))
            np.maximum.at(acc["wmax"], lc[part], np.where(same, dist, -np.inf).max(axis=1))
            lowd, highd = np.where(low, dist, 0), np.where(high, dist, 0)
            book("fb", lc[part], low.sum(axis=1))
            book("fb", rc, high.sum(axis=0))
            book("db", lc[part], lowd.sum(axis=1))
            book("db", rc, highd.sum(axis=0))
            book("db2", lc[part], np.where(low, d2, 0).sum(axis=1))
            book("db2", rc, np.where(high, d2, 0).sum(axis=0))
            both = lowd + highd
            book("dout", lc[part], both.sum(axis=1))
            book("dout", rc, both.sum(axis=0))
        yield batch_of(_PAIR, classes, acc["fw"].astype(np.int64), acc["dw"], acc["dw2"], acc["wmin"], acc["wmax"],
                       acc["fb"].astype(np.int64), acc["db"], acc["db2"], acc["dout"])

    ddl = "prediction long, fw long, dw double, dw2 double, wmin double, wmax double, fb long, db double, db2 double, dout double"
    parts = tile_reduce(pack(points, plan.left_rows, "prediction"), None, kernel, ddl, plan)
    return parts.groupBy("prediction").agg(
        *[F.sum(c).alias(c) for c in ("fw", "dw", "dw2")], F.min("wmin").alias("wmin"), F.max("wmax").alias("wmax"),
        *[F.sum(c).alias(c) for c in ("fb", "db", "db2", "dout")])


def between_against(points: DataFrame, limits: DataFrame, metric: str = "euclidean", **params) -> DataFrame:
    """(below, above): between pairs nearer / farther than the limit of the pair's lower cluster.

    `limits` is (prediction, lim); it rides along with the points, so nothing is broadcast.
    """
    known = points.select("id", "features", "prediction").join(settle_small(limits)[0], "prediction")
    n, d = shape_of(points)
    plan = plan_tiles(points.sparkSession, d, n)
    schema = pa.schema([("below", pa.int64()), ("above", pa.int64())])

    def kernel(L: Block, R: Block):
        below = above = 0
        for part, dist in chunks(L, R, metric, **params):
            a, b = L.cols["prediction"][part][:, None], R.cols["prediction"][None, :]
            lim = np.where(a < b, L.cols["lim"][part][:, None], R.cols["lim"][None, :])
            keep = a != b
            up = _upper(L, R, part)
            if up is not None:
                keep &= up
            below += int(((dist < lim) & keep).sum())
            above += int(((dist > lim) & keep).sum())
        yield batch_of(schema, [below], [above])

    parts = tile_reduce(pack(known, plan.left_rows, "prediction", "lim"), None, kernel, "below long, above long", plan)
    return parts.agg(F.sum("below").alias("below"), F.sum("above").alias("above"))


def _one(df: DataFrame, value: Column) -> DataFrame:
    return df.select(value.alias("score"))


# ---- from per-cluster sums -----------------------------------------------------------------------

def sse(points: DataFrame) -> DataFrame:
    """Sum over clusters of squared distances over ordered pairs divided by the cluster size: 2 (n psi - Y.Y) / n."""
    per = points.groupBy("prediction").agg(
        F.count(F.lit(1)).alias("n"), Summarizer.sum(array_to_vector("features")).alias("y"),
        F.sum(V.dot(F.col("features"), F.col("features"))).alias("psi"))
    per = per.withColumn("y", vector_to_array("y"))
    return per.agg(F.sum(2 * (F.col("n") * F.col("psi") - V.dot(F.col("y"), F.col("y"))) / F.col("n")).alias("score"))


def kmeans_cost(points: DataFrame) -> DataFrame:
    """Sum of squared distances to the cluster centroid: half of `sse`."""
    return sse(points).select((F.col("score") / 2).alias("cost"))


def centroid_similarity(points: DataFrame) -> DataFrame:
    cents, _ = settle_small(centroids(points).select("prediction", "centroid"), 8 * dims_of(points) + 32)
    return points.join(cents, "prediction").agg(
        F.sum(D.cosine_similarity(F.col("features"), F.col("centroid"))).alias("score"))


def trace_scatter(points: DataFrame) -> DataFrame:
    cents = centroids(points)
    center = points.agg(Summarizer.mean(array_to_vector("features")).alias("m")).select(vector_to_array("m")).scalar()
    return cents.withColumn("g", center).agg(
        F.sum(F.col("n") * D.cosine_similarity(F.col("centroid"), F.col("g"))).alias("score"))


def _ratio(top: DataFrame, bottom: DataFrame) -> DataFrame:
    return top.select((F.col("score") / bottom.scalar()).alias("score"))


def hybrid_centroid(points: DataFrame) -> DataFrame:
    return _ratio(centroid_similarity(points), trace_scatter(points))


def hybrid_pairwise(points: DataFrame) -> DataFrame:
    return _ratio(avg_pairwise_similarity(points), trace_scatter(points))


def _likelihood(points: DataFrame) -> DataFrame:
    """(l, n): normal-gamma marginal log-likelihood, each cluster counted once per attribute."""
    sums = points.select("prediction", F.size("features").alias("d"), V.total(F.col("features")).alias("s"),
                         V.dot(F.col("features"), F.col("features")).alias("s2"))
    per = sums.groupBy("prediction").agg(F.count(F.lit(1)).alias("rows"), F.max("d").alias("d"),
                                         F.sum("d").cast("double").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2"))
    a0 = b0 = l0 = 0.1  # prior shape, rate and precision; prior mean 0
    n, s, s2 = F.col("n"), F.col("s"), F.col("s2")
    l1, a1 = n + l0, n * 0.5 + a0
    b1 = F.lit(b0) + 0.5 * (s2 - s * s / n) + l0 * s * s / (2 * l1 * n)
    ll = (-0.5 * n * math.log(2 * math.pi) + (0.5 * math.log(l0) + a0 * math.log(b0) - math.lgamma(a0))
          + log_gamma(a1) - a1 * F.log(b1) - 0.5 * F.log(l1))
    return per.agg(F.sum(ll * F.col("d")).alias("l"), F.sum("rows").cast("double").alias("n"))


def aic(points: DataFrame) -> DataFrame:
    return _one(_likelihood(points), -2 * F.col("l") + 2)


def bic(points: DataFrame) -> DataFrame:
    return _one(_likelihood(points), -2 * F.col("l") + F.log10("n"))


# ---- from the pair aggregate ---------------------------------------------------------------------

def avg_pairwise_similarity(points: DataFrame, metric: str = "cosine_similarity") -> DataFrame:
    """Sum over clusters of the mean similarity over ordered pairs (a point with itself included) times its size."""
    m = D.measure(metric)
    itself = points.groupBy("prediction").agg(
        F.count(F.lit(1)).alias("n"), F.sum(m.column(F.col("features"), F.col("features"))).alias("own"))
    stats = pair_statistics(points, metric)
    return itself.join(stats, "prediction").agg(F.sum((2 * F.col("dw") + F.col("own")) / F.col("n")).alias("score"))


def minmaxcut(points: DataFrame, metric: str = "euclidean") -> DataFrame:
    s = pair_statistics(points, metric)
    return s.agg(F.sum(F.try_divide(F.col("dout") + 2 * F.col("dw"), 2 * F.col("dw"))).alias("score"))


def c_index(points: DataFrame, metric: str = "euclidean") -> DataFrame:
    s = pair_statistics(points, metric).agg(F.sum("dw").alias("dw"), F.min("wmin").alias("lo"), F.max("wmax").alias("hi"))
    return _one(s, F.try_divide(F.col("dw") - F.col("lo"), F.col("hi") - F.col("lo")))


def _counts(points: DataFrame, metric: str, per_cluster: bool) -> DataFrame:
    """(below, above, fw, fb): between pairs against the largest within distance, overall or per cluster."""
    stats, _ = settle_small(pair_statistics(points, metric), 128)
    floor = F.greatest(F.col("wmax"), F.lit(0.0))
    if per_cluster:
        limits = stats.select("prediction", floor.alias("lim"))
    else:
        limits = stats.select("prediction", F.greatest(stats.agg(F.max("wmax")).scalar(), F.lit(0.0)).alias("lim"))
    hits = between_against(points, limits, metric)
    totals = stats.agg(F.sum("fw").alias("fw"), F.sum("fb").alias("fb"))
    return hits.select("below", "above", totals.select(F.struct("fw", "fb")).scalar().alias("t")).select(
        F.col("below").cast("double").alias("below"), F.col("above").cast("double").alias("above"),
        F.col("t.fw").cast("double").alias("fw"), F.col("t.fb").cast("double").alias("fb"))


def gamma(points: DataFrame, metric: str = "euclidean") -> DataFrame:
    c = _counts(points, metric, False)
    return _one(c, F.try_divide(F.col("above") - F.col("below"), F.col("above") + F.col("below")))


def gplus(points: DataFrame, metric: str = "euclidean") -> DataFrame:
    c = _counts(points, metric, False)
    nd = F.col("fw") + F.col("fb")
    return _one(c, F.try_divide(2 * F.col("below"), nd * (nd - 1)))


def tau(points: DataFrame, metric: str = "euclidean") -> DataFrame:
    c = _counts(points, metric, True)
    nd = F.col("fw") + F.col("fb")
    half = nd * (nd - 1) / 2
    t = F.col("fw") + 2 * F.col("fb")
    return _one(c, F.try_divide(F.col("above") - F.col("below"), F.sqrt((half - t) * half)))


def wb(points: DataFrame, metric: str = "euclidean") -> DataFrame:
    s = pair_statistics(points, metric).agg(*[F.sum(c).alias(c) for c in ("fw", "dw", "fb", "db")])
    return _one(s, F.try_divide(F.col("dw") / F.col("fw"), F.col("db") / F.col("fb")))


def point_biserial(points: DataFrame, metric: str = "euclidean") -> DataFrame:
    s = pair_statistics(points, metric).agg(*[F.sum(c).alias(c) for c in ("fw", "dw", "dw2", "fb", "db", "db2")])
    # Numbers of pairs: their products outgrow 64 bits from some hundred thousand points on.
    fw, fb = F.col("fw").cast("double"), F.col("fb").cast("double")
    nd = fw + fb
    mw, mb = F.col("dw") / fw, F.col("db") / fb
    spread = (F.col("dw2") - fw * mw * mw) + (F.col("db2") - fb * mb * mb)
    return _one(s, F.try_divide((mb - mw) * F.sqrt(fw * fb / (nd * nd)), F.sqrt(spread / nd)))


INDICES = {
    "sse": sse, "avg_pairwise_sim": avg_pairwise_similarity, "centroid_sim": centroid_similarity,
    "trace_scatter": trace_scatter, "hybrid_centroid": hybrid_centroid, "hybrid_pairwise": hybrid_pairwise,
    "minmaxcut": minmaxcut, "c_index": c_index, "gamma": gamma, "gplus": gplus, "tau": tau, "wb": wb,
    "point_biserial": point_biserial, "aic": aic, "bic": bic,
}
