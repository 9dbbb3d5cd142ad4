"""Silhouette of a clustering: exact, estimated from samples, and the cheaper variants."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distances as D
from ..functions import vectors as V
from ..functions.distances import block_distance
from ..session import collect_bounded, cut_lineage, release_unused, settle_small
from .centroids import Representatives, centroids, cluster_sizes, dims_of
from .pairs import CHUNK_CELLS, Block, batch_of, bound, chunks, class_sums, matrix, pack, plan_tiles, shape_of, tile_reduce
from .sampling import Profile, pps_sample, profile, uniform_sample


def _score(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0))


def _checked(prof: Profile) -> Profile:
    if prof.k < 2:
        raise ValueError("a silhouette needs at least two clusters")
    return prof


def _refuse_one_cluster(points: DataFrame) -> None:
    low, high = points.agg(F.min("prediction"), F.max("prediction")).first()
    if low == high:
        raise ValueError("a silhouette needs at least two clusters")


def _finish(sums: DataFrame, sizes: DataFrame, k: int, singleton: str, runs: bool = False) -> DataFrame:
    """From (id, prediction, run, other, total) to (id, prediction[, run], a, b, s)."""
    if singleton not in ("one", "zero"):
        raise ValueError("singleton is 'one' or 'zero'")
    key = ["id", "prediction", "run"] if runs else ["id", "prediction"]
    joined = sums.join(sizes.withColumnRenamed("prediction", "other"), "other")
    own = F.col("other") == F.col("prediction")
    per_point = joined.groupBy(*key).agg(
        F.sum(F.when(own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("nearest"),
        F.count(F.when(~own, True)).alias("seen"),
        F.max(F.when(own, F.col("n") == 1)).alias("alone"),
    )
    # A cluster without any sampled point contributes an estimated total of zero.
    b = F.when(F.col("seen") < k - 1, F.lit(0.0)).otherwise(F.col("nearest"))
    out = per_point.select(*key, F.coalesce("a", F.lit(0.0)).alias("a"), b.alias("b"), "alone")
    s = _score(F.col("a"), F.col("b"))
    if singleton == "zero":
        s = F.when(F.col("alone"), F.lit(0.0)).otherwise(s)
    return out.select(*key, "a", "b", s.alias("s"))


def exact_scores(points: DataFrame, metric: str = "euclidean", singleton: str = "one", **params) -> DataFrame:
    """(id, prediction, a, b, s) for every point, from all pairwise distances."""
    prof = _checked(profile(points))
    return _finish(class_sums(points, metric, shape=(prof.n, prof.d), **params), prof.sizes, prof.k, singleton)


# Up to so many clusters of a block's clusterings, distances are summed by products with their 0/1 columns.
PRODUCT_CLUSTERS = 128
_MANY = pa.schema([("id", pa.int64()), ("conf", pa.int32()), ("prediction", pa.int64()), ("other", pa.int64()), ("total", pa.float64())])


def exact_scores_many(points: DataFrame, metric: str = "euclidean", singleton: str = "one") -> DataFrame:
    """(conf, id, prediction, a, b, s) for several clusterings of the same points, given as an array column `labels` with one cluster
    per clustering. Every distance is computed once; its matrix is then summed by the clusters of each clustering."""
    if singleton not in ("one", "zero"):
        raise ValueError("singleton is 'one' or 'zero'")
    metric = bound(points, metric)
    n, d = shape_of(points)
    confs = points.agg(F.max(F.size("labels"))).first()[0] or 0
    spread = points.select("id", "features", *[F.get("labels", c).cast("long").alias(f"c{c}") for c in range(confs)])
    plan = plan_tiles(points.sparkSession, d, n)
    blocks = pack(spread, plan.left_rows, *[f"c{c}" for c in range(confs)])

    def groups(block: Block):
        """Per clustering: the order of the points by cluster, where clusters start in it, and their names."""
        if not hasattr(block, "groups"):
            block.groups = []
            for c in range(confs):
                own = block.cols[f"c{c}"]
                order = np.argsort(own, kind="stable")
                first = np.flatnonzero(np.r_[True, own[order][1:] != own[order][:-1]])
                block.groups.append((order, first, own[order][first]))
        return block.groups

    def rows(block: Block, conf: int, sums: np.ndarray, names: np.ndarray):
        m, k = sums.shape
        return batch_of(_MANY, np.repeat(block.ids, k), np.full(m * k, conf), np.repeat(block.cols[f"c{conf}"], k), np.tile(names, m), sums.ravel())

    def members(block: Block):
        """The clusters of all clusterings as 0/1 columns, or None where they are too many for products."""
        if not hasattr(block, "members"):
            ends = np.cumsum([0, *[len(first) for _, first, _ in groups(block)]])
            block.members = (np.zeros((len(block), ends[-1])), ends) if ends[-1] <= PRODUCT_CLUSTERS else None
            for c in range(confs) if block.members else ():
                own = np.searchsorted(groups(block)[c][2], block.cols[f"c{c}"])
                block.members[0][np.arange(len(block)), ends[c] + own] = 1.0
        return block.members

    def kernel(L: Block, R: Block):
        left = [np.zeros((len(L), len(first))) for _, first, _ in groups(R)]
        right = [np.zeros((len(R), len(first))) for _, first, _ in groups(L)]
        for part, dist in chunks(L, R, metric):
            if members(L) and members(R):
                (ml, el), (mr, er) = members(L), members(R)
                of_left, of_right = dist @ mr, dist.T @ ml[part]
                # A distance that is no number spoils products of other clusters; each row and column shows it.
                if np.isfinite(of_left).all():
                    for c in range(confs):
                        left[c][part] = of_left[:, er[c]:er[c + 1]]
                        right[c] += of_right[:, el[c]:el[c + 1]]
                    continue
            for c in range(confs):
                order, first, _ = groups(R)[c]
                left[c][part] = np.add.reduceat(dist[:, order], first, axis=1)
                if L.key != R.key:
                    # Clusters of this slice of the left block, added to where they belong.
                    own, names = L.cols[f"c{c}"][part], groups(L)[c][2]
                    by = np.argsort(own, kind="stable")
                    at = np.flatnonzero(np.r_[True, own[by][1:] != own[by][:-1]])
                    right[c][:, np.searchsorted(names, own[by][at])] += np.add.reduceat(dist[by], at, axis=0).T
        for c in range(confs):
            yield rows(L, c, left[c], groups(R)[c][2])
            if L.key != R.key:
                yield rows(R, c, right[c], groups(L)[c][2])

    parts = tile_reduce(blocks, None, kernel, "id long, conf int, prediction long, other long, total double", plan)
    sums = parts.groupBy("conf", "id", "prediction", "other").agg(F.sum("total").alias("total"))
    sizes, _ = settle_small(spread.select(F.posexplode(F.array(*[f"c{c}" for c in range(confs)])).alias("conf", "other"))
                            .groupBy("conf", "other").agg(F.count(F.lit(1)).alias("n")))
    if sizes.groupBy("conf").agg(F.count(F.lit(1)).alias("k")).where("k < 2").count():
        raise ValueError("a silhouette needs at least two clusters")
    own = F.col("other") == F.col("prediction")
    per = sums.join(sizes, ["conf", "other"]).groupBy("conf", "id", "prediction").agg(
        F.coalesce(F.sum(F.when(own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))), F.lit(0.0)).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"), F.max(F.when(own, F.col("n") == 1)).alias("alone"))
    s = _score(F.col("a"), F.col("b"))
    if singleton == "zero":
        s = F.when(F.col("alone"), F.lit(0.0)).otherwise(s)
    return per.select("conf", "id", "prediction", "a", "b", s.alias("s"))


def labelled_together(configs: dict[int, DataFrame]) -> tuple[DataFrame, list[int]]:
    """Points with `labels`, one cluster per configuration, and the configurations in that order; points must be the same in all."""
    confs = sorted(configs)
    out = configs[confs[0]].select("id", "features", F.col("prediction").alias("p0"))
    for i, conf in enumerate(confs[1:], 1):
        out = out.join(configs[conf].select("id", F.col("prediction").alias(f"p{i}")), "id")
    return out.select("id", "features", F.array(*[f"p{i}" for i in range(len(confs))]).alias("labels")), confs


def summarize(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("prediction").alias("k"), F.avg("s").alias("silh"))


def by_cluster(scores: DataFrame) -> DataFrame:
    return scores.groupBy("prediction").agg(
        F.count(F.lit(1)).alias("n"), F.avg("s").alias("avg_s"), F.min("s").alias("min_s"), F.max("s").alias("max_s"))


def sample_size(n: int, k: int, eps: float = 0.1, delta: float = 0.1) -> int:
    """Sample size per cluster for error `eps` with probability 1 - `delta`."""
    return math.ceil((math.log(4) + math.log(n) + math.log(k) - math.log(delta)) / (2 * eps * eps))


def sample_size_table(points: DataFrame, eps: float = 0.1, delta: float = 0.1) -> DataFrame:
    counted = points.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("prediction").alias("k"))
    bound = (F.lit(math.log(4) - math.log(delta)) + F.log("n") + F.log("k")) / F.lit(2 * eps * eps)
    return counted.select("n", "k", F.ceil(bound).alias("t"))


# ---- estimation from a sample --------------------------------------------------------------------

_EST = pa.schema([("id", pa.int64()), ("prediction", pa.int64()), ("run", pa.int32()),
                  ("a", pa.float64()), ("b", pa.float64()), ("s", pa.float64())])
_RUN = pa.schema([("run", pa.int32()), ("total", pa.float64()), ("n", pa.int64())])


def _gather(points: DataFrame, sample: DataFrame, prof: Profile):
    """Sample and cluster sizes as arrays when both are small enough to ship, else None."""
    if prof.n_of is None:
        return None
    rows = collect_bounded(sample.select("run", "features", "prediction", "pi"), 8 * prof.d + 32)
    if rows is None:
        return None
    n_of = prof.n_of
    classes = np.array(sorted(n_of), dtype=np.int64)
    rows.sort(key=lambda r: (r["run"], r["prediction"]))
    return {
        "classes": classes,
        "sizes": np.array([n_of[c] for c in classes], dtype=np.float64),
        "X": np.array([r["features"] for r in rows], dtype=np.float64).reshape(len(rows), -1),
        "weight": np.array([1.0 / r["pi"] for r in rows]),
        "run": np.array([r["run"] for r in rows], dtype=np.int32),
        "code": np.searchsorted(classes, [r["prediction"] for r in rows]),
    }


def _local_scores(X, pred, shared, runs: int, metric: str, singleton: str, params):
    """a, b, s of shape (rows, runs) against the shipped sample."""
    k = len(shared["classes"])
    slot = shared["run"].astype(np.int64) * k + shared["code"]
    first = np.nonzero(np.r_[True, slot[1:] != slot[:-1]])[0] if len(slot) else np.zeros(0, dtype=np.int64)
    sums = np.zeros((len(X), runs * k))
    if len(slot):
        step = max(1, CHUNK_CELLS // len(slot))
        for s in range(0, len(X), step):
            dist = block_distance(metric, X[s:s + step], shared["X"], **params) * shared["weight"]
            sums[s:s + step, slot[first]] = np.add.reduceat(dist, first, axis=1)
    sums = sums.reshape(len(X), runs, k)
    code = np.searchsorted(shared["classes"], pred)
    rows = np.arange(len(X))
    n_own = shared["sizes"][code]
    own = sums[rows, :, code]
    a = np.where(n_own[:, None] > 1, own / np.maximum(n_own - 1, 1)[:, None], 0.0)
    mean = sums / shared["sizes"]
    mean[rows, :, code] = np.inf
    b = mean.min(axis=2)
    top = np.maximum(a, b)
    s = np.divide(b - a, top, out=np.zeros_like(top), where=top > 0)
    if singleton == "zero":
        s[n_own == 1] = 0.0
    return a, b, s


def estimate_scores(points: DataFrame, sample: DataFrame, runs: int = 1, metric: str = "euclidean",
                    singleton: str = "one", prof: Profile | None = None, **params) -> DataFrame:
    """(id, prediction, run, a, b, s): Horvitz-Thompson estimates of every point's silhouette.

    `sample` has columns (run, id, features, prediction, pi). Points stay where they are while the sample
    fits the broadcast limit; a larger sample meets the points in tiles.
    """
    metric = bound(points, metric)
    prof = _checked(prof or profile(points))
    shared = _gather(points, sample, prof)
    if shared is None:
        weighted = sample.withColumn("weight", 1.0 / F.col("pi"))
        sums = class_sums(points, metric, weighted, shape=(prof.n, prof.d), **params)
        return _finish(sums, prof.sizes, prof.k, singleton, runs=True)
    ship = points.sparkSession.sparkContext.broadcast(shared)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, pred = np.asarray(batch.column("id")), np.asarray(batch.column("prediction"))
            a, b, s = _local_scores(matrix(batch.column("features")), pred, ship.value, runs, metric, singleton, params)
            yield batch_of(_EST, np.repeat(ids, runs), np.repeat(pred, runs),
                           np.tile(np.arange(runs, dtype=np.int32), len(ids)), a.ravel(), b.ravel(), s.ravel())

    return points.select("id", "features", "prediction").mapInArrow(
        run, "id long, prediction long, run int, a double, b double, s double")


def estimate(points: DataFrame, sample: DataFrame, runs: int = 1, metric: str = "euclidean",
             singleton: str = "one", prof: Profile | None = None, **params) -> DataFrame:
    """(run, n, silh): the mean estimate of each run; only per-batch totals leave the tasks."""
    metric = bound(points, metric)
    prof = _checked(prof or profile(points))
    shared = _gather(points, sample, prof)
    if shared is None:
        scores = estimate_scores(points, sample, runs, metric, singleton, prof, **params)
        return scores.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("silh"))
    ship = points.sparkSession.sparkContext.broadcast(shared)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            pred = np.asarray(batch.column("prediction"))
            s = _local_scores(matrix(batch.column("features")), pred, ship.value, runs, metric, singleton, params)[2]
            yield batch_of(_RUN, np.arange(runs, dtype=np.int32), s.sum(axis=0), np.full(runs, len(pred)))

    parts = points.select("features", "prediction").mapInArrow(run, "run int, total double, n long")
    return parts.groupBy("run").agg(
        F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("silh"))


def pps_silhouette(points: DataFrame, t: int | None = None, eps: float = 0.1, delta: float = 0.1,
                   seeds: list[int] = (1,), metric: str = "euclidean", **params) -> DataFrame:
    metric = bound(points, metric)
    prof = profile(points)
    sample = pps_sample(points, t or sample_size(prof.n, prof.k, eps, delta), delta, seeds, metric, prof, **params)
    return estimate(points, sample, len(seeds), metric, prof=prof, **params)


def uniform_silhouette(points: DataFrame, t: int | None = None, eps: float = 0.1, delta: float = 0.1,
                       seeds: list[int] = (1,), metric: str = "euclidean", **params) -> DataFrame:
    metric = bound(points, metric)
    prof = profile(points)
    sample = uniform_sample(points, t or sample_size(prof.n, prof.k, eps, delta), seeds, prof)
    return estimate(points, sample, len(seeds), metric, prof=prof, **params)


# ---- cheaper variants ----------------------------------------------------------------------------

def representatives(points: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(id = cluster, features): the member of each cluster nearest to the cluster's centroid."""
    metric = bound(points, metric)
    m = D.measure(metric)
    cents, _ = settle_small(centroids(points).select("prediction", "centroid"), 8 * dims_of(points) + 32)
    near = points.join(cents, "prediction")
    gap = m.badness(m.column(F.col("features"), F.col("centroid")))
    return near.groupBy("prediction").agg(
        F.min_by("features", F.struct(gap.alias("g"), F.col("id"))).alias("features")
    ).select(F.col("prediction").alias("id"), "features")


def _against_representatives(points: DataFrame, reps: DataFrame, metric: str) -> DataFrame:
    """(id, prediction, own, other): distance to the own representative and to the nearest other one."""
    R = Representatives(reps, dims_of(points))
    if R.local is not None:
        ship = points.sparkSession.sparkContext.broadcast(R.local)

        @F.arrow_udf("struct<own: double, other: double, other_id: bigint>")
        def pair(v: pa.Array, p: pa.Array) -> pa.Array:
            ids, M = ship.value
            X, code = matrix(v), np.searchsorted(ids, np.asarray(p))
            own, other, who = np.empty(len(X)), np.empty(len(X)), np.empty(len(X), dtype=np.int64)
            step = max(1, CHUNK_CELLS // len(ids))
            for s in range(0, len(X), step):
                dist = block_distance(metric, X[s:s + step], M)
                at = np.arange(len(dist)), code[s:s + step]
                own[s:s + step] = dist[at]
                dist[at] = np.inf
                who[s:s + step] = ids[dist.argmin(axis=1)]
                other[s:s + step] = dist.min(axis=1)
            return pa.StructArray.from_arrays([pa.array(own), pa.array(other), pa.array(who)],
                                              names=["own", "other", "other_id"])

        hit = points.withColumn("_r", pair("features", "prediction"))
        return hit.select("id", "features", "prediction", "_r.own", "_r.other", "_r.other_id")
    m = D.measure(metric)
    own = points.join(reps.select(F.col("id").alias("prediction"), F.col("features").alias("rep")), "prediction")
    own = own.withColumn("own", m.column(F.col("features"), F.col("rep"))).drop("rep")
    other = _nearest_foreign(points, reps, metric)
    return own.join(other, "id").select("id", "features", "prediction", "own", "other", "other_id")


def _nearest_foreign(points: DataFrame, reps: DataFrame, metric: str) -> DataFrame:
    """Nearest representative of another cluster, by tiles (for more representatives than can be shipped)."""
    n, d = shape_of(points)
    m, _ = shape_of(reps)
    plan = plan_tiles(points.sparkSession, d, n, m)
    schema = pa.schema([("id", pa.int64()), ("other", pa.float64()), ("other_id", pa.int64())])

    def kernel(L: Block, R: Block):
        for part, dist in chunks(L, R, metric):
            dist[L.cols["prediction"][part][:, None] == R.ids[None, :]] = np.inf
            best = np.lexsort((R.ids,))[dist[:, np.lexsort((R.ids,))].argmin(axis=1)]
            yield batch_of(schema, L.ids[part], dist[np.arange(len(dist)), best], R.ids[best])

    found = tile_reduce(pack(points, plan.left_rows, "prediction"), pack(reps, plan.right_rows), kernel,
                        "id long, other double, other_id long", plan)
    return found.groupBy("id").agg(
        F.min("other").alias("other"), F.min_by("other_id", F.struct("other", "other_id")).alias("other_id"))


def simplified_scores(points: DataFrame, metric: str = "euclidean") -> DataFrame:
    """a and b are distances to the nearest-to-centroid members of the own and the closest other cluster."""
    metric = bound(points, metric)
    _refuse_one_cluster(points)
    seen = _against_representatives(points, representatives(points, metric), metric)
    return seen.select("id", "prediction", F.col("own").alias("a"), F.col("other").alias("b"),
                       _score(F.col("own"), F.col("other")).alias("s"))


def simplified_centroid_scores(points: DataFrame) -> DataFrame:
    """Centroid variant: squared distances over n-1 (own) and n (each other cluster)."""
    _refuse_one_cluster(points)
    stats = centroids(points).select(
        F.col("prediction").alias("id"), F.col("centroid").alias("features"), "n",
        (1.0 / F.col("n")).alias("scale"), F.lit(0.0).alias("shift"))
    return _by_centroid(points, stats, lambda d2, n, shift: d2 / (n - 1))


def _by_centroid(points: DataFrame, stats: DataFrame, own_value) -> DataFrame:
    """a from the own centroid's squared distance, b = min over other clusters of scale * d2 + shift."""
    rows = collect_bounded(stats, 8 * dims_of(points) + 64)
    if rows is None:
        return _by_centroid_tiles(points, stats, own_value)
    rows.sort(key=lambda r: r["id"])
    ship = points.sparkSession.sparkContext.broadcast(
        {c: np.array([r[c] for r in rows]) for c in ("id", "features", "n", "scale", "shift")})

    @F.arrow_udf("struct<d2: double, n: bigint, shift: double, b: double>")
    def pair(v: pa.Array, p: pa.Array) -> pa.Array:
        c = ship.value
        d2 = block_distance("sq_euclidean", matrix(v), c["features"])
        at = np.arange(len(d2)), np.searchsorted(c["id"], np.asarray(p))
        own = d2[at]
        d2 = d2 * c["scale"] + c["shift"]
        d2[at] = np.inf
        return pa.StructArray.from_arrays(
            [pa.array(own), pa.array(c["n"][at[1]]), pa.array(c["shift"][at[1]]), pa.array(d2.min(axis=1))],
            names=["d2", "n", "shift", "b"])

    hit = points.withColumn("_r", pair("features", "prediction"))
    return _centroid_result(hit.select("id", "prediction", "_r.d2", "_r.n", "_r.shift", "_r.b"), own_value)


def _centroid_result(seen: DataFrame, own_value) -> DataFrame:
    a = F.when(F.col("n") > 1, own_value(F.col("d2"), F.col("n").cast("double"), F.col("shift"))).otherwise(F.lit(0.0))
    return seen.select("id", "prediction", "n", a.alias("a"), "b").select(
        "id", "prediction", "n", "a", "b", _score(F.col("a"), F.col("b")).alias("s"))


def _by_centroid_tiles(points: DataFrame, stats: DataFrame, own_value) -> DataFrame:
    n, d = shape_of(points)
    plan = plan_tiles(points.sparkSession, d, n, shape_of(stats)[0])
    schema = pa.schema([("id", pa.int64()), ("b", pa.float64())])

    def kernel(L: Block, R: Block):
        for part, d2 in chunks(L, R, "sq_euclidean"):
            d2 = d2 * R.cols["scale"] + R.cols["shift"]
            d2[L.cols["prediction"][part][:, None] == R.ids[None, :]] = np.inf
            yield batch_of(schema, L.ids[part], d2.min(axis=1))

    found = tile_reduce(pack(points, plan.left_rows, "prediction"), pack(stats, plan.right_rows, "scale", "shift"),
                        kernel, "id long, b double", plan).groupBy("id").agg(F.min("b").alias("b"))
    own = points.join(stats.select(F.col("id").alias("prediction"), F.col("features").alias("c"), "n", "shift"), "prediction")
    own = own.select("id", "prediction", "n", "shift", D.sq_euclidean(F.col("features"), F.col("c")).alias("d2"))
    return _centroid_result(own.join(found, "id"), own_value)


def frahling_sohler_scores(points: DataFrame, metric: str = "euclidean") -> DataFrame:
    """Exact sums, but only to the own cluster and to the one whose centroid is the nearest other."""
    metric = bound(points, metric)
    _refuse_one_cluster(points)
    cents = centroids(points).select(F.col("prediction").alias("id"), F.col("centroid").alias("features"))
    seen = _against_representatives(points, cents, metric).select(
        "id", "features", "prediction", F.col("other_id").alias("neighbour"))
    n, d = shape_of(points)
    plan = plan_tiles(points.sparkSession, d, n, n)
    lblocks = pack(seen, plan.left_rows, by=("prediction", "neighbour"))
    rblocks = pack(points, plan.right_rows, by=("prediction",))
    schema = pa.schema([("id", pa.int64()), ("prediction", pa.int64()), ("neighbour", pa.int64()),
                        ("own", pa.float64()), ("near", pa.float64())])

    def kernel(L: Block, R: Block):
        is_own = R.cols["prediction"][0] == L.cols["prediction"][0]
        for part, dist in chunks(L, R, metric):
            total = dist.sum(axis=1)
            none = np.zeros(len(total))
            yield batch_of(schema, L.ids[part], L.cols["prediction"][part], L.cols["neighbour"][part],
                           total if is_own else none, none if is_own else total)

    sums = tile_reduce(lblocks, rblocks, kernel,
                       "id long, prediction long, neighbour long, own double, near double", plan,
                       want=("prediction", "neighbour"), have="prediction")
    sums = sums.groupBy("id", "prediction", "neighbour").agg(F.sum("own").alias("own"), F.sum("near").alias("near"))
    sizes, _ = settle_small(cluster_sizes(points))
    full = sums.join(sizes.withColumnRenamed("n", "n_own"), "prediction").join(
        sizes.select(F.col("prediction").alias("neighbour"), F.col("n").alias("n_near")), "neighbour")
    a = F.coalesce(F.try_divide("own", F.col("n_own") - 1), F.lit(0.0))
    b = F.col("near") / F.col("n_near")
    return full.select("id", "prediction", a.alias("a"), b.alias("b"), _score(a, b).alias("s"))


def sq_euclidean_scores(points: DataFrame, singleton: str = "zero") -> DataFrame:
    """Squared-Euclidean silhouette in closed form, linear in the points: the mean squared distance from x to a
    cluster is |x - centroid|^2 plus the cluster's mean squared spread, so one aggregate per cluster is enough."""
    _refuse_one_cluster(points)
    vec = array_to_vector("features")
    stats = points.groupBy("prediction").agg(
        F.count(F.lit(1)).alias("n"), Summarizer.mean(vec).alias("m"),
        F.avg(V.dot(F.col("features"), F.col("features"))).alias("sq"))
    stats = stats.select(F.col("prediction").alias("id"), "n", vector_to_array("m").alias("features"), "sq")
    stats = stats.select("id", "features", "n", F.lit(1.0).alias("scale"),
                         F.greatest(F.col("sq") - V.dot(F.col("features"), F.col("features")), F.lit(0.0)).alias("shift"))
    scores = _by_centroid(points, stats, lambda d2, n, shift: (d2 + shift) * n / (n - 1))
    if singleton == "zero":
        scores = scores.withColumn("s", F.when(F.col("n") == 1, F.lit(0.0)).otherwise(F.col("s")))
    return scores


def builtin_sq_euclidean(points: DataFrame) -> float:
    """The same score from Spark's own evaluator."""
    data = points.select(array_to_vector("features").alias("features"), F.col("prediction").cast("double").alias("prediction"))
    return ClusteringEvaluator(metricName="silhouette", distanceMeasure="squaredEuclidean").evaluate(data)


# ---- comparing clusterings and estimators --------------------------------------------------------

def rank_configurations(scores: DataFrame) -> DataFrame:
    """(conf, silh) with rank 1 for the largest score, ties to the first configuration."""
    best = scores.agg(F.max_by("conf", F.struct(F.col("silh"), -F.col("conf")))).scalar()
    return scores.withColumn("best", F.col("conf") == best)


def _exact_of(configs: dict[int, DataFrame], metric) -> DataFrame:
    """(conf, exact) of all configurations from one pass over the pairs of points."""
    points, confs = labelled_together(configs)
    scores = exact_scores_many(cut_lineage(points), metric).groupBy("conf").agg(F.avg("s").alias("exact"))
    return cut_lineage(scores.select(F.get(F.array(*map(F.lit, confs)), F.col("conf")).alias("conf"), "exact"))


def error_study(configs: dict[int, DataFrame], t: int, runs: int, delta: float = 0.1,
                metric: str = "euclidean", methods: tuple[str, ...] = ("pps", "uniform")) -> DataFrame:
    """(method, conf, run, exact, estimate, error, chosen, hit) for repeated estimates of several clusterings.

    All runs of one configuration and method share one pass over the points.
    """
    seeds = list(range(1, runs + 1))
    exact, rows = _exact_of(configs, metric), None
    for conf, points in configs.items():
        for method in methods:
            call = pps_silhouette if method == "pps" else uniform_silhouette
            est = call(points, t, delta=delta, seeds=seeds, metric=metric).select(
                F.lit(method).alias("method"), F.lit(conf).alias("conf"), "run", F.col("silh").alias("estimate"))
            rows = est if rows is None else rows.unionByName(est)
    rows = cut_lineage(rows)
    truth = exact.agg(F.max_by("conf", F.struct(F.col("exact"), -F.col("conf")))).scalar()
    chosen = rows.groupBy("method", "run").agg(
        F.max_by("conf", F.struct(F.col("estimate"), -F.col("conf"))).alias("chosen"))
    return rows.join(exact, "conf").join(chosen, ["method", "run"]).select(
        "method", "conf", "run", "exact", "estimate", F.abs(F.col("exact") - F.col("estimate")).alias("error"),
        "chosen", (F.col("chosen") == truth).alias("hit"))


def error_summary(study: DataFrame) -> DataFrame:
    """Per method and configuration: largest, mean and population variance of the error; share of right choices."""
    return study.groupBy("method", "conf").agg(
        F.count(F.lit(1)).alias("runs"), F.max("error").alias("max_error"), F.avg("error").alias("avg_error"),
        F.var_pop("error").alias("var_error"), F.avg(F.col("hit").cast("double")).alias("share_correct"))


def method_comparison(configs: dict[int, DataFrame], t: int, runs: int, delta: float = 0.1,
                      metric: str = "euclidean") -> DataFrame:
    """(conf, method, score, error): mean of `runs` estimates, simplified and nearest-centroid scores vs exact.

    A score from pairs of points is settled before the next begins, so that the copies of points they move are never on disk together.
    """
    seeds = list(range(1, runs + 1))
    rows = None

    def add(conf, method, df):
        nonlocal rows
        one = df.select(F.lit(conf).alias("conf"), F.lit(method).alias("method"), F.col("silh").alias("score"))
        rows = one if rows is None else rows.unionByName(one)

    exact = _exact_of(configs, metric)
    release_unused(next(iter(configs.values())).sparkSession)
    for conf, points in configs.items():
        add(conf, "exact", exact.where(F.col("conf") == conf).select(F.col("exact").alias("silh")))
        add(conf, "pps", pps_silhouette(points, t, delta=delta, seeds=seeds, metric=metric).agg(F.avg("silh").alias("silh")))
        add(conf, "uniform", uniform_silhouette(points, t, delta=delta, seeds=seeds, metric=metric).agg(F.avg("silh").alias("silh")))
        add(conf, "simplified", summarize(simplified_scores(points, metric)))
        add(conf, "frahling_sohler", cut_lineage(summarize(frahling_sohler_scores(points, metric))))
        release_unused(points.sparkSession)
    rows = cut_lineage(rows)
    return rows.join(exact, "conf").select(
        "conf", "method", "score", F.abs(F.col("score") - F.col("exact")).alias("error"))


def report(kind: str, summary: DataFrame, seconds: float) -> DataFrame:
    """One result line: type, n, k, silh, time."""
    return summary.select(F.lit(kind).alias("type"), "n", "k", "silh", F.lit(float(seconds)).alias("time"))
