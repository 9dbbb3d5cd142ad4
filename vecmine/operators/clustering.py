"""Clusterers. Iterative ones keep only the k centres on the driver; points never leave their partitions.

The centres are shipped to the tasks while they fit the broadcast limit; beyond it the same steps run as tile joins
with the intermediate state written to the checkpoint folder.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distances as D
from ..functions.distances import block_distance, measure
from ..functions.hashing import hash_uniform, hash_uniform_of
from ..session import broadcast_limit, cut_lineage
from .centroids import Representatives, assign_nearest, centroids, dims_of, nearest_index
from .filters import MidrangeScaler
from .graph import connected_components
from .indices import sse
from .neighbours import neighbour_counts
from .pairs import Block, batch_of, bound, chunks, matrix, nearest, pack, plan_tiles, shape_of, tile_reduce
from .slabs import near_reduce, supported
from .stats import as_row, attribute_stats


def _frame(spark, centres: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pa.table({
        "id": pa.array(np.arange(len(centres)), pa.int64()),
        "features": pa.array([c.tolist() for c in centres], pa.list_(pa.float64()))}))


def bounding_box(points: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    row = as_row(attribute_stats(points).select("attr", "min", "max")).first()
    return np.array(row["min"]), np.array(row["max"])


def _packed(points: DataFrame) -> DataFrame:
    """(rows, payload): the vectors of every batch as one binary matrix, so that a pass over kept points reads arrays and parses no cells."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                X = matrix(batch.column("features"))
                yield pa.record_batch([pa.array([len(X)]), pa.array([X.tobytes()], pa.binary())], names=["rows", "payload"])

    return points.select("features").mapInArrow(run, "rows long, payload binary")


def cluster_sums(packed: DataFrame, centres: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(counts, vector sums) per nearest centre. Each task sends one row per non-empty centre."""
    ship = packed.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        k, d = ship.value.shape
        n, s = np.zeros(k, dtype=np.int64), np.zeros((k, d))
        for rows, payload in ((r, p) for b in batches for r, p in zip(b.column("rows").to_pylist(), b.column("payload"))):
            X = np.frombuffer(payload.as_buffer()).reshape(rows, -1)
            pos, _ = nearest_index(X, ship.value, metric)
            n += np.bincount(pos, minlength=k)
            order = np.argsort(pos, kind="stable")
            at, first = np.unique(pos[order], return_index=True)
            s[at] += np.add.reduceat(X[order], first, axis=0)
        used = np.nonzero(n)[0]
        yield pa.RecordBatch.from_pydict({
            "c": pa.array(used, pa.int64()), "n": pa.array(n[used]),
            "s": pa.array([r.tolist() for r in s[used]], pa.list_(pa.float64()))})

    parts = packed.mapInArrow(run, "c long, n long, s array<double>")
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    total = parts.groupBy("c").agg(F.sum("n").alias("n"), Summarizer.sum(array_to_vector("s")).alias("s"))
    n, s = np.zeros(len(centres), dtype=np.int64), np.zeros_like(centres)
    for r in total.select("c", "n", vector_to_array("s").alias("s")).collect():  # at most one row per shipped centre
        n[r["c"]], s[r["c"]] = r["n"], r["s"]
    return n, s


def _random_centres(low: np.ndarray, high: np.ndarray, which, seed: int, it: int) -> np.ndarray:
    """Positions in the box of the centres numbered `which`, the same ones as `_kmeans_by_tiles` draws."""
    u = np.array([[hash_uniform_of(f"{c}-{a}", f"{seed}-{it}") for a in range(len(low))] for c in which])
    return low + u.reshape(-1, len(low)) * (high - low)


def _fits(points: DataFrame, k: int, d: int) -> bool:
    return k * d * 8 <= broadcast_limit(points.sparkSession)


def kmeans_step(points: DataFrame, centres: DataFrame, metric: str = "euclidean") -> DataFrame:
    """One Lloyd step from given centres (id, features): (prediction, n, centroid)."""
    metric = bound(points, metric)
    reps = Representatives(centres, dims_of(points))
    return centroids(assign_nearest(points, reps, metric))


def kmeans(points: DataFrame, k: int = 4, iterations: int = 100, metric: str = "euclidean", seed: int = 1,
           tolerance: float = 1e-4) -> DataFrame:
    """Points with `prediction`. Starts at random positions in the bounding box; empty clusters restart there."""
    metric = bound(points, metric)
    held = _packed(points).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        low, high = bounding_box(points)
        d = len(low)
        if not _fits(points, k, d):
            return _kmeans_by_tiles(points, k, iterations, metric, seed, tolerance, low, high)
        centres = _random_centres(low, high, range(k), seed, 0)
        for it in range(1, iterations + 1):
            n, s = cluster_sums(held, centres, metric)
            moved = s / np.maximum(n, 1)[:, None]
            empty = np.flatnonzero(n == 0)
            moved[empty] = _random_centres(low, high, empty, seed, it)
            shift = np.sqrt(((moved - centres) ** 2).sum(axis=1)).max()
            centres = moved
            if shift <= tolerance:
                break
        return assign_nearest(points, Representatives(_frame(points.sparkSession, centres), d), metric).drop("distance")
    finally:
        held.unpersist()


def _kmeans_by_tiles(points, k, iterations, metric, seed, tolerance, low, high) -> DataFrame:
    """Lloyd steps with the centres as a DataFrame, for more centres than can be shipped."""
    spark, d = points.sparkSession, len(low)

    def random_rows(ids: DataFrame, it: int) -> DataFrame:
        cells = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda a: hash_uniform(
            F.concat(F.col("id").cast("string"), F.lit("-"), a.cast("string")), f"{seed}-{it}"))
        lo, span = F.array(*map(F.lit, low.tolist())), F.array(*map(F.lit, (high - low).tolist()))
        return ids.select("id", F.transform(cells, lambda u, i: F.get(lo, i) + u * F.get(span, i)).alias("features"))

    ids = spark.range(k)
    centres = cut_lineage(random_rows(ids, 0))
    for it in range(1, iterations + 1):
        assigned = assign_nearest(points, Representatives(centres, d), metric)
        means = centroids(assigned).select(F.col("prediction").alias("id"), F.col("centroid").alias("features"))
        empty = random_rows(ids.join(means, "id", "left_anti"), it)
        moved = cut_lineage(means.unionByName(empty))
        gap = moved.join(centres.withColumnRenamed("features", "old"), "id").agg(
            F.max(D.euclidean(F.col("features"), F.col("old"))), F.count(F.lit(1))).first()[0]
        centres = moved
        if gap <= tolerance:
            break
    return assign_nearest(points, Representatives(centres, d), metric).drop("distance")


def medoids_of(points: DataFrame, centres: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(id = cluster, features, point): the data point nearest to every centre, ties by id."""
    metric = bound(points, metric)
    d = dims_of(points)
    reps = Representatives(centres, d)
    if reps.local is None:
        near = nearest(centres, points.select("id", "features"), 1, metric)
        return near.select("id", F.col("neighbour").alias("point")).join(
            points.select(F.col("id").alias("point"), "features"), "point").select("id", "features", "point")
    ship = points.sparkSession.sparkContext.broadcast(reps.local)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, M = ship.value
            own = np.asarray(batch.column("id"))
            order = np.argsort(own, kind="stable")
            X = matrix(batch.column("features"))[order]
            pos, score = nearest_index(M, X, metric)
            bad = measure(metric).badness_np(score)
            yield pa.RecordBatch.from_pydict({
                "id": pa.array(ids), "bad": pa.array(bad), "point": pa.array(own[order][pos]),
                "features": pa.array([x.tolist() for x in X[pos]], pa.list_(pa.float64()))})

    parts = points.select("id", "features").mapInArrow(run, "id long, bad double, point long, features array<double>")
    best = parts.groupBy("id").agg(F.min_by(F.struct("features", "point"), F.struct("bad", "point")).alias("x"))
    return best.select("id", "x.features", "x.point")


def kmedoids_step(points: DataFrame, medoids: DataFrame, metric: str = "euclidean") -> DataFrame:
    """Assign to the given medoids (id, features), average, and take the data points nearest to the averages."""
    metric = bound(points, metric)
    assigned = assign_nearest(points, Representatives(medoids, dims_of(points)), metric)
    means = centroids(assigned).select(F.col("prediction").alias("id"), F.col("centroid").alias("features"))
    return medoids_of(points, means, metric)


def kmedoids(points: DataFrame, k: int = 4, iterations: int = 100, metric: str = "euclidean", seed: int = 1) -> DataFrame:
    """Points with `prediction`, from k random data points as first medoids; stops when the medoids stay.

    Medoids lie in k different places as long as there are so many: one that lost its points, or met another, is drawn anew.
    """
    start = points.select("id", "features", hash_uniform(F.col("id"), f"{seed}:medoid").alias("u")).orderBy("u", "id").limit(k)
    medoids = start.select((F.row_number().over(_by_draw()) - 1).cast("bigint").alias("id"), "features", F.col("id").alias("point"))
    medoids = _apart(points, medoids, k, f"{seed}:medoid:0")
    for it in range(1, iterations + 1):
        moved = _apart(points, kmedoids_step(points, medoids, metric), k, f"{seed}:medoid:{it}")
        same = moved.join(medoids.select("id", F.col("point").alias("old")), "id").where("point = old").count()
        kept = moved.count()
        medoids = moved
        if same == kept:
            break
    reps = Representatives(medoids.select("id", "features"), dims_of(points))
    return assign_nearest(points, reps, metric).drop("distance")


def _apart(points: DataFrame, medoids: DataFrame, k: int, draw: str) -> DataFrame:
    """(id, features, point): the medoids, those in one place once, filled up to k with random data points of other places."""
    kept = cut_lineage(medoids.groupBy("features").agg(F.min("id").alias("id"), F.min_by("point", "id").alias("point"))
                       .select("id", "features", "point"))
    missing = k - kept.count()
    if not missing:
        return kept
    places = points.select("id", "features").join(kept.select("features"), "features", "left_anti").groupBy("features").agg(
        F.min("id").alias("id"))
    drawn = places.withColumn("u", hash_uniform(F.col("id"), draw)).orderBy("u", "id").limit(missing)
    drawn = drawn.select(F.row_number().over(_by_draw()).alias("r"), "features", F.col("id").alias("point"))
    names = points.sparkSession.range(k).join(kept.select("id"), "id", "left_anti").withColumn("u", F.lit(0.0))
    names = names.select(F.row_number().over(_by_draw()).alias("r"), "id")
    return cut_lineage(kept.unionByName(drawn.join(names, "r").select("id", "features", "point")))


def _by_draw():
    from pyspark.sql import Window

    return Window.orderBy("u", "id")  # only over the k chosen rows


def farthest_first_centres(points: DataFrame, k: int, metric: str = "euclidean", first: int | None = None,
                           seed: int = 1) -> list[tuple[int, list[float]]]:
    """[(id, features)]: each next centre is the point farthest from those before, ties to the smallest id."""
    held = points.select("id", "features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if first is None:
            row = held.orderBy(hash_uniform(F.col("id"), f"{seed}:first"), "id").first()
        else:
            row = held.where(F.col("id") == first).first()
        found = [(row["id"], list(row["features"]))]
        m = measure(metric)
        while len(found) < k:
            M = np.array([f for _, f in found])
            ship = held.sparkSession.sparkContext.broadcast(M)

            @F.arrow_udf("double")
            def gap(v: pa.Array) -> pa.Array:
                _, score = nearest_index(matrix(v), ship.value, metric)
                return pa.array(m.badness_np(score))

            far = held.withColumn("g", gap("features")).agg(
                F.max_by(F.struct("id", "features"), F.struct(F.col("g"), -F.col("id"))).alias("x")).select("x.*").first()
            if far["id"] in {i for i, _ in found}:
                break
            found.append((far["id"], list(far["features"])))
        return found
    finally:
        held.unpersist()


def farthest_first(points: DataFrame, k: int = 4, metric: str = "euclidean", first: int | None = None, seed: int = 1) -> DataFrame:
    centres = np.array([f for _, f in farthest_first_centres(points, k, metric, first, seed)])
    return assign_nearest(points, Representatives(_frame(points.sparkSession, centres), centres.shape[1]), metric).drop("distance")


# ---- choosing k ----------------------------------------------------------------------------------

def select_k(points: DataFrame, candidates: dict[tuple, DataFrame], score: Callable[[DataFrame], DataFrame] = sse,
             better: Callable[[float, float], bool] = lambda new, old: new < old):
    """(key, clustering, scores): the candidate with the best score, the first one on ties."""
    best, scores = None, []
    for key, clustered in candidates.items():
        value = score(clustered).first()[0]
        scores.append((*key, value))
        if best is None or better(value, best[1]):
            best = (key, value, clustered)
    return best[0], best[2], scores


def farthest_first_select_k(points: DataFrame, k_min: int = 2, k_max: int = 6, metric: str = "euclidean",
                            score=sse, better=lambda new, old: new < old, first: int | None = None, seed: int = 1):
    """Smaller k use a prefix of one traversal."""
    centres = np.array([f for _, f in farthest_first_centres(points, k_max, metric, first, seed)])
    made = {}
    for k in range(k_min, k_max + 1):
        reps = Representatives(_frame(points.sparkSession, centres[:k]), centres.shape[1])
        made[(k,)] = assign_nearest(points, reps, metric).drop("distance")
    return select_k(points, made, score, better)


def kmeans_select_k(points: DataFrame, k_min: int = 2, k_max: int = 6, repeats: int = 1, iterations: int = 100,
                    metric: str = "euclidean", score=sse, better=lambda new, old: new < old, seed: int = 1):
    """Every k with `repeats` seeds; `k_min == k_max` is the best of repeats at fixed k."""
    made = {(k, r): kmeans(points, k, iterations, metric, seed + r)
            for k in range(k_min, k_max + 1) for r in range(repeats)}
    return select_k(points, made, score, better)


# ---- density -------------------------------------------------------------------------------------

def core_points(points: DataFrame, eps: float = 0.1, min_points: int = 6, metric: str = "euclidean") -> DataFrame:
    """(id, degree) of points with at least `min_points` neighbours nearer than eps, themselves included."""
    return neighbour_counts(points, eps, metric).where(F.col("degree") >= min_points)


# Cells of a block of pairs for each near pair, from which on the near pairs are listed.
SPARSE = 16


def _local_forest(L: Block, R: Block, near: np.ndarray) -> np.ndarray:
    """Edges (id, smallest id of its component) that connect the same points as `near` does."""
    big = np.iinfo(np.int64).max
    same = L.key == R.key
    left, right = L.ids.copy(), R.ids.copy()
    touched_l, touched_r = near.any(axis=1), near.any(axis=0)
    # Few near pairs are gone through as a list, many as a matrix.
    sparse = np.count_nonzero(near) * SPARSE <= near.size
    if sparse:
        i, j = np.nonzero(near)
        turn = np.argsort(j, kind="stable")
        rows, cols = np.flatnonzero(touched_l), np.flatnonzero(touched_r)
        at_row, at_col = np.searchsorted(i, rows), np.searchsorted(j[turn], cols)
    while True:
        new_l, new_r = left.copy(), right.copy()
        if sparse and len(i):
            new_l[rows] = np.minimum(left[rows], np.minimum.reduceat(right[j], at_row))
            new_r[cols] = np.minimum(right[cols], np.minimum.reduceat(new_l[i[turn]], at_col))
        step = max(1, (1 << 22) // max(1, len(R)))
        for s in range(0, 0 if sparse else len(L), step):
            part = slice(s, s + step)
            np.minimum(new_l[part], np.where(near[part], right[None, :], big).min(axis=1), out=new_l[part])
        for s in range(0, 0 if sparse else len(L), step):
            part = slice(s, s + step)
            np.minimum(new_r, np.where(near[part], new_l[part][:, None], big).min(axis=0), out=new_r)
        if same:
            new_l = new_r = np.minimum(new_l, new_r)
        if (new_l == left).all() and (new_r == right).all():
            break
        left, right = new_l, new_r
    src = np.r_[L.ids[touched_l], R.ids[touched_r]]
    dst = np.r_[left[touched_l], right[touched_r]]
    keep = src != dst
    return np.unique(np.c_[src[keep], dst[keep]], axis=0) if keep.any() else np.zeros((0, 2), dtype=np.int64)


def core_forest(core: DataFrame, eps: float, metric: str = "euclidean") -> DataFrame:
    """(src, dst): a spanning forest per pair of blocks of the graph of core points nearer than eps."""
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def kernel(L: Block, R: Block):
        near = np.zeros((len(L), len(R)), dtype=bool)
        for part, dist in chunks(L, R, metric):
            near[part] = dist < eps
        if near.any():
            edges = _local_forest(L, R, near)
            yield batch_of(schema, edges[:, 0], edges[:, 1])

    if supported(metric):
        return near_reduce(core, None, kernel, "src long, dst long", eps, metric)
    n, d = shape_of(core)
    plan = plan_tiles(core.sparkSession, d, n)
    return tile_reduce(pack(core, plan.left_rows), None, kernel, "src long, dst long", plan)


def dbscan(points: DataFrame, eps: float = 0.1, min_points: int = 6, metric: str = "euclidean",
           normalize: bool = True) -> DataFrame:
    """Clustered points only, with `prediction` = smallest id among the cluster's core points; noise is left out.

    With `normalize` distances are on [0, 1]-scaled attributes, divided by sqrt(dimensions).
    """
    work = points.select("id", "features")
    if normalize:
        root = math.sqrt(dims_of(points))
        scaled = MidrangeScaler(0.5, 1.0).fit_transform(work)
        work = scaled.withColumn("features", F.transform("features", lambda x: x / root))
    work = cut_lineage(work)
    degrees = cut_lineage(neighbour_counts(work, eps, metric))
    is_core = degrees.select("id", (F.col("degree") >= min_points).alias("core"))
    marked = work.join(is_core, "id")
    core = cut_lineage(marked.where("core").select("id", "features"))
    comp = cut_lineage(connected_components(core_forest(core, eps, metric), core))
    labelled = core.join(comp, "id")
    border = _border(marked.where("NOT core").select("id", "features"), labelled, eps, metric)
    found = comp.select("id", F.col("component").alias("prediction")).unionByName(border)
    return points.drop("prediction").join(found, "id")


def _border(rest: DataFrame, core: DataFrame, eps: float, metric: str) -> DataFrame:
    """(id, prediction): the smallest cluster among the core points nearer than eps."""
    schema = pa.schema([("id", pa.int64()), ("prediction", pa.int64())])
    big = np.iinfo(np.int64).max

    def kernel(L: Block, R: Block):
        for part, dist in chunks(L, R, metric):
            low = np.where(dist < eps, R.cols["component"][None, :], big).min(axis=1)
            ok = low < big
            yield batch_of(schema, L.ids[part][ok], low[ok])

    if supported(metric):
        met = near_reduce(rest, core, kernel, "id long, prediction long", eps, metric, right_extra=("component",))
    else:
        n, d = shape_of(rest)
        plan = plan_tiles(rest.sparkSession, d, max(1, n), max(1, shape_of(core)[0]))
        met = tile_reduce(pack(rest, plan.left_rows), pack(core, plan.right_rows, "component"), kernel, "id long, prediction long", plan)
    return met.groupBy("id").agg(F.min("prediction").alias("prediction"))


# ---- similarity graph for Markov clustering ------------------------------------------------------

def similarity_edges(points: DataFrame, above: float, metric: str = "cosine_similarity", **params) -> DataFrame:
    """(src, dst, w) with src < dst and similarity greater than `above`."""
    n, d = shape_of(points)
    plan = plan_tiles(points.sparkSession, d, n)
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("w", pa.float64())])

    def kernel(L: Block, R: Block):
        for part, sim in chunks(L, R, metric, **params):
            keep = sim > above
            if L.key == R.key:
                keep &= np.arange(part.start, part.stop)[:, None] < np.arange(len(R))[None, :]
            at = np.flatnonzero(keep)
            i, j = np.divmod(at, max(1, len(R)))
            a, b = L.ids[part][i], R.ids[j]
            yield batch_of(schema, np.minimum(a, b), np.maximum(a, b), sim.ravel()[at])

    return tile_reduce(pack(points, plan.left_rows), None, kernel, "src long, dst long, w double", plan)


# ---- self-organising map -------------------------------------------------------------------------

def som_grid(width: int, height: int, hexagonal: bool = True) -> np.ndarray:
    """Cell positions; hexagonal rows are 0.866 apart and every other one is shifted by half a cell."""
    cells = []
    for y in range(height):
        for x in range(width):
            cells.append((x + 0.5 * (y % 2), y * 0.866) if hexagonal else (float(x), float(y)))
    return np.array(cells)


def som_fit(points: DataFrame, width: int = 2, height: int = 2, epochs: int = 20, radius: float = 8.0,
            hexagonal: bool = True, neighbourhood: str = "gaussian", decay: str = "linear", rate: float = 0.1,
            metric: str = "euclidean", seed: int = 1) -> np.ndarray:
    """Cell weights after batch epochs: every epoch moves each cell towards the neighbourhood-weighted mean.

    `decay` shapes rate and radius over the epochs: linear, exponential or inverse. The rate is relative to its start,
    so the first epoch moves cells all the way.
    """
    d = dims_of(points)
    grid = som_grid(width, height, hexagonal)
    apart = np.sqrt(((grid[:, None, :] - grid[None, :, :]) ** 2).sum(axis=2))
    weights = np.random.default_rng(seed).random((len(grid), d))
    held = _packed(points).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for e in range(epochs):
            share = e / epochs
            fade = {"linear": 1 - share, "exponential": math.exp(-5 * share), "inverse": 0.01 / (0.01 + share)}[decay]
            reach = max(radius * fade, 1e-9)
            if neighbourhood == "gaussian":
                h = np.exp(-(apart ** 2) / (2 * reach ** 2))
            else:
                h = (apart <= math.ceil(reach)).astype(float)
            n, s = cluster_sums(held, weights, metric)
            top, bottom = h @ s, h @ n.astype(float)
            target = np.where(bottom[:, None] > 0, top / np.maximum(bottom, 1e-300)[:, None], weights)
            pull = min(1.0, max(fade, rate))
            weights = weights + pull * (target - weights)
        return weights
    finally:
        held.unpersist()


def som_assign(points: DataFrame, weights: np.ndarray, metric: str = "euclidean") -> DataFrame:
    """Points with their cell as `prediction`; cells without points do not appear."""
    reps = Representatives(_frame(points.sparkSession, weights), weights.shape[1])
    return assign_nearest(points, reps, metric).drop("distance")


def som(points: DataFrame, **options) -> DataFrame:
    return som_assign(points, som_fit(points, **options), options.get("metric", "euclidean"))
