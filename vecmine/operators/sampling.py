"""Seeded, partition-invariant sampling: PPS, Poisson, bootstrap, sub-samples, folds."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distances import block_distance, measure
from ..functions.hashing import hash_uniform
from ..session import collect_bounded, parallelism, settle_small
from .pairs import batch_of, bound, matrix


def _draws(seeds, tag: str):
    """One uniform value per seed."""
    return F.array(*[hash_uniform(F.col("id"), f"{s}{tag}") for s in seeds])


# ---- probability proportional to size ------------------------------------------------------------

def initial_sample_size(k: int, delta: float) -> int:
    return max(1, math.ceil(math.log2(2 * k / delta)))


@dataclass
class Profile:
    """Cluster sizes and dimensions of a clustered point set, from one pass."""

    sizes: DataFrame  # (prediction, n), marked for broadcast when small
    n_of: dict[int, int] | None  # the same as a dictionary when small
    n: int
    k: int
    d: int


def profile(points: DataFrame) -> Profile:
    per = points.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("d"))
    frame, rows = settle_small(per)
    if rows is None:
        r = per.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.max("d").alias("d")).first()
        return Profile(frame.drop("d"), None, r["n"], r["k"], r["d"])
    return Profile(frame.drop("d"), {r["prediction"]: r["n"] for r in rows}, sum(r["n"] for r in rows), len(rows),
                   max((r["d"] for r in rows), default=0))


def initial_sample(points: DataFrame, prof: Profile, m: int, seeds) -> tuple[DataFrame, list | None]:
    """(run, prediction, id, features): per run and cluster the m points with the smallest draws; rows when small.

    A threshold a few standard deviations above m leaves a handful of candidates per cluster, so only those are
    ranked; if a cluster gets too few, everything is ranked.
    """
    known = points.join(prof.sizes, "prediction")
    drawn = known.select("id", "features", "prediction", "n", F.posexplode(_draws(seeds, ":s0")).alias("run", "u"))
    likely = drawn.where(F.col("u") * F.col("n") <= F.lit(float(m + 8 * math.sqrt(m) + 24)))
    w = Window.partitionBy("run", "prediction").orderBy("u", "id")

    def top(df):
        return df.withColumn("r", F.row_number().over(w)).where(F.col("r") <= m).select("run", "prediction", "id", "features")

    if prof.n_of is not None:
        rows = collect_bounded(top(likely), 8 * prof.d + 48)
        if rows is not None:
            got = Counter((r["run"], r["prediction"]) for r in rows)
            if all(got[run, c] >= min(n, m) for run in range(len(seeds)) for c, n in prof.n_of.items()):
                return top(likely), rows
            return top(drawn), collect_bounded(top(drawn), 8 * prof.d + 48)
    return top(drawn), None


_PPS = pa.schema([("run", pa.int32()), ("id", pa.int64()), ("features", pa.list_(pa.float64())),
                  ("prediction", pa.int64()), ("gamma", pa.float64()), ("pi", pa.float64()), ("u", pa.float64())])
_PPS_DDL = "run int, id long, features array<double>, prediction long, gamma double, pi double, u double"


def pps_probabilities(points: DataFrame, t: int, delta: float = 0.1, seeds=(1,), metric: str = "euclidean",
                      only_selected: bool = False, prof: Profile | None = None, **params) -> DataFrame:
    """(run, id, features, prediction, gamma, pi, u): inclusion probabilities pi = min(1, t * gamma).

    gamma is the largest share of a point in the total distance of any initial-sample point of its cluster, at
    least 1/n; clusters of at most t points are taken whole. Passes: sizes, initial sample, its totals, the points.
    """
    metric = bound(points, metric)
    spark = points.sparkSession
    points = points.select("id", "features", "prediction")
    prof = prof or profile(points)
    s0, rows = initial_sample(points, prof, initial_sample_size(prof.k, delta), seeds)
    if rows is None:
        return _pps_by_join(points, prof.sizes, s0, t, seeds, metric, only_selected, **params)

    n_of = prof.n_of
    groups: dict[tuple[int, int], list] = {}
    for r in sorted(rows, key=lambda r: (r["run"], r["prediction"], r["id"])):
        groups.setdefault((r["run"], r["prediction"]), []).append(r["features"])
    groups = {g: np.array(v, dtype=np.float64) for g, v in groups.items()}
    ship = spark.sparkContext.broadcast((groups, n_of))
    runs = len(seeds)

    def totals(batches):
        held = {g: np.zeros(len(v)) for g, v in ship.value[0].items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            X, pred = matrix(batch.column("features")), np.asarray(batch.column("prediction"))
            for c in np.unique(pred):
                own = X[pred == c]
                for r in range(runs):
                    held[r, c] += block_distance(metric, own, ship.value[0][r, c], **params).sum(axis=0)
        for (r, c), w in held.items():
            size = len(w)
            yield pa.RecordBatch.from_pydict({
                "run": pa.array([r] * size, pa.int32()), "prediction": pa.array([c] * size, pa.int64()),
                "pos": pa.array(range(size), pa.int32()), "w": pa.array(w)})

    parts = points.select("features", "prediction").mapInArrow(totals, "run int, prediction long, pos int, w double")
    weights = {g: np.zeros(len(v)) for g, v in groups.items()}
    for r in parts.groupBy("run", "prediction", "pos").agg(F.sum("w").alias("w")).collect():  # one row per shipped vector
        weights[r["run"], r["prediction"]][r["pos"]] = r["w"]
    ship_w = spark.sparkContext.broadcast(weights)

    def probabilities(batches):
        groups, n_of = ship.value
        for batch in batches:
            if not batch.num_rows:
                continue
            X, pred = matrix(batch.column("features")), np.asarray(batch.column("prediction"))
            U = matrix(batch.column("u"))
            size = np.array([n_of[c] for c in pred], dtype=np.float64)
            for r in range(runs):
                gamma = np.empty(len(X))
                for c in np.unique(pred):
                    at = pred == c
                    dist = block_distance(metric, X[at], groups[r, c], **params)
                    w = ship_w.value[r, c]
                    share = np.divide(dist, w, out=np.zeros_like(dist), where=w > 0)
                    gamma[at] = np.maximum(share.max(axis=1), 1.0 / size[at])
                pi = np.where(size <= t, 1.0, np.minimum(1.0, t * gamma))
                keep = np.nonzero(U[:, r] < pi)[0] if only_selected else np.arange(len(X))
                if len(keep):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(keep), r), pa.int32()), batch.column("id").take(pa.array(keep)),
                        batch.column("features").take(pa.array(keep)).cast(pa.list_(pa.float64())),
                        batch.column("prediction").take(pa.array(keep)),
                        pa.array(gamma[keep]), pa.array(pi[keep]), pa.array(U[keep, r])], schema=_PPS)

    return points.withColumn("u", _draws(seeds, ":pps")).mapInArrow(probabilities, _PPS_DDL)


def _pps_by_join(points, sizes, s0, t, seeds, metric, only_selected, **params) -> DataFrame:
    """The same by equi-joins on the cluster, for more clusters than can be shipped."""
    dist = partial(measure(metric).column, **params)
    seed_rows = s0.select("run", "prediction", F.col("id").alias("sid"), F.col("features").alias("sf"))
    near = points.join(seed_rows, "prediction")
    totals = near.groupBy("run", "prediction", "sid").agg(
        F.sum(dist(F.col("features"), F.col("sf"))).alias("w"), F.first("sf").alias("sf"))
    packed = totals.groupBy("run", "prediction").agg(F.collect_list(F.struct("sf", "w")).alias("s0"))  # m per group
    drawn = points.join(sizes, "prediction").select("*", F.posexplode(_draws(seeds, ":pps")).alias("run", "u"))
    met = drawn.join(packed, ["run", "prediction"])
    share = F.array_max(F.transform("s0", lambda s: F.coalesce(F.try_divide(dist(F.col("features"), s["sf"]), s["w"]), F.lit(0.0))))
    gamma = F.greatest(share, 1.0 / F.col("n"))
    met = met.withColumn("gamma", gamma)
    pi = F.when(F.col("n") <= t, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.lit(float(t)) * F.col("gamma")))
    out = met.withColumn("pi", pi).select("run", "id", "features", "prediction", "gamma", "pi", "u")
    return out.where(F.col("u") < F.col("pi")) if only_selected else out


def pps_sample(points: DataFrame, t: int, delta: float = 0.1, seeds=(1,), metric: str = "euclidean",
               prof: Profile | None = None, **params) -> DataFrame:
    """(run, id, features, prediction, pi): independent draws with the PPS probabilities."""
    return pps_probabilities(points, t, delta, seeds, metric, True, prof, **params).select(
        "run", "id", "features", "prediction", "pi")


def uniform_sample(points: DataFrame, t: int, seeds=(1,), prof: Profile | None = None) -> DataFrame:
    """(run, id, features, prediction, pi) with pi = min(1, t / cluster size)."""
    prof = prof or profile(points)
    drawn = points.join(prof.sizes, "prediction").select(
        "id", "features", "prediction", F.least(F.lit(1.0), F.lit(float(t)) / F.col("n")).alias("pi"),
        F.posexplode(_draws(seeds, ":uni")).alias("run", "u"))
    return drawn.where(F.col("u") < F.col("pi")).select("run", "id", "features", "prediction", "pi")


def sampling_report(probabilities: DataFrame, **settings) -> DataFrame:
    """(run, prediction, n, expected, realised) from inclusion probabilities and draws, and a column for every setting given (t, eps, delta)."""
    return probabilities.groupBy("run", "prediction").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pi").alias("expected"),
        F.count(F.when(F.col("u") < F.col("pi"), 1)).alias("realised")).withColumns({k: F.lit(v) for k, v in settings.items()})


def uniform_report(points: DataFrame, t: int, seeds=(1,), prof: Profile | None = None, **settings) -> DataFrame:
    """The same for uniform samples: every point of a cluster has pi = min(1, t / cluster size). Points are read once and not kept."""
    prof = prof or profile(points)
    drawn = points.select("id", "prediction").join(prof.sizes, "prediction").select(
        "prediction", F.least(F.lit(1.0), F.lit(float(t)) / F.col("n")).alias("pi"), F.posexplode(_draws(seeds, ":uni")).alias("run", "u"))
    return sampling_report(drawn, t=t, **settings)


# ---- ranks without a global window ---------------------------------------------------------------

def dense_position(df: DataFrame, order: list[str], out: str = "pos", buckets: int | None = None,
                   by: tuple[str, ...] = ()) -> DataFrame:
    """0-based position of every row in the total order of `order[0]` (a uniform draw), ties by the rest.

    Draws are cut into equal slices; slice counts give each slice its offset, and rows are numbered inside their
    slice. Every slice is a separate task, so the order is never built in one place.
    """
    spark = df.sparkSession
    slices = buckets or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = df.withColumn("_slice", F.least(F.floor(F.col(order[0]) * slices), F.lit(slices - 1)).cast("int"))
    counts = cut.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    # At most `slices` rows per group of `by`.
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1) if by else \
        Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    offsets, _ = settle_small(offsets)
    inside = Window.partitionBy(*by, "_slice").orderBy(*order)
    return cut.join(offsets, [*by, "_slice"]).withColumn(
        out, F.row_number().over(inside) - 1 + F.col("_before")).drop("_slice", "_before")


def _with_draw(points: DataFrame, seed) -> DataFrame:
    return points.withColumn("u", hash_uniform(F.col("id"), seed))


def kfold_split(points: DataFrame, folds: int = 10, seed: int = 1) -> DataFrame:
    """Points with `fold`; sizes differ by at most one."""
    pos = dense_position(_with_draw(points, seed), ["u", "id"])
    return pos.withColumn("fold", F.pmod("pos", F.lit(folds)).cast("int")).drop("pos", "u")


def subsample(points: DataFrame, size: int | None = None, fraction: float | None = None, seed: int = 1,
              stratified: bool = False) -> tuple[DataFrame, DataFrame]:
    """(chosen, remainder): exactly `size` (or ceil(fraction * n), per class if stratified) points."""
    by = ("label",) if stratified else ()
    pos = dense_position(_with_draw(points, seed), ["u", "id"], by=by)
    if fraction is None:
        if stratified:
            raise ValueError("stratified sub-samples take a fraction")
        limit = F.lit(size)
    else:
        per = points.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) * F.lit(float(fraction))).alias("_take"))
        pos, limit = (pos.join(settle_small(per)[0], list(by)), F.col("_take")) if by else (pos, per.scalar())
    keep = F.col("pos") < limit
    return (pos.where(keep).select(*points.columns), pos.where(~keep).select(*points.columns))


def bootstrap(points: DataFrame, size: int | None = None, fraction: float = 1.0, seed: int = 1, bags: int = 1,
              stratified: bool = False) -> tuple[DataFrame, DataFrame]:
    """(in-bag, out-of-bag), drawn with replacement; both carry `bag`, in-bag rows also the draw number.

    Draw j of bag b picks position floor(u(j, seed, b) * n) in id-hash order. Positions come from the data, draws
    from a range, and the two meet by an equi-join.
    """
    spark = points.sparkSession
    by = ("label",) if stratified else ()
    pos = dense_position(_with_draw(points, f"{seed}:pos"), ["u", "id"], by=by).drop("u")
    want = F.lit(size).cast("bigint") if size is not None else F.ceil(F.col("n") * F.lit(float(fraction)))
    counts, rows = settle_small(points.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumn("want", want))
    total = bags * (sum(r["want"] for r in rows) if rows is not None else counts.agg(F.sum("want")).first()[0])
    draws = _draw_table(counts, by, bags, total)
    tag = F.concat(F.lit(f"{seed}:"), F.col("bag").cast("string"), *([F.lit(":"), F.col("label")] if stratified else []))
    draws = draws.withColumn("pos", F.floor(hash_uniform(F.col("draw"), tag) * F.col("n")).cast("bigint"))
    pos = pos.withColumn("pos", F.col("pos").cast("bigint"))
    # The counts' broadcast mark reaches up through their draws, which are as many as the points: both sides are sorted instead.
    bag = draws.select(*by, "bag", "draw", "pos").hint("merge").join(pos, [*by, "pos"]).select("bag", "draw", *points.columns)
    # Bags that drew an id, a bit each. All draws of a row meet it in one task, so a row an id leaves it and points move once for all bags.
    one = F.lit(1).cast("bigint")
    bit = F.call_function("shiftleft", one, F.pmod("bag", F.lit(_WORD)).cast("int"))
    words = [F.bit_or(F.when(F.floor(F.col("bag") / _WORD) == w, bit)).alias(f"_w{w}") for w in range(math.ceil(bags / _WORD))]
    taken = bag.groupBy("id").agg(*words)
    masks = F.array(*[F.coalesce(f"_w{w}", F.lit(0).cast("bigint")) for w in range(len(words))])
    free = F.filter(F.sequence(F.lit(0), F.lit(bags - 1)), lambda b: F.call_function(
        "getbit", F.get(masks, F.floor(b / _WORD).cast("int")), F.pmod(b, F.lit(_WORD))) == 0)
    oob = points.join(taken.hint("merge"), "id", "left").withColumn("bag", F.explode(free)).select("bag", *points.columns)
    return bag, oob


_WORD = 62  # bags a word of bits holds


def _draw_table(counts: DataFrame, by, bags: int, total: int) -> DataFrame:
    """(by..., n, bag, draw) with `want` draws per group and bag, generated in slices spread over all cores.

    The partition count is explicit: slices are a few bytes each until they are expanded, so they must not be merged.
    """
    slice_rows = max(1024, min(65536, math.ceil(total / (4 * parallelism(counts.sparkSession)))))
    parts = max(parallelism(counts.sparkSession), math.ceil(total / 2_000_000))
    sliced = counts.withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1)))).withColumn(
        "s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("want") - 1) / slice_rows))))
    spread = sliced.repartition(parts, *by, "bag", "s")
    first = F.col("s") * slice_rows
    last = F.least(first + slice_rows, F.col("want")) - 1
    return spread.select(*by, "n", "bag", F.explode(F.sequence(first, last)).alias("draw"))
