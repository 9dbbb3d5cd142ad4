"""Supervised discretisation by class entropy: MDL recursion and optimal 2, 3 and 4 bins.

Everything works on the table of distinct (attribute, value) pairs with running class counts. The running counts are
built in slices of the value range, so no task orders a whole attribute. Bins are weighted by their number of distinct
values (`weight='values'`) or by rows (`weight='rows'`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import collect_bounded, cut_lineage, settle_small
from ..sources.points import long_form
from .pairs import Block, batch_of, matrix, pack, plan_tiles, tile_reduce


def _plogp(n: Column, total: Column) -> Column:
    return F.when(n > 0, n / total * F.log2(n / total)).otherwise(F.lit(0.0))


def _entropy(counts: list[Column]) -> Column:
    total = sum(counts[1:], counts[0])
    return -sum((_plogp(c.cast("double"), total.cast("double")) for c in counts), F.lit(0.0))


def running_counts(points: DataFrame, weight: str = "values") -> tuple[DataFrame, int]:
    """(attr, value, pos, c0.., total columns t0.., m): per distinct value the counts strictly below it.

    `pos` is the weight below the value, `m` the weight of the whole attribute.
    """
    classes = collect_bounded(points.select("label").where("label IS NOT NULL").distinct(), 64)
    if classes is None:
        raise ValueError("entropy bins need a label with few distinct values")
    names = sorted(r["label"] for r in classes)
    cells = long_form(points, "label")
    per = cells.groupBy("attr", "value").agg(
        *[F.count(F.when(F.col("label") == c, 1)).alias(f"x{i}") for i, c in enumerate(names)])
    w_here = F.lit(1).cast("bigint") if weight == "values" else sum(
        (F.col(f"x{i}") for i in range(1, len(names))), F.col("x0"))
    # Copies of a value are merged above; the distinct values are range-partitioned, one slice per task.
    slices = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = cut_lineage(per.withColumn("w", w_here).repartitionByRange(slices, "attr", "value").withColumn(
        "slice", F.spark_partition_id()))
    sums = [f"x{i}" for i in range(len(names))] + ["w"]
    base = sliced.groupBy("attr", "slice").agg(*[F.sum(c).alias(f"s_{c}") for c in sums])
    prior = Window.partitionBy("attr").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("attr")
    offs = base.select(
        "attr", "slice",
        *[F.coalesce(F.sum(f"s_{c}").over(prior), F.lit(0)).alias(f"o_{c}") for c in sums],
        *[F.sum(f"s_{c}").over(whole).alias(f"t_{c}") for c in sums])
    offs, _ = settle_small(offs, 16 * len(sums) + 16)
    inner = Window.partitionBy("attr", "slice").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    out = sliced.join(offs, ["attr", "slice"]).select(
        "attr", "value", *[(F.coalesce(F.sum(c).over(inner), F.lit(0)) + F.col(f"o_{c}")).alias(f"c_{c}") for c in sums],
        *[F.col(f"t_{c}") for c in sums])
    k = len(names)
    return out.select(
        "attr", "value", F.col("c_w").alias("pos"), F.col("t_w").alias("m"),
        *[F.col(f"c_x{i}").alias(f"c{i}") for i in range(k)], *[F.col(f"t_x{i}").alias(f"t{i}") for i in range(k)]), k


def _split_cost(k: int, pos="pos", start="lo", end="hi", left="a", right="b"):
    lc = [F.col(f"c{i}") - F.col(f"{left}{i}") for i in range(k)]
    rc = [F.col(f"{right}{i}") - F.col(f"c{i}") for i in range(k)]
    nl = (F.col(pos) - F.col(start)).cast("double")
    nr = (F.col(end) - F.col(pos)).cast("double")
    e1, e2 = _entropy(lc), _entropy(rc)
    return nl / (nl + nr) * e1 + nr / (nl + nr) * e2, e1, e2, lc, rc


def mdl_cuts(points: DataFrame, weight: str = "values") -> DataFrame:
    """(attr, cut): recursive minimal-entropy cut points accepted by the MDL criterion, all attributes at once."""
    spark = points.sparkSession
    table, k = running_counts(points, weight)
    table = cut_lineage(table)
    cuts: list[tuple[int, float]] = []
    counts = [f"c{i}" for i in range(k)]
    here = F.struct("pos", *counts)
    # Open segments: value range [from, to) per attribute with the counts below both ends. Few rows, two per accepted cut; they are shipped, so
    # that the table is only ever read where it is.
    top = F.lit(float("inf"))
    whole = table.groupBy("attr").agg(
        F.min(F.when(F.col("value") < top, here)).alias("low"), F.max(F.when(F.col("value") == top, here)).alias("high"),
        F.max(F.struct(F.col("m").alias("pos"), *[F.col(f"t{i}").alias(f"c{i}") for i in range(k)])).alias("all"))
    open_ = [(r["attr"], float("-inf"), float("inf"), tuple(r["low"]), tuple(r["high"] or r["all"]))
             for r in whole.where("low IS NOT NULL").collect()]  # one row per attribute
    while open_:
        seg = F.broadcast(spark.createDataFrame(pa.table({
            "attr": pa.array([s[0] for s in open_], pa.int32()), "vfrom": pa.array([s[1] for s in open_], pa.float64()),
            "vto": pa.array([s[2] for s in open_], pa.float64()),
            **{n: pa.array([s[3][i] for s in open_], pa.int64()) for i, n in enumerate(["lo", *[f"a{i}" for i in range(k)]])},
            **{n: pa.array([s[4][i] for s in open_], pa.int64()) for i, n in enumerate(["hi", *[f"b{i}" for i in range(k)]])}})))
        cand = table.join(seg, "attr").where((F.col("value") >= F.col("vfrom")) & (F.col("value") < F.col("vto")) & (F.col("pos") > F.col("lo")))
        lef, e1, e2, lc, rc = _split_cost(k)
        kinds = lambda cs: sum((F.when(c > 0, 1).otherwise(0) for c in cs), F.lit(0))
        cand = cand.select(
            "attr", "vfrom", "vto", "value", "lo", "hi", lef.alias("lef"), e1.alias("e1"), e2.alias("e2"),
            kinds(lc).alias("k1"), kinds(rc).alias("k2"),
            _entropy([F.col(f"b{i}") - F.col(f"a{i}") for i in range(k)]).alias("ent"),
            kinds([F.col(f"b{i}") - F.col(f"a{i}") for i in range(k)]).alias("kk"), here.alias("at"))
        best = cand.groupBy("attr", "vfrom", "vto").agg(F.min(F.struct(
            "lef", "value", "e1", "e2", "k1", "k2", "ent", "kk", "lo", "hi", "at")).alias("x")).select("attr", "vfrom", "vto", "x.*")
        n = (F.col("hi") - F.col("lo")).cast("double")
        delta = F.log2(F.pow(F.lit(3.0), F.col("kk")) - 2) - (
            F.col("kk") * F.col("ent") - F.col("k1") * F.col("e1") - F.col("k2") * F.col("e2"))
        bar = F.log2(n - 1) / n + delta / n
        accepted = best.where((n >= 2) & (F.col("ent") - F.col("lef") >= F.coalesce(bar, F.lit(float("-inf")))))
        ends = {(s[0], s[1], s[2]): s[3:] for s in open_}
        open_ = []
        for r in accepted.select("attr", "vfrom", "vto", "value", "at").collect():  # one row per new cut
            cuts.append((r["attr"], r["value"]))
            low, high = ends[r["attr"], r["vfrom"], r["vto"]]
            open_ += [(r["attr"], r["vfrom"], r["value"], low, tuple(r["at"])), (r["attr"], r["value"], r["vto"], tuple(r["at"]), high)]
    return spark.createDataFrame(pa.table({
        "attr": pa.array([c[0] for c in cuts], pa.int32()), "cut": pa.array([c[1] for c in cuts], pa.float64())}))


def split_records(points: DataFrame, weight: str = "values") -> DataFrame:
    """The best single cut of every attribute with what it parts: (attr, cut, lef, entropy, entropy1, entropy2, kinds1, kinds2, size1,
    size2, counts1, counts2). Counts are class -> rows, kinds the number of classes, sizes the weights; the first cut wins ties."""
    table, k = running_counts(points, weight)
    names = sorted(r["label"] for r in points.select("label").where("label IS NOT NULL").distinct().collect())  # k, checked above
    zero = F.lit(0).cast("bigint")
    cand = table.where("pos > 0").withColumns(
        {"lo": zero, **{f"a{i}": zero for i in range(k)}, **{f"b{i}": F.col(f"t{i}") for i in range(k)}})
    lef, e1, e2, left, right = _split_cost(k, end="m")
    kinds = lambda cs: sum(((c > 0).cast("int") for c in cs), F.lit(0))
    counts = lambda cs: F.map_from_entries(F.array(*[F.struct(F.lit(n), c.cast("bigint")) for n, c in zip(names, cs)]))
    whole = _entropy([F.col(f"t{i}") for i in range(k)])
    best = cand.groupBy("attr").agg(F.min_by(
        F.struct(F.col("value").alias("cut"), lef.alias("lef"), whole.alias("entropy"), e1.alias("entropy1"), e2.alias("entropy2"), kinds(left).alias("kinds1"),
                 kinds(right).alias("kinds2"), F.col("pos").alias("size1"), (F.col("m") - F.col("pos")).alias("size2"),
                 counts(left).alias("counts1"), counts(right).alias("counts2")), F.struct(lef.alias("l"), F.col("value").alias("v"))).alias("x"))
    return best.select("attr", "x.*")


def two_bin_cuts(points: DataFrame, weight: str = "values") -> DataFrame:
    """(attr, cut, lef): the single cut with the lowest weighted class entropy, first one on ties."""
    return split_records(points, weight).select("attr", "cut", "lef")


def optimal_cuts(points: DataFrame, bins: int, weight: str = "values") -> DataFrame:
    """(attr, cuts array<double>, lef): the bins - 1 cuts with the lowest weighted class entropy.

    The cost is a sum over bins, so cuts are found stage by stage: best(j, s+1) = min over i < j of best(i, s) +
    cost(i, j). A stage meets candidate cuts in tiles and reports one row per candidate, never the pairs.
    """
    table, k = running_counts(points, weight)
    table = cut_lineage(table)
    base = table.where("pos > 0").select(
        (F.col("attr").cast("bigint")).alias("attr"), "value", "pos", "m",
        F.array(*[F.col(f"c{i}").cast("double") for i in range(k)]).alias("features"),
        F.array(*[F.col(f"t{i}").cast("double") for i in range(k)]).alias("whole"))
    ent = _entropy([F.get("features", i) for i in range(k)])
    state = base.select("attr", "pos", (F.col("pos") / F.col("m") * ent).alias("cost"),
                        F.array("value").alias("cuts"))
    schema = pa.schema([("attr", pa.int64()), ("pos", pa.int64()), ("prev", pa.int64()), ("cost", pa.float64())])
    n = base.count()
    plan = plan_tiles(points.sparkSession, k + 3, n, n)
    right = pack(base.withColumn("id", F.col("pos")), plan.right_rows, "m", by=("attr",))

    def kernel(L: Block, R: Block):
        size = (R.ids[None, :] - L.ids[:, None]).astype(np.float64)
        ent, total = np.zeros(size.shape), np.zeros(size.shape)
        for c in range(L.X.shape[1]):
            total += R.X[None, :, c] - L.X[:, None, c]
        for c in range(L.X.shape[1]):
            n_c = R.X[None, :, c] - L.X[:, None, c]
            p = np.divide(n_c, total, out=np.zeros_like(total), where=(n_c > 0) & (total > 0))
            ent -= p * np.log2(p, out=np.zeros_like(p), where=p > 0)
        cost = L.cols["cost"][:, None] + size / R.cols["m"][None, :] * ent
        cost[size <= 0] = np.inf
        order = np.argsort(L.ids, kind="stable")
        at = order[cost[order].argmin(axis=0)]
        low = cost[at, np.arange(len(R))]
        ok = np.isfinite(low)
        yield batch_of(schema, R.cols["attr"][ok], R.ids[ok], L.ids[at][ok], low[ok])

    for _ in range(bins - 2):
        left = pack(base.select("attr", "pos", "features").join(state.select("attr", "pos", "cost"), ["attr", "pos"])
                    .withColumn("id", F.col("pos")), plan.left_rows, "cost", by=("attr",))
        met = tile_reduce(left, right, kernel, "attr long, pos long, prev long, cost double", plan,
                          want=("attr",), have="attr")
        best = met.groupBy("attr", "pos").agg(F.min(F.struct("cost", "prev")).alias("x")).select(
            "attr", "pos", F.col("x.cost").alias("cost"), F.col("x.prev").alias("prev"))
        trail = state.select("attr", F.col("pos").alias("prev"), "cuts")
        state = cut_lineage(best.join(trail, ["attr", "prev"]).join(base.select("attr", "pos", "value"), ["attr", "pos"])
                            .select("attr", "pos", "cost", F.concat("cuts", F.array("value")).alias("cuts")))
    tail_counts = [F.get("whole", i) - F.get("features", i) for i in range(k)]
    last = state.join(base, ["attr", "pos"]).withColumn(
        "lef", F.col("cost") + (F.col("m") - F.col("pos")) / F.col("m") * _entropy(tail_counts))
    best = last.groupBy("attr").agg(F.min(F.struct("lef", "cuts")).alias("x"))
    return best.select(F.col("attr").cast("int").alias("attr"), "x.cuts", "x.lef")


def apply_cuts(points: DataFrame, cuts: DataFrame) -> DataFrame:
    """Cells become the number of their attribute's cuts at or below the value (NaN lies above all). `cuts` is (attr, cut). Cuts are shipped
    while they fit the broadcast limit; beyond it cells meet them in a join, as counts per slice of the cuts."""
    rows = collect_bounded(cuts, 16)
    if rows is None:
        return _apply_by_join(points, cuts)
    by: dict[int, list[float]] = {}
    for r in rows:
        by.setdefault(r["attr"], []).append(r["cut"])
    shipped = points.sparkSession.sparkContext.broadcast({a: np.sort(np.array(c, dtype=np.float64)) for a, c in by.items()})

    @F.arrow_udf("array<double>")
    def number(v: pa.Array) -> pa.Array:
        X = matrix(v)
        out = np.zeros(X.shape)
        for a, c in shipped.value.items():
            if a < X.shape[1]:
                out[:, a] = np.searchsorted(c, X[:, a], side="right")
        return pa.ListArray.from_arrays(pa.array(np.arange(len(X) + 1) * X.shape[1], pa.int32()), pa.array(out.ravel()))

    return points.withColumn("features", number("features"))


def _apply_by_join(points: DataFrame, cuts: DataFrame) -> DataFrame:
    """Every distinct (attr, value) once takes its place among the cuts: both are ordered together, and the cuts up to a value counted by
    slices of the order. Cells then look their number up by an equi-join."""
    spark = points.sparkSession
    cells = long_form(points, "id")
    values = cells.select("attr", "value").distinct()
    both = values.withColumn("c", F.lit(0)).unionByName(cuts.select("attr", F.col("cut").alias("value"), F.lit(1).alias("c")))
    # Cuts come before an equal value.
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sliced = cut_lineage(both.repartitionByRange(slices, "attr", "value", F.desc("c")).withColumn("slice", F.spark_partition_id()))
    prior = Window.partitionBy("attr").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offset = sliced.groupBy("attr", "slice").agg(F.sum("c").alias("n")).select("attr", "slice", F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("before"))
    inner = Window.partitionBy("attr", "slice").orderBy("value", F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)
    placed = sliced.withColumn("here", F.sum("c").over(inner)).where("c = 0").join(offset, ["attr", "slice"])
    numbers = placed.select("attr", "value", (F.col("here") + F.col("before")).cast("double").alias("bin"))
    met = cells.join(numbers, ["attr", "value"])
    packed = met.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("attr", "bin"))), lambda x: x["bin"]).alias("features"))
    return points.drop("features").join(packed, "id").select(*points.columns)


class EntropyBinner:
    """Cells to bin numbers by class entropy: `bins` 2, 3, ... optimal bins, or None for the cuts that the MDL criterion accepts."""

    def __init__(self, bins: int | None = None, weight: str = "values"):
        self.bins, self.weight, self.cuts = bins, weight, None

    def fit(self, points: DataFrame) -> "EntropyBinner":
        if self.bins is None:
            found = mdl_cuts(points, self.weight)
        elif self.bins == 2:
            found = two_bin_cuts(points, self.weight).select("attr", "cut")
        else:
            found = optimal_cuts(points, self.bins, self.weight).select("attr", F.explode("cuts").alias("cut"))
        self.cuts = cut_lineage(found)
        return self

    def transform(self, points: DataFrame) -> DataFrame:
        if self.cuts is None:
            raise ValueError("fit first")
        return apply_cuts(points, self.cuts)

    def fit_transform(self, points: DataFrame) -> DataFrame:
        return self.fit(points).transform(points)
