"""Attribute-wise statistics of a point set."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.points import long_form


def attribute_stats(points: DataFrame) -> DataFrame:
    """(attr, n, min, max, mean, std): one row per attribute; minima and maxima skip NaN, std is the population one."""
    finite = F.when(~F.isnan("value"), F.col("value"))
    return long_form(points).groupBy("attr").agg(
        F.count(F.lit(1)).alias("n"), F.min(finite).alias("min"), F.max(finite).alias("max"),
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def as_row(per_attr: DataFrame) -> DataFrame:
    """One row of arrays, in attribute order; as wide as a single point."""
    names = [c for c in per_attr.columns if c != "attr"]
    packed = per_attr.agg(F.array_sort(F.collect_list(F.struct("attr", *names))).alias("r"))
    return packed.select(*[F.col(f"r.{c}").alias(c) for c in names])


def percentiles(points: DataFrame, ps: list[float], small: int = 200_000, bins: int = 1024) -> DataFrame:
    """(attr, p, value): percentiles at position p(n+1)/100 with linear interpolation, clamped at both ends."""
    cells = long_form(points)
    bounds = _bounds(cells)
    spots = []
    for attr, (*_, n) in bounds.items():
        for p in ps:
            pos = n * p / 100.0 + p / 100.0
            k = int(max(1, min(math.floor(pos), n)))
            spots.append((attr, p, k, min(k + 1, n), 0.0 if pos < 1 or pos >= n else pos - k))
    found = order_statistics(cells, bounds, {(a, k) for a, _, k1, k2, _ in spots for k in (k1, k2)}, small, bins)
    rows = []
    for a, p, k, k2, f in spots:
        x, y = found[a, k], found[a, k2]
        rows.append((a, float(p), x if f == 0 or x == y else x + f * (y - x)))
    return points.sparkSession.createDataFrame(pa.table({
        "attr": pa.array([x[0] for x in rows], pa.int32()), "p": [x[1] for x in rows], "value": [x[2] for x in rows]}))


def _bounds(cells: DataFrame) -> dict[int, tuple]:
    """{attr: (min and max of the finite cells, their count, cells of -inf, cells of +inf, all cells)}; as many entries as a
    point has attributes."""
    v, inf = F.col("value"), F.lit(math.inf)
    finite = F.when(F.abs(v) < inf, v)
    got = cells.groupBy("attr").agg(
        F.min(finite).alias("lo"), F.max(finite).alias("hi"), F.count(finite).alias("m"), F.count(F.when(v == -inf, 1)).alias("low"),
        F.count(F.when(v == inf, 1)).alias("high"), F.count("value").alias("n"))
    return {r["attr"]: (r["lo"], r["hi"], r["m"], r["low"], r["high"], r["n"]) for r in got.collect()}


_RANGE = pa.schema([("attr", pa.int32()), ("rng", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("before", pa.int64())])


def order_statistics(cells: DataFrame, bounds: dict, need: set[tuple[int, int]], small: int = 200_000,
                     bins: int = 1024) -> dict[tuple[int, int], float]:
    """{(attr, k): k-th smallest value} of the (attr, value) cells.

    Histograms narrow each rank down to a range with at most `small` values (or one distinct value) before any
    sorting, so no task ever sorts a whole attribute. Infinite and NaN cells (last, as in Spark) are placed by their counts.
    """
    spark = cells.sparkSession
    # Open ranges: (attr, lo, hi, values inside, values below) -> ranks looked for.
    open_: dict[tuple, set[int]] = {}
    found: dict[tuple[int, int], float] = {}
    for attr, k in need:
        lo, hi, m, low, high, _ = bounds[attr]
        if low < k <= low + m:
            open_.setdefault((attr, lo, hi, m, low), set()).add(k)
        else:
            found[attr, k] = -math.inf if k <= low else math.inf if k <= low + m + high else math.nan

    def settle():
        for key in [x for x in open_ if x[1] == x[2]]:
            found.update({(key[0], k): key[1] for k in open_.pop(key)})

    def inside(keys):
        rows = [{"attr": a, "rng": i, "lo": lo, "hi": hi, "before": before} for i, (a, lo, hi, _, before) in enumerate(keys)]
        state = F.broadcast(spark.createDataFrame(pa.Table.from_pylist(rows, schema=_RANGE)))
        return cells.join(state, "attr").where((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi")))

    settle()
    while wide := [x for x in open_ if x[3] > small]:
        # Halves, since the difference of two finite values can be infinite.
        share = F.try_divide(F.col("value") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2)
        slot = F.coalesce(F.least(F.floor(share * bins), F.lit(bins - 1)), F.lit(bins))
        hist = inside(wide).groupBy("attr", "rng", "before", slot.cast("int").alias("bin")).agg(
            F.count(F.lit(1)).alias("m"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        w = Window.partitionBy("rng").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("upto", F.col("before") + F.sum("m").over(w))  # at most `bins` + 1 rows per window
        ranks = [(i, k) for i, key in enumerate(wide) for k in open_[key]]
        asked = F.broadcast(spark.createDataFrame(pa.table({
            "rng": pa.array([x[0] for x in ranks], pa.int32()), "k": pa.array([x[1] for x in ranks], pa.int64())})))
        hit = hist.join(asked, "rng").where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("m") < F.col("k"))).collect()
        for key in wide:
            del open_[key]
        for r in hit:  # one row per rank still open
            open_.setdefault((r["attr"], r["lo"], r["hi"], r["m"], r["upto"] - r["m"]), set()).add(r["k"])
        if stuck := [x[0] for x in wide if x in open_ and x[1] < x[2]]:
            raise ArithmeticError(f"values of attributes {sorted(set(stuck))} lie too close for a histogram")
        settle()
    if open_:
        keys = list(open_)
        w = Window.partitionBy("attr", "rng").orderBy("value")
        ranked = inside(keys).withColumn("k", F.row_number().over(w) + F.col("before"))
        asked = F.broadcast(spark.createDataFrame(pa.table({
            "rng": pa.array([i for i, x in enumerate(keys) for _ in open_[x]], pa.int32()),
            "k": pa.array([k for x in keys for k in open_[x]], pa.int64())})))
        for r in ranked.join(asked, ["rng", "k"]).select("attr", "k", "value").collect():  # one row per rank
            found[r["attr"], r["k"]] = r["value"]
    return found


def column_correlation(points: DataFrame, i: int, j: int) -> DataFrame:
    """Sample variances, covariance and correlation of two attributes."""
    pair = points.select(F.get("features", i).alias("x"), F.get("features", j).alias("y"))
    return pair.agg(F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), F.var_samp("x").alias("var_x"),
                    F.var_samp("y").alias("var_y"), F.corr("x", "y").alias("corr"))
