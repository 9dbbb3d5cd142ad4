"""Row and value filters, imputation and normalisation: DataFrame in, DataFrame out.

Row-local filters are functions. Those that learn from data follow `fit(points)` then `transform(points)`; what they
learn is one value list per statistic, as wide as a single point, so transforming never shuffles or joins points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.points import long_form
from .pairs import nearest
from .stats import as_row, attribute_stats, percentiles


NAN = float("nan")


# ---- classes -------------------------------------------------------------------------------------

def remove_class(points: DataFrame, name: str) -> DataFrame:
    return points.where(~F.col("label").eqNullSafe(F.lit(name)))


def retain_class(points: DataFrame, name: str = "0") -> DataFrame:
    return points.where(F.col("label") == name)


def replace_class(points: DataFrame, old: str, new: str) -> DataFrame:
    return points.withColumn("label", F.when(F.col("label") == old, F.lit(new)).otherwise(F.col("label")))


def unset_class(points: DataFrame) -> DataFrame:
    return points.withColumn("label", F.lit(None).cast("string"))


def drop_missing_class(points: DataFrame) -> DataFrame:
    return points.dropna(subset=["label"])


# ---- attributes and values -----------------------------------------------------------------------

def _listed(indices) -> Column:
    return F.array(*[F.lit(int(i)) for i in sorted(set(indices))])


def remove_attributes(points: DataFrame, indices) -> DataFrame:
    kept = F.filter("features", lambda x, i: ~F.array_contains(_listed(indices), i))
    return points.withColumn("features", kept)


def retain_attributes(points: DataFrame, indices) -> DataFrame:
    kept = F.filter("features", lambda x, i: F.array_contains(_listed(indices), i))
    return points.withColumn("features", kept)


def _values(points: DataFrame, fn) -> DataFrame:
    return points.withColumn("features", F.transform("features", fn))


def floor_values(points: DataFrame) -> DataFrame:
    """Truncates towards zero."""
    return points.withColumn("features", V.truncate(F.col("features")))


def ceil_values(points: DataFrame) -> DataFrame:
    """Truncation of x + 1, so whole numbers move up by one."""
    return points.withColumn("features", V.truncate(F.transform("features", lambda x: x + 1)))


def round_values(points: DataFrame) -> DataFrame:
    """Truncation of x + 0.5."""
    return points.withColumn("features", V.truncate(F.transform("features", lambda x: x + 0.5)))


def replace_value(points: DataFrame, old: float, new: float) -> DataFrame:
    return _values(points, lambda x: F.when(x.eqNullSafe(F.lit(float(old))), F.lit(float(new))).otherwise(x))


def _bad(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def drop_missing(points: DataFrame) -> DataFrame:
    return points.where(~F.exists("features", lambda x: F.isnan(x)))


def impute_constant(points: DataFrame, value: float) -> DataFrame:
    """Replaces NaN and infinities."""
    return _values(points, lambda x: F.when(_bad(x), F.lit(float(value))).otherwise(x))


def impute_knn(points: DataFrame, k: int = 5) -> DataFrame:
    """NaN cells become the mean of the known values of the k nearest points (distance over shared known cells)."""
    holes = points.where(F.exists("features", lambda x: F.isnan(x)))
    near = nearest(holes, points, k, "nan_euclidean", same=True).select("id", "neighbour")
    values = near.join(points.select(F.col("id").alias("neighbour"), "features"), "neighbour")
    means = long_form(values, "id").where(~F.isnan("value")).groupBy("id", "attr").agg(F.avg("value").alias("m"))
    fill = means.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("attr", "m"))).alias("fill"))  # one point wide
    filled = F.transform("features", lambda x, i: F.when(
        F.isnan(x), F.coalesce(F.try_element_at(F.col("fill"), i), x)).otherwise(x))
    patched = holes.join(fill, "id", "left").withColumn("features", filled).select(*points.columns)
    whole = points.where(~F.exists("features", lambda x: F.isnan(x)))
    return whole.unionByName(patched)


# ---- trained normalisers -------------------------------------------------------------------------

class Scaler:
    """Base of the trained filters.

    `learn` gives one row of value lists (each as wide as a point), `prepare` turns them into the constants that `cell`
    applies to one value.
    """

    stats: tuple[str, ...] = ()
    constants: list[list[float]] | None = None

    def learn(self, points: DataFrame) -> DataFrame:
        return attribute_stats(points)

    def prepare(self, *stats: float) -> tuple[float, ...]:
        raise NotImplementedError

    def cell(self, x: Column, *constants: Column) -> Column:
        raise NotImplementedError

    def fit(self, points: DataFrame) -> "Scaler":
        row = as_row(self.learn(points).select("attr", *self.stats)).first()
        made = [self.prepare(*(NAN if v is None else v for v in values)) for values in zip(*(row[n] for n in self.stats))]
        self.constants = [list(c) for c in zip(*made)]
        return self

    def transform(self, points: DataFrame) -> DataFrame:
        if self.constants is None:
            raise RuntimeError("fit the filter before transforming")
        return points.withColumn(
            "features", V.map_cells(F.col("features"), len(self.constants[0]), self.cell, *self.constants))

    def fit_transform(self, points: DataFrame) -> DataFrame:
        return self.fit(points).transform(points)


def _inverse(width: float) -> float:
    return 1.0 / width if width else NAN


class MeanScaler(Scaler):
    """(x - mean) / population standard deviation; NaN for a constant attribute."""

    stats = ("mean", "std")

    def prepare(self, mean, std):
        return mean, _inverse(std)

    def cell(self, x, mean, inverse):
        return (x - mean) * inverse


class MedianIqrScaler(MeanScaler):
    """(x - median) / ((Q3 - Q1) / 1.35)."""

    stats = ("q1", "median", "q3")

    def learn(self, points):
        p = percentiles(points, [25.0, 50.0, 75.0])
        return p.groupBy("attr").agg(*[F.max(F.when(F.col("p") == q, F.col("value"))).alias(n)
                                       for q, n in ((25.0, "q1"), (50.0, "median"), (75.0, "q3"))])

    def prepare(self, q1, median, q3):
        return median, _inverse((q3 - q1) / 1.35)


class MidrangeScaler(Scaler):
    """Range to `width` around `middle`; constant, missing and infinite cells become `middle`."""

    stats = ("min", "max")

    def __init__(self, middle: float = 0.0, width: float = 2.0):
        self.middle, self.width = float(middle), float(width)

    def prepare(self, low, high):
        span = high - low
        return (low + high) / 2, span if span > 0 else float("inf")

    def cell(self, x, centre, span):
        # NaN sorts above infinity, so it takes the other branch too.
        y = (x - centre) / span * self.width + self.middle
        return F.when(F.abs(x) < F.lit(float("inf")), y).otherwise(F.lit(self.middle))


class EqualWidthBinner(Scaler):
    """Bin number trunc((x - min) / (max - min) * (bins - 1)); constant attributes and missing cells go to bin 0."""

    stats = ("min", "max")

    def __init__(self, bins: int = 10):
        self.bins = bins

    def prepare(self, low, high):
        return low, high - low if high > low else float("inf")

    def cell(self, x, low, span):
        y = F.nanvl((x - low) / span * F.lit(float(self.bins - 1)), F.lit(0.0))
        return F.greatest(F.least(y, F.lit(9e15)), F.lit(-9e15)).cast("bigint").cast("double")


def row_midrange(points: DataFrame, middle: float = 0.0, width: float = 2.0) -> DataFrame:
    """Midrange scaling within each row; rows narrower than 1e-6 become all `middle`."""
    lo, hi = F.array_min("features"), F.array_max("features")
    scaled = F.transform("features", lambda x: F.try_divide(x - (lo + hi) / 2, hi - lo) * float(width) + float(middle))
    flat = F.transform("features", lambda x: F.lit(float(middle)))
    return points.withColumn("features", F.when(hi - lo < 1e-6, flat).otherwise(scaled))
