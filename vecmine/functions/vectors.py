"""Column expressions over array<double> vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def product(v: Column) -> Column:
    return F.aggregate(v, F.lit(1.0), lambda acc, x: acc * x)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda a: a * a)))


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def harmonic_mean(v: Column) -> Column:
    return F.try_divide(F.size(v).cast("double"), total(F.transform(v, lambda a: F.try_divide(F.lit(1.0), a))))


def add(x: Column, y) -> Column:
    return _pairwise(x, y, lambda a, b: a + b)


def subtract(x: Column, y) -> Column:
    return _pairwise(x, y, lambda a, b: a - b)


def multiply(x: Column, y) -> Column:
    return _pairwise(x, y, lambda a, b: a * b)


def divide(x: Column, y) -> Column:
    return _pairwise(x, y, F.try_divide)


def _pairwise(x: Column, y, op) -> Column:
    if isinstance(y, (int, float)):
        return F.transform(x, lambda a: op(a, F.lit(float(y))))
    return F.zip_with(x, y, op)


def sqrt(v: Column) -> Column:
    return F.transform(v, lambda a: F.sqrt(a))


def absolute(v: Column) -> Column:
    return F.transform(v, lambda a: F.abs(a))


def argmax(v: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def argmin(v: Column) -> Column:
    return (F.array_position(v, F.array_min(v)) - 1).cast("int")


def normalize_sum(v: Column) -> Column:
    """Divide by the total so that the values add up to one."""
    return F.transform(v, lambda a: F.try_divide(a, total(v)))


def sort_order(v: Column) -> Column:
    """Positions that sort the vector ascending, ties by position."""
    tagged = F.transform(v, lambda a, i: F.struct(a.alias("v"), i.alias("i")))
    return F.transform(F.array_sort(tagged), lambda s: s["i"])


def softmax(v: Column, base: float | None = None) -> Column:
    """Logs to probabilities, shifted by the maximum for stability."""
    power = (lambda a: F.exp(a)) if base is None else (lambda a: F.pow(F.lit(base), a))
    scaled = F.transform(v, lambda a: power(a - F.array_max(v)))
    return F.transform(scaled, lambda a: a / total(scaled))


def densify(sparse: Column, size, default: float = 0.0) -> Column:
    """map<int,double> to a vector of `size` values."""
    last = _int(size) - 1
    return F.transform(
        F.sequence(F.lit(0), last.cast("int")),
        lambda i: F.coalesce(F.try_element_at(sparse, i.cast("int")), F.lit(float(default))),
    )


def _int(x) -> Column:
    return x if isinstance(x, Column) else F.lit(int(x))


def int_set(v: Column) -> Column:
    """Distinct values after truncation towards zero."""
    return F.array_distinct(F.transform(v, lambda a: a.cast("bigint")))


def truncate(v: Column) -> Column:
    """Towards zero; NaN and infinities stay as they are."""
    return F.transform(v, _trunc)


def _trunc(a: Column) -> Column:
    return F.when(F.isnan(a) | (F.abs(a) >= F.lit(9.0e18)), a).otherwise(
        F.when(a < 0, F.ceil(a)).otherwise(F.floor(a)).cast("double")
    )


UNROLL = 256


def map_cells(v: Column, dims: int, fn, *stats: list[float]) -> Column:
    """fn(cell, stat_i...) per attribute. Up to UNROLL attributes become one generated-code expression each;
    wider vectors use an array lambda."""
    if dims <= UNROLL:
        return F.array(*[fn(F.get(v, i), *[F.lit(float(s[i])) for s in stats]) for i in range(dims)])
    arrays = [F.array(*[F.lit(float(x)) for x in s]) for s in stats]
    return F.transform(v, lambda x, i: fn(x, *[F.get(a, i) for a in arrays]))
