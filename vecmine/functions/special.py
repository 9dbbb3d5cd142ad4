"""Special functions as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Numerators of the Stirling series of ln gamma: fixed values.
_STIRLING = [(1, 12.0), (-1, 360.0), (1, 1260.0), (-1, 1680.0), (1, 1188.0)]


def log_gamma(x: Column) -> Column:
    """ln gamma(x) for x > 0: argument raised by 8, then the Stirling series (error below 1e-13)."""
    shift = F.lit(0.0)
    for i in range(8):
        shift = shift + F.log(x + float(i))
    y = x + 8.0
    series = F.lit(0.0)
    for i, (sign, den) in enumerate(_STIRLING):
        series = series + F.lit(sign / den) / F.pow(y, F.lit(2.0 * i + 1))
    half_log_2pi = 0.9189385332046727
    return (y - 0.5) * F.log(y) - y + half_log_2pi + series - shift


def tail_probability(x: float, df: int) -> float:
    """Chance that a chi-square variable with `df` degrees exceeds x: a finite sum, since 2 * (df / 2) is whole. Terms are added in
    logarithms, so large arguments do not overflow."""
    if df <= 0 or x <= 0:
        return 1.0
    h, odd = x / 2, df % 2
    k = np.arange((df - odd) // 2) + (0.5 if odd else 0.0)
    # h^k e^-h / Gamma(k + 1), the logarithms built up from one term to the next.
    steps = np.log(h) - np.log(k[1:])
    first = -h - math.lgamma(k[0] + 1) + k[0] * math.log(h) if len(k) else 0.0
    terms = first + np.r_[0.0, np.cumsum(steps)] if len(k) else np.zeros(0)
    return float(min(1.0, np.exp(terms).sum() + (math.erfc(math.sqrt(h)) if odd else 0.0)))


def chi_square_tail(x: Column, df: Column) -> Column:
    """`tail_probability` of columns."""
    @F.arrow_udf("double")
    def tail(x: pa.Array, df: pa.Array) -> pa.Array:
        return pa.array([None if a is None or n is None else tail_probability(a, n) for a, n in zip(x.to_pylist(), df.to_pylist())], pa.float64())

    return tail(x, df)
