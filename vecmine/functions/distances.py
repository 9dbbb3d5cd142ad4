"""Registry of measures: a Column expression for row-wise use, a NumPy block form for the pair jobs.

Every measure has a direction: ``smaller`` (distances), ``larger`` (similarities) or ``absolute``
(correlations, larger magnitude is closer). Kernels without an order have direction ``none``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vectors as V


@dataclass(frozen=True)
class Measure:
    name: str
    column: Callable[..., Column]
    direction: str = "smaller"
    block: Callable[..., np.ndarray] | None = None
    params: dict = field(default_factory=dict)

    def closer(self, a: Column, b: Column) -> Column:
        """True when score `a` means nearer than score `b`."""
        if self.direction == "smaller":
            return a < b
        if self.direction == "larger":
            return a > b
        if self.direction == "absolute":
            return F.abs(a) > F.abs(b)
        raise ValueError(f"{self.name} has no order")

    def badness(self, score: Column) -> Column:
        """A value that sorts ascending from nearest to farthest."""
        if self.direction == "smaller":
            return score
        if self.direction == "larger":
            return -score
        if self.direction == "absolute":
            return -F.abs(score)
        raise ValueError(f"{self.name} has no order")

    def badness_np(self, score: np.ndarray) -> np.ndarray:
        return score if self.direction == "smaller" else (-score if self.direction == "larger" else -np.abs(score))


# ---- column forms -------------------------------------------------------------------------------

def _diffs(x, y):
    return F.zip_with(x, y, lambda a, b: a - b)


def sq_euclidean(x, y):
    return V.total(F.transform(_diffs(x, y), lambda d: d * d))


def euclidean(x, y, nan_policy: str = "propagate"):
    if nan_policy == "skip":
        kept = F.filter(_diffs(x, y), lambda d: ~F.isnan(d))
        return F.sqrt(V.total(F.transform(kept, lambda d: d * d)))
    return F.sqrt(sq_euclidean(x, y))


def minkowski(x, y, p: float = 2.0):
    powered = F.transform(_diffs(x, y), lambda d: F.pow(F.abs(d), F.lit(float(p))))
    return F.pow(V.total(powered), F.lit(1.0 / p))


def manhattan(x, y):
    return V.total(V.absolute(_diffs(x, y)))


def chebyshev(x, y):
    return F.array_max(V.absolute(_diffs(x, y)))


def cosine_similarity(x, y):
    raw = F.try_divide(V.dot(x, y), V.norm(x) * V.norm(y))
    return F.when(raw < 0, F.lit(0.0)).otherwise(raw)


def cosine_distance(x, y):
    return F.lit(1.0) - cosine_similarity(x, y)


def jaccard_similarity(x, y):
    a, b = V.int_set(x), V.int_set(y)
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def jaccard_distance(x, y):
    return F.lit(1.0) - jaccard_similarity(x, y)


def consistency_index(x, y, n: int = 100):
    a, b = V.int_set(x), V.int_set(y)
    k = F.greatest(F.size(a), F.size(b)).cast("double")
    r = F.size(F.array_intersect(a, b)).cast("double")
    value = F.try_divide(r * n - k * k, k * (F.lit(float(n)) - k))
    return F.when((k == 0) | (k == n), F.lit(0.0)).otherwise(value)


def pearson(x, y):
    n = F.size(x).cast("double")
    sx, sy = V.total(x), V.total(y)
    cov = V.dot(x, y) - sx * sy / n
    vx = V.dot(x, x) - sx * sx / n
    vy = V.dot(y, y) - sy * sy / n
    return F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy))


def spearman_rank(x, y):
    k = F.size(x).cast("double")
    return F.lit(1.0) - F.lit(6.0) * sq_euclidean(x, y) / (k * (k * k - 1))


def spearman_footrule(x, y):
    k = F.size(x)
    even = k * k / F.lit(2.0)
    odd = (k + 1) * (k - 1) / F.lit(2.0)
    return F.lit(1.0) - manhattan(x, y) / F.when(k % 2 == 0, even).otherwise(odd)


def angular(x, y):
    """Distance in spherical angles of two 3-D vectors: polar and azimuth difference, azimuth taken the short way."""
    full = 2.0 * math.pi

    def polar(v):
        return F.atan2(F.sqrt(F.get(v, 0) * F.get(v, 0) + F.get(v, 1) * F.get(v, 1)), F.get(v, 2))

    def azimuth(v):
        raw = F.atan2(F.get(v, 1), F.get(v, 0))
        return F.when(raw < 0, raw + full).otherwise(raw)

    tilt = polar(x) - polar(y)
    turn = F.abs(azimuth(x) - azimuth(y))
    turn = F.least(turn, full - turn)
    return F.sqrt(tilt * tilt + turn * turn)


def max_product(x, y):
    best = F.array_max(F.zip_with(x, y, lambda a, b: a * b))
    return F.when(best > 0, best).otherwise(F.lit(float("nan")))


def polynomial_kernel(x, y, p: float = 1.0):
    return F.pow(V.dot(x, y), F.lit(float(p)))


def linear_kernel(x, y):
    return V.dot(x, y)


def rbf_kernel(x, y, gamma: float = 0.01):
    return F.exp(F.lit(float(gamma)) * (F.lit(2.0) * V.dot(x, y) - V.dot(x, x) - V.dot(y, y)))


def rbf_distance(x, y, gamma: float = 0.01):
    return F.lit(1.0) - rbf_kernel(x, y, gamma)


def midrange_scaled(v: Column, low: Column, high: Column) -> Column:
    """Map each attribute to [0, 1] by its range in the dataset; constant attributes go to the middle."""
    span = F.zip_with(low, high, lambda a, b: b - a)
    shifted = F.zip_with(v, low, lambda a, b: a - b)
    return F.zip_with(shifted, span, lambda a, s: F.coalesce(F.try_divide(a, s), F.lit(0.5)))


def normalized_euclidean(x, y, low, high):
    """Euclidean distance after scaling by the dataset's ranges, divided by sqrt(dimensions)."""
    return euclidean(midrange_scaled(x, low, high), midrange_scaled(y, low, high)) / F.sqrt(F.size(x))


def normalized_euclidean_similarity(x, y, low, high):
    return F.lit(1.0) - normalized_euclidean(x, y, low, high)


def mahalanobis(x, y, inverse: Column):
    """`inverse` holds the rows of the inverted covariance matrix of the dataset."""
    diff = _diffs(x, y)
    return F.sqrt(V.dot(F.transform(inverse, lambda row: V.dot(row, diff)), diff))


# ---- block forms: (n, d) x (m, d) -> (n, m) ------------------------------------------------------

def _block_sq(X, Y):
    if X.shape[1] <= 16:
        def step(out, d):
            d *= d
            out += d
        return _accumulate(X, Y, step)
    xx = np.einsum("ij,ij->i", X, X)
    yy = np.einsum("ij,ij->i", Y, Y)
    scale = xx[:, None] + yy[None, :]
    d2 = X @ Y.T
    d2 *= -2.0
    d2 += scale
    if d2.size and d2.min() > 1e-4 * (xx.max() + yy.max()):
        return d2
    # Cancellation: near-identical pairs are recomputed from their differences, so copies get exactly 0.
    near = np.nonzero(~(d2 > 1e-4 * scale))
    step = max(1, (1 << 22) // max(1, X.shape[1]))
    for s in range(0, len(near[0]), step):
        i, j = near[0][s:s + step], near[1][s:s + step]
        diff = X[i] - Y[j]
        d2[i, j] = np.einsum("ij,ij->i", diff, diff)
    return d2


def _block_euclidean(X, Y):
    d2 = _block_sq(X, Y)
    return np.sqrt(d2, out=d2)


# Cells whose sums and differences stay in a core's cache while the attributes are gone through.
CACHE_CELLS = 1 << 14


def _accumulate(X, Y, step):
    """`step(sums, differences)` for every attribute in turn; a step may overwrite the differences."""
    out, columns = np.zeros((len(X), len(Y))), np.ascontiguousarray(Y.T)
    rows = max(1, CACHE_CELLS // max(1, len(Y)))
    gaps = np.empty((min(rows, len(X)), len(Y)))
    for s in range(0, len(X), rows):
        part, sums = X[s:s + rows], out[s:s + rows]
        for a in range(X.shape[1]):
            step(sums, np.subtract(part[:, a, None], columns[a], out=gaps[:len(part)]))
    return out


def _block_manhattan(X, Y):
    def step(out, d):
        out += np.abs(d, out=d)
    return _accumulate(X, Y, step)


def _block_chebyshev(X, Y):
    def step(out, d):
        np.maximum(out, np.abs(d, out=d), out=out)
    return _accumulate(X, Y, step)


def _block_minkowski(X, Y, p=2.0):
    def step(out, d):
        out += np.abs(d, out=d) ** p
    return _accumulate(X, Y, step) ** (1.0 / p)


def _block_nan_euclidean(X, Y):
    def step(out, d):
        out += np.where(np.isnan(d), 0.0, d * d)
    return np.sqrt(_accumulate(X, Y, step))


def _block_cosine_sim(X, Y):
    nx = np.sqrt(np.einsum("ij,ij->i", X, X))
    ny = np.sqrt(np.einsum("ij,ij->i", Y, Y))
    sim = X @ Y.T
    with np.errstate(divide="ignore", invalid="ignore"):
        sim /= nx[:, None] * ny[None, :]
        return np.maximum(sim, 0.0, out=sim)


def _block_cosine_dist(X, Y):
    return 1.0 - _block_cosine_sim(X, Y)


def _block_pearson(X, Y):
    cx = X - X.mean(axis=1, keepdims=True)
    cy = Y - Y.mean(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (cx @ cy.T) / (np.linalg.norm(cx, axis=1)[:, None] * np.linalg.norm(cy, axis=1)[None, :])


def _block_linear(X, Y):
    return X @ Y.T


def _block_rbf(X, Y, gamma=0.01):
    return np.exp(-gamma * _block_sq(X, Y))


def _block_rbf_dist(X, Y, gamma=0.01):
    return 1.0 - _block_rbf(X, Y, gamma)


def _block_sets(X, Y):
    """(sizes of the rows' integer sets, of both sides, and of their intersections)."""
    def cells(Z):
        whole = np.trunc(Z).astype(np.int64)
        row = np.repeat(np.arange(len(Z)), Z.shape[1])
        once = np.unique(np.c_[row, whole.ravel()], axis=0) if whole.size else np.zeros((0, 2), np.int64)
        return once[:, 0], once[:, 1]

    (rx, vx), (ry, vy) = cells(X), cells(Y)
    shared = np.intersect1d(vx, vy)
    both = np.zeros((len(X), len(Y)))
    # Values in slices, so that the indicator matrices stay small whatever the range of the values.
    for s in range(0, len(shared), 4096):
        part = shared[s: s + 4096]
        A, B = (np.zeros((n, len(part)), np.float32) for n in (len(X), len(Y)))
        for M, r, v in ((A, rx, vx), (B, ry, vy)):
            at = np.minimum(np.searchsorted(part, v), len(part) - 1)
            hit = part[at] == v
            M[r[hit], at[hit]] = 1.0
        both += A @ B.T
    return np.bincount(rx, minlength=len(X)), np.bincount(ry, minlength=len(Y)), both


def _block_jaccard(X, Y):
    a, b, both = _block_sets(X, Y)
    return both / (a[:, None] + b[None, :] - both)


def _block_consistency(X, Y, n=100):
    a, b, both = _block_sets(X, Y)
    k = np.maximum(a[:, None], b[None, :]).astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        value = (both * n - k * k) / (k * (n - k))
    return np.where((k == 0) | (k == n), 0.0, value)


def _block_spearman(X, Y):
    k = float(X.shape[1])
    return 1.0 - 6.0 * _block_sq(X, Y) / (k * (k * k - 1))


def _block_footrule(X, Y):
    k = X.shape[1]
    return 1.0 - _block_manhattan(X, Y) / (k * k / 2.0 if k % 2 == 0 else (k + 1) * (k - 1) / 2.0)


def _block_angular(X, Y):
    def angles(V):
        turn = np.arctan2(V[:, 1], V[:, 0])
        return np.arctan2(np.sqrt(V[:, 0] ** 2 + V[:, 1] ** 2), V[:, 2]), np.where(turn < 0, turn + 2 * math.pi, turn)

    (tx, ax), (ty, ay) = angles(X), angles(Y)
    turn = np.abs(ax[:, None] - ay[None, :])
    return np.sqrt((tx[:, None] - ty[None, :]) ** 2 + np.minimum(turn, 2 * math.pi - turn) ** 2)


def _block_max_product(X, Y):
    out = np.full((len(X), len(Y)), -np.inf)
    for a in range(X.shape[1]):
        np.maximum(out, X[:, a, None] * Y[None, :, a], out=out)
    return np.where(out > 0, out, np.nan)


def _block_polynomial(X, Y, p=1.0):
    return (X @ Y.T) ** p


def _block_normalized(X, Y, low=None, high=None):
    low, high = np.asarray(low, dtype=np.float64), np.asarray(high, dtype=np.float64)
    span = high - low

    def scale(V):
        return np.where(span > 0, (V - low) / np.where(span > 0, span, 1.0), 0.5)

    return _block_euclidean(scale(X), scale(Y)) / math.sqrt(X.shape[1])


def _block_normalized_similarity(X, Y, low=None, high=None):
    return 1.0 - _block_normalized(X, Y, low, high)


def _block_mahalanobis(X, Y, inverse=None):
    # The inverse covariance is L L^T: distances are Euclidean after turning by L.
    L = np.linalg.cholesky(np.asarray(inverse, dtype=np.float64))
    return _block_euclidean(X @ L, Y @ L)


MEASURES: dict[str, Measure] = {
    m.name: m
    for m in [
        Measure("euclidean", euclidean, "smaller", _block_euclidean),
        Measure("nan_euclidean", lambda x, y: euclidean(x, y, "skip"), "smaller", _block_nan_euclidean),
        Measure("sq_euclidean", sq_euclidean, "smaller", _block_sq),
        Measure("minkowski", minkowski, "smaller", _block_minkowski),
        Measure("manhattan", manhattan, "smaller", _block_manhattan),
        Measure("chebyshev", chebyshev, "smaller", _block_chebyshev),
        Measure("cosine_similarity", cosine_similarity, "larger", _block_cosine_sim),
        Measure("cosine_distance", cosine_distance, "smaller", _block_cosine_dist),
        Measure("jaccard_similarity", jaccard_similarity, "larger", _block_jaccard),
        Measure("jaccard_distance", jaccard_distance, "smaller", lambda X, Y: 1.0 - _block_jaccard(X, Y)),
        Measure("consistency_index", consistency_index, "larger", _block_consistency),
        Measure("pearson", pearson, "absolute", _block_pearson),
        Measure("spearman_rank", spearman_rank, "absolute", _block_spearman),
        Measure("spearman_footrule", spearman_footrule, "larger", _block_footrule),
        Measure("normalized_euclidean", normalized_euclidean, "smaller"),
        Measure("normalized_euclidean_similarity", normalized_euclidean_similarity, "larger"),
        Measure("angular", angular, "smaller", _block_angular),
        Measure("mahalanobis", mahalanobis, "smaller"),
        Measure("max_product", max_product, "larger", _block_max_product),
        Measure("linear_kernel", linear_kernel, "none", _block_linear),
        Measure("polynomial_kernel", polynomial_kernel, "none", _block_polynomial),
        Measure("rbf_kernel", rbf_kernel, "none", _block_rbf),
        Measure("rbf_distance", rbf_distance, "smaller", _block_rbf_dist),
    ]
}


def measure(which) -> Measure:
    """A measure by name, a Measure itself, or a user's distance as a ``(Column, Column) -> Column`` callable (no block form: see `custom`)."""
    if isinstance(which, Measure):
        return which
    if callable(which):
        return Measure(getattr(which, "__name__", "custom"), which)
    return MEASURES[which]


def custom(name: str, pair: Callable | None = None, block: Callable | None = None, direction: str = "smaller", column: Callable | None = None) -> Measure:
    """A user's measure for the pair operators: `block(X, Y)` gives the (n, m) matrix of two blocks, or `pair(x, y)` one number, which
    is then asked row by row."""
    if block is None:
        if pair is None:
            raise ValueError("a measure needs a pair or a block function")

        def block(X, Y):
            return np.array([[pair(x, y) for y in Y] for x in X], dtype=np.float64).reshape(len(X), len(Y))
    return Measure(name, column, direction, block)


# Measures that have a block form only once they know numbers of the whole data set: what they need, and that form.
BOUND = {
    "normalized_euclidean": ("ranges", _block_normalized),
    "normalized_euclidean_similarity": ("ranges", _block_normalized_similarity),
    "mahalanobis": ("covariance", _block_mahalanobis),
}


def with_numbers(name: str, **numbers) -> Measure:
    """A measure of BOUND with the data set's numbers."""
    m = MEASURES[name]
    return Measure(m.name, m.column, m.direction, partial(BOUND[name][1], **numbers), numbers)


def block_distance(which, X: np.ndarray, Y: np.ndarray, **params) -> np.ndarray:
    m = measure(which)
    if m.block is None:
        raise ValueError(f"{m.name} has no block form")
    return m.block(X, Y, **params)
