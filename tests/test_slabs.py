"""Near pairs by slabs: the rows of all pairs, from few blocks."""

import numpy as np
import pytest

from vecmine.functions.distances import block_distance
from vecmine.operators import clustering as C
from vecmine.operators import neighbours as N
from vecmine.operators import slabs as S
from vecmine.operators.pairs import shape_of


@pytest.fixture(scope="module")
def scattered():
    r = np.random.default_rng(2)
    X = np.concatenate([r.normal(size=(150, 3)) * 0.3, r.normal(size=(100, 3)) * 0.3 + 40, np.tile([[7.0, 7.0, 7.0]], (60, 1)), r.normal(size=(40, 3)) * 30])
    X[5], X[6] = [np.nan, 0, 0], [np.inf, 0, 0]
    return X


def plain(X, eps, metric):
    with np.errstate(invalid="ignore"):
        D = block_distance(metric, X, X)
    i, j = np.nonzero(np.triu(D < eps, 1))
    return D, set(zip(i.tolist(), j.tolist()))


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(S, "BLOCK_ROWS", 16)


@pytest.mark.parametrize("metric,eps", [("euclidean", 0.5), ("sq_euclidean", 0.3), ("manhattan", 0.8), ("chebyshev", 0.3), ("minkowski", 0.5), ("euclidean", 1000.0)])
def test_range_join_equals_all_pairs(make, scattered, small_blocks, metric, eps):
    points = make(scattered)
    got = [(r.id, r.other) for r in N.range_join(points, eps, metric).collect()]
    D, want = plain(scattered, eps, metric)
    assert len(got) == len(set(got)) and set(got) == want
    degrees = {r.id: r.degree for r in N.neighbour_counts(points, eps, metric).collect()}
    assert degrees == {i: int((D[i] < eps).sum()) for i in range(len(scattered))}


def test_other_measures_still_meet_all_blocks(make, scattered):
    X = np.abs(scattered[:50]) + 0.1
    X = X[np.isfinite(X).all(axis=1)]
    got = {(r.id, r.other) for r in N.range_join(make(X), 0.01, "cosine_distance").collect()}
    assert got == plain(X, 0.01, "cosine_distance")[1]


def test_few_blocks_meet_on_separated_data(make, spark):
    r = np.random.default_rng(3)
    X = r.normal(size=(3200, 4)) * 0.05 + r.permutation(np.repeat(np.arange(200), 16))[:, None] * np.array([1.0, 2.0, -1.0, 0.5])
    points = make(X)
    n, d = shape_of(points)
    frame = S.frame_of(points, d, 0.2, "euclidean")
    blocks = S.pack_ordered(points, 20, 16, frame)
    count = blocks.count()
    pairs = S.near_blocks(blocks, None, frame).count()
    assert 200 <= count <= 220 and pairs < 4 * count
    assert N.range_join(points, 0.2).count() == len(plain(X, 0.2, "euclidean")[1])


def test_copies_do_not_fill_one_stripe(make):
    X = np.zeros((4000, 2))
    X[:1000] = np.random.default_rng(1).normal(size=(1000, 2))
    points = make(X)
    frame = S.frame_of(points, 2, 0.1, "euclidean")
    sizes = [r["count"] for r in S.pack_ordered(points, 8, 64, frame).groupBy("stripe").count().collect()]
    assert max(sizes) < 2 * sum(sizes) / 8


@pytest.mark.parametrize("eps,least", [(0.35, 4), (0.0, 3), (2000.0, 5)])
def test_dbscan_equals_plain_one(make, scattered, small_blocks, eps, least):
    X = scattered[np.isfinite(scattered).all(axis=1)]
    D, _ = plain(X, eps, "euclidean")
    near = D < eps
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(X)), -1)
    for _ in range(len(X)):
        new = label.copy()
        for i in np.flatnonzero(core):
            new[i] = label[np.flatnonzero(near[i] & core)].min()
        if (new == label).all():
            break
        label = new
    want = {}
    for i in range(len(X)):
        around = np.flatnonzero(near[i] & core)
        if core[i]:
            want[i] = int(label[i])
        elif len(around):
            want[i] = int(label[around].min())
    got = {r.id: r.prediction for r in C.dbscan(make(X), eps, least, normalize=False).collect()}
    assert got == want


def test_empty_points(make):
    none = make([[1.0, 2.0]]).where("id < 0")
    assert N.range_join(none, 1.0).count() == 0 and C.dbscan(none, 1.0, 2, normalize=False).count() == 0
