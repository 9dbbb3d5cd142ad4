"""Operators give the same rows on both sides of their size limits, and special values are placed by rank."""

import numpy as np
import pytest

from vecmine.operators import clustering as C
from vecmine.operators import sampling as P
from vecmine.operators import silhouette as S
from vecmine.operators import stats as A

INF, NAN = float("inf"), float("nan")


def test_percentiles_with_special_values(make):
    v = np.r_[np.random.default_rng(3).normal(size=60), [NAN, NAN, INF, -INF, -INF, 1e308, -1e308]]
    points, s = make(np.c_[v, np.full(len(v), NAN)]), np.sort(v)
    for options in ({}, {"small": 10, "bins": 8}):
        for r in A.percentiles(points, [1.0, 25.0, 50.0, 93.0, 97.0, 99.9], **options).collect():
            pos = (len(v) + 1) * r["p"] / 100
            k = int(max(1, min(pos, len(v))))
            f = 0 if pos < 1 or pos >= len(v) else pos - k
            a, b = s[k - 1], s[min(k, len(v) - 1)]
            want = NAN if r["attr"] else a if f < 1e-12 or a == b else a + f * (b - a)
            np.testing.assert_allclose(r["value"], want, rtol=1e-9)


def _both_ways(spark, run):
    first = run()
    spark.conf.set("spark.vecmine.broadcastBytes", "64")
    try:
        return first, run()
    finally:
        spark.conf.unset("spark.vecmine.broadcastBytes")


def test_kmeans_does_not_depend_on_the_limit(make, spark):
    X = np.random.default_rng(5).normal(size=(60, 3))
    points = make(X)
    one, two = _both_ways(spark, lambda: {r["id"]: r["prediction"] for r in C.kmeans(points, 4, 3).collect()})
    assert one == two


def test_pps_parameters_reach_the_join(make, spark):
    rng = np.random.default_rng(6)
    points = make(rng.normal(size=(40, 3)), rng.integers(0, 2, 40))
    one, two = _both_ways(spark, lambda: {
        r["id"]: r["gamma"] for r in P.pps_probabilities(points, 4, metric="minkowski", p=4.0).select("id", "gamma").collect()})
    assert one.keys() == two.keys() and all(abs(one[i] - two[i]) < 1e-12 for i in one)


def test_kmedoids_keeps_all_clusters(make):
    rng = np.random.default_rng(7)
    X = np.r_[rng.normal(size=(20, 2)), rng.normal(size=(20, 2)) + 60, np.zeros((15, 2))]
    assert C.kmedoids(make(X), 4, 6, seed=3).select("prediction").distinct().count() == 4
    assert C.kmedoids(make(np.repeat([[0.0], [1.0]], 10, axis=0)), 4, 2).select("prediction").distinct().count() == 2


def test_one_cluster_is_refused(make):
    points = make([[0.0], [1.0], [3.0]])
    for scores in (S.simplified_scores, S.simplified_centroid_scores, S.frahling_sohler_scores, S.sq_euclidean_scores):
        with pytest.raises(ValueError):
            scores(points)


def test_mdl_segments_are_never_brought_together(make, monkeypatch):
    """A step of the recursion reads the table where it is: neither a sort nor an exchange by segment sees all values of an attribute."""
    import vecmine.operators.discretize as Z

    v = np.r_[np.random.default_rng(4).permutation(200) / 7.0, NAN, INF]
    points = make(np.c_[v, np.where(v > 9, 3.0, v)], labels=["a" if x < 9 or x > 21 else "b" for x in v])
    kind, met = type(points), []
    join = kind.join
    monkeypatch.setattr(kind, "join", lambda *args, **kw: met.append(join(*args, **kw)) or met[-1])
    assert len(Z.mdl_cuts(points).collect()) >= 3
    plans = [t._jdf.queryExecution().executedPlan().toString() for t in met if "vfrom" in t.columns]
    assert plans and not any("SortMergeJoin" in p or "Exchange hashpartitioning" in p for p in plans)


def _peak(run):
    """Result of a call and the most bytes that it held."""
    import tracemalloc

    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_distances_of_separate_points_take_two_buffers():
    from vecmine.functions.distances import block_distance

    r = np.random.default_rng(5)
    X, Y = r.normal(size=(400, 64)), r.normal(size=(500, 64))
    got, most = _peak(lambda: block_distance("euclidean", X, Y))
    assert most < 2.5 * got.nbytes
    assert np.allclose(got, np.sqrt(((X[:, None] - Y[None]) ** 2).sum(axis=2)))
    Y[:3], Y[3] = X[:3], np.nan  # copies are exactly 0, whatever else is in the block
    got = block_distance("euclidean", X, Y)
    assert (got[[0, 1, 2], [0, 1, 2]] == 0).all() and np.isnan(got[:, 3]).all() and np.isfinite(got[:, 4:]).all()


def test_forest_of_few_near_pairs_lists_them(monkeypatch):
    from types import SimpleNamespace

    class Ids(SimpleNamespace):
        def __len__(self):
            return len(self.ids)

    r = np.random.default_rng(6)
    for same in (True, False):
        left = Ids(key=1, ids=r.permutation(1000))
        right = left if same else Ids(key=2, ids=1000 + r.permutation(1000))
        near = r.random((1000, 1000)) < 0.0004
        near = near | near.T | np.eye(1000, dtype=bool) if same else near
        listed, most = _peak(lambda: C._local_forest(left, right, near))
        assert most < 2 * near.nbytes
        monkeypatch.setattr(C, "SPARSE", 1 << 40)
        assert (C._local_forest(left, right, near) == listed).all() and len(listed) > 300
        monkeypatch.undo()


def test_many_clusterings_with_infinite_points(make, spark):
    """Sums by products fall back to sums by cluster where a distance is infinite; many clusters never go by products."""
    from pyspark.sql import functions as F

    X = np.random.default_rng(7).normal(size=(300, 20))
    X[5, 0] = INF
    points = make(X, np.arange(300) % 3)
    labels = F.array(F.col("prediction"), F.col("id") % 150)
    got = {(x.conf, x.id): (x.a, x.b) for x in S.exact_scores_many(points.withColumn("labels", labels)).collect()}
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(axis=2))
    for conf, own in ((0, np.arange(300) % 3), (1, np.arange(300) % 150)):
        for i in (0, 1, 17, 298):
            means = {c: D[i, own == c].sum() / ((own == c).sum() - (c == own[i])) for c in set(own)}
            a, b = means.pop(own[i]), min(means.values())
            assert np.allclose(got[conf, i], (a, b))
