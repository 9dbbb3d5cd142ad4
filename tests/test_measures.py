"""Every measure in the pair operators: block forms against column forms, bound statistics, and users' own measures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecmine.functions import distances as D
from vecmine.operators import clustering as C
from vecmine.operators import neighbours as N
from vecmine.operators import silhouette as S
from vecmine.operators.pairs import bound, covariance


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(9)
    X = np.round(r.normal(size=(45, 3)) * 4, 1)
    X[7] = X[8]
    X[9] = [0.0, 0.0, 0.0]
    return X


def literal(rows):
    return F.array(*[F.array(*[F.lit(float(v)) for v in row]) if np.ndim(row) else F.lit(float(row)) for row in rows])


@pytest.mark.parametrize("name", sorted(D.MEASURES))
def test_block_form_equals_column_form(spark, make, data, name):
    points, params = make(data), {}
    m = D.measure(bound(points, name))
    need = D.BOUND.get(name, ("", None))[0]
    if need == "ranges":
        params = {"low": literal(data.min(0)), "high": literal(data.max(0))}
    elif need:
        params = {"inverse": literal(np.linalg.inv(np.cov(data.T)))}
    pairs = make(data[:6]).select(F.col("id").alias("i"), F.col("features").alias("x")).crossJoin(points.select(F.col("id").alias("j"), F.col("features").alias("y")))
    want = {(r.i, r.j): r.v for r in pairs.select("i", "j", m.column(F.col("x"), F.col("y"), **params).alias("v")).collect()}
    got = m.block(data[:6], data)
    for (i, j), v in want.items():
        if v is None or np.isnan(v):
            assert not np.isfinite(got[i, j])
        else:
            assert got[i, j] == pytest.approx(v, abs=1e-9)


def test_covariance_of_far_away_points(make):
    X = np.random.default_rng(1).normal(size=(300, 4)) + 1e6
    assert covariance(make(X).repartition(7), 4) == pytest.approx(np.cov(X.T), rel=1e-6)


@pytest.mark.parametrize("name", ["mahalanobis", "normalized_euclidean", "jaccard_distance", "spearman_footrule", "angular", "max_product"])
def test_neighbours_under_every_measure(make, data, name):
    X = np.abs(data) + 0.5 if name == "max_product" else data
    points = make(X)
    m = D.measure(bound(points, name))
    bad = m.badness_np(m.block(X, X))
    bad[np.isnan(bad)] = np.inf
    np.fill_diagonal(bad, np.inf)
    got = {}
    for r in N.knn_join(points, 2, name).collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbour))
    # Equal distances may differ in the last bit between blockings, so distances are compared, not names.
    for i in range(len(X)):
        assert [bad[i, j] for _, j in sorted(got[i])] == pytest.approx(np.sort(bad[i])[:2].tolist(), abs=1e-9)


@pytest.mark.parametrize("name", ["mahalanobis", "jaccard_distance"])
def test_silhouette_and_clustering_under_other_measures(make, data, name):
    cluster = (np.arange(len(data)) % 3).tolist()
    points = make(data, clusters=cluster)
    m = D.measure(bound(points, name))
    B = m.block(data, data)
    means = np.array([[B[i][[k for k in range(len(data)) if cluster[k] == c and k != i]].mean() for c in range(3)] for i in range(len(data))])
    got = {r.id: r.s for r in S.exact_scores(points, name).collect()}
    for i in range(len(data)):
        a, b = means[i, cluster[i]], min(means[i, c] for c in range(3) if c != cluster[i])
        assert got[i] == pytest.approx((b - a) / max(a, b) if max(a, b) else 0.0, abs=1e-6)
    assert C.kmeans(points.drop("prediction"), 2, iterations=5, metric="mahalanobis").where("prediction IS NULL").count() == 0


def test_own_measures(make, data):
    points = make(data)
    by_pair = D.custom("gap", pair=lambda x, y: abs(x[0] - y[0]) + 2 * abs(x[1] - y[1]))
    by_block = D.custom("gap", block=lambda X, Y: np.abs(X[:, None, 0] - Y[None, :, 0]) + 2 * np.abs(X[:, None, 1] - Y[None, :, 1]))
    one, two = (sorted(map(tuple, N.knn_join(points, 3, m).collect())) for m in (by_pair, by_block))
    assert one == two and len(one) == 3 * len(data)
    assert N.range_join(points, 2.0, by_block).count() == int((np.triu(by_block.block(data, data) < 2.0, 1)).sum())
    with pytest.raises(ValueError):
        D.custom("nothing")
    with pytest.raises(ValueError):
        D.block_distance(lambda x, y: x, data, data)


def test_summed_measures_work_in_the_cache(monkeypatch):
    from vecmine.functions import distances as D

    rng = np.random.default_rng(5)
    X, Y = rng.normal(size=(70, 20)), rng.normal(size=(300, 20))
    monkeypatch.setattr(D, "CACHE_CELLS", 1000)
    seen = []

    def step(sums, gaps):
        seen.append(gaps.size)
        sums += np.abs(gaps, out=gaps)

    plain = np.zeros((70, 300))
    for a in range(20):
        plain += np.abs(X[:, a, None] - Y[None, :, a])
    assert (D._accumulate(X, Y, step) == plain).all() and max(seen) <= 1000
    assert (D.block_distance("manhattan", X, Y) == plain).all()
