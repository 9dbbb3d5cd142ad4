import numpy as np
import pytest
from pyspark.sql import functions as F

from vecmine.operators import sampling as P
from vecmine.operators import silhouette as S


def dist(X):
    return np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(axis=2))


def brute(D, code, singleton_one=True):
    s = []
    for i in range(len(D)):
        sums = {c: D[i, code == c].sum() for c in np.unique(code)}
        n_own = (code == code[i]).sum()
        a = sums[code[i]] / (n_own - 1) if n_own > 1 else 0.0
        b = min(v / (code == c).sum() for c, v in sums.items() if c != code[i])
        s.append(0.0 if max(a, b) == 0 else (b - a) / max(a, b))
    return np.array(s)


def by_id(df, col="s"):
    return np.array([r[col] for r in df.orderBy("id").collect()])


def test_exact_matches_brute_force(make, blobs):
    X, code = blobs
    got = by_id(S.exact_scores(make(X, code)))
    assert np.allclose(got, brute(dist(X), code), atol=1e-9)
    assert (np.abs(got) <= 1).all()


def test_exact_does_not_depend_on_partitioning(make, blobs):
    X, code = blobs
    points = make(X, code)
    one = by_id(S.exact_scores(points.repartition(1)))
    many = by_id(S.exact_scores(points.repartition(37)))
    assert np.allclose(one, many, atol=1e-12)


def test_other_metrics(make, blobs):
    X, code = blobs
    D = np.abs(X[:, None, :] - X[None, :, :]).sum(axis=2)
    assert np.allclose(by_id(S.exact_scores(make(X, code), "manhattan")), brute(D, code), atol=1e-9)


def test_singleton_and_copies(make):
    points = make([[0.0], [0.0], [5.0]], [3, 3, 9])  # ids of clusters need not be contiguous
    rows = {r["id"]: r for r in S.exact_scores(points).collect()}
    assert rows[2]["a"] == 0 and rows[2]["s"] == 1
    zero = {r["id"]: r["s"] for r in S.exact_scores(points, singleton="zero").collect()}
    assert zero[2] == 0 and zero[0] == 1


def test_all_points_equal_scores_zero(make):
    assert S.summarize(S.exact_scores(make([[1.0, 2.0]] * 4, [0, 0, 1, 1]))).first()["silh"] == 0


def test_one_cluster_is_an_error(make):
    with pytest.raises(ValueError):
        S.exact_scores(make([[0.0], [1.0]], [0, 0]))


def test_full_samples_equal_exact(make, blobs):
    X, code = blobs
    points = make(X, code)
    want = S.summarize(S.exact_scores(points)).first()["silh"]
    assert abs(S.pps_silhouette(points, 1000).first()["silh"] - want) < 1e-9
    assert abs(S.uniform_silhouette(points, 1000).first()["silh"] - want) < 1e-9


def test_estimates_centre_on_the_exact_score(make, blobs):
    X, code = blobs
    points = make(X, code).cache()
    want = S.summarize(S.exact_scores(points)).first()["silh"]
    seeds = list(range(1, 61))
    for call in (S.pps_silhouette, S.uniform_silhouette):
        got = call(points, 12, seeds=seeds).agg(F.avg("silh")).first()[0]
        assert abs(got - want) < 0.1


def test_pps_probabilities_match_their_definition(make, blobs):
    X, code = blobs
    points = make(X, code)
    t, delta = 6, 0.1
    rows = {r["id"]: r for r in P.pps_probabilities(points, t, delta).collect()}
    D = dist(X)
    m = P.initial_sample_size(3, delta)
    from hashlib import md5
    u = [int(md5(f"{i}|1:s0".encode()).hexdigest()[:13], 16) / 2 ** 52 for i in range(len(X))]
    for c in range(3):
        own = np.nonzero(code == c)[0]
        s0 = sorted(own, key=lambda i: (u[i], i))[:m]
        W = D[np.ix_(s0, own)].sum(axis=1)
        for i in own:
            gamma = max(1 / len(own), max(D[s, i] / w for s, w in zip(s0, W)))
            assert abs(rows[i]["gamma"] - gamma) < 1e-12
            assert abs(rows[i]["pi"] - (1.0 if len(own) <= t else min(1, t * gamma))) < 1e-12


def test_ways_without_broadcast_agree(make, blobs, spark):
    X, code = blobs
    points = make(X, code)
    calls = {
        "pps": lambda: S.pps_silhouette(points, 8, seeds=[1, 2]).orderBy("run").collect()[1]["silh"],
        "uniform": lambda: S.uniform_silhouette(points, 8, seeds=[1, 2]).orderBy("run").collect()[1]["silh"],
        "simplified": lambda: S.summarize(S.simplified_scores(points)).first()["silh"],
        "centroid": lambda: S.summarize(S.simplified_centroid_scores(points)).first()["silh"],
        "squared": lambda: S.summarize(S.sq_euclidean_scores(points)).first()["silh"],
        "nearest": lambda: S.summarize(S.frahling_sohler_scores(points)).first()["silh"],
    }
    local = {n: f() for n, f in calls.items()}
    spark.conf.set("spark.vecmine.broadcastBytes", "1")
    try:
        tiled = {n: f() for n, f in calls.items()}
    finally:
        spark.conf.unset("spark.vecmine.broadcastBytes")
    for n in calls:
        assert abs(local[n] - tiled[n]) < 1e-9, n


def test_squared_matches_brute_force_and_spark(make, blobs):
    X, code = blobs
    points = make(X, code)
    got = by_id(S.sq_euclidean_scores(points))
    assert np.allclose(got, brute(dist(X) ** 2, code), atol=1e-9)
    assert abs(got.mean() - S.builtin_sq_euclidean(points)) < 1e-9


def test_sample_size_and_ranking(make, spark):
    assert S.sample_size(1000, 4, 0.1, 0.1) == 600
    scores = spark.createDataFrame([(0, 0.2), (1, 0.5), (2, 0.5)], "conf int, silh double")
    assert [r["conf"] for r in S.rank_configurations(scores).where("best").collect()] == [1]


def test_tail_of_a_skewed_cluster_is_kept(make):
    """Nine tenths of the points in one cluster, mostly copies: nobody is dropped."""
    rng = np.random.default_rng(3)
    X = np.r_[np.zeros((90, 2)), rng.normal(size=(10, 2)) + 5]
    code = np.r_[np.zeros(90, int), np.ones(10, int)]
    scores = S.exact_scores(make(X, code))
    assert scores.count() == 100
    assert np.allclose(by_id(scores), brute(dist(X), code), atol=1e-9)
