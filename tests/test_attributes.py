import math
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecmine.functions.hashing import hash_uniform
from vecmine.operators import discretize as Z
from vecmine.operators import filters as L
from vecmine.operators import sampling as P
from vecmine.operators import stats as A

NAN, INF = float("nan"), float("inf")


def cells(df):
    return np.array([r["features"] for r in df.orderBy("id").collect()], dtype=float)


def test_hash_uniform_is_md5(spark):
    got = [r[0] for r in spark.range(50).select(hash_uniform(F.col("id"), 9)).collect()]
    assert got == [int(md5(f"{i}|9".encode()).hexdigest()[:13], 16) / 2 ** 52 for i in range(50)]


def test_statistics_skip_missing_in_ranges(make):
    rows = {r["attr"]: r for r in A.attribute_stats(make([[-3.0, 1.0], [NAN, 5.0], [-1.0, 3.0]])).collect()}
    assert (rows[0]["min"], rows[0]["max"]) == (-3.0, -1.0)
    assert rows[1]["mean"] == 3 and abs(rows[1]["std"] - math.sqrt(8 / 3)) < 1e-12


def test_percentile_definition_and_narrowing(make):
    rng = np.random.default_rng(1)
    X = np.c_[rng.normal(size=400), rng.integers(0, 4, 400), np.full(400, 2.5)]
    points = make(X)

    def want(v, p):
        s, pos = np.sort(v), len(v) * p / 100 + p / 100
        k = int(max(1, min(math.floor(pos), len(s))))
        f = 0 if pos < 1 or pos >= len(s) else pos - k
        return s[k - 1] + f * (s[min(k, len(s) - 1)] - s[k - 1])

    for options in ({}, {"small": 5, "bins": 8}):
        for r in A.percentiles(points, [0.1, 25.0, 50.0, 99.95], **options).collect():
            assert abs(r["value"] - want(X[:, r["attr"]], r["p"])) < 1e-9


def test_value_filters(make):
    points = make([[1.0, -1.7, NAN, INF]])
    assert cells(L.floor_values(points))[0][:2].tolist() == [1.0, -1.0]
    assert cells(L.ceil_values(points))[0][:2].tolist() == [2.0, 0.0]
    assert cells(L.round_values(points))[0][:2].tolist() == [1.0, -1.0]
    assert cells(L.replace_value(points, NAN, 9.0))[0][2] == 9.0
    assert cells(L.impute_constant(points, 0.5))[0].tolist() == [1.0, -1.7, 0.5, 0.5]
    assert L.drop_missing(points).count() == 0


def test_class_filters_keep_null_labels(make):
    points = make([[0.0]] * 3, labels=["a", None, "b"])
    assert L.remove_class(points, "a").count() == 2
    assert L.retain_class(points, "a").count() == 1
    assert L.drop_missing_class(points).count() == 2
    assert {r["label"] for r in L.replace_class(points, "a", "z").collect()} == {"z", None, "b"}


def test_trained_filters_need_training(make):
    with pytest.raises(RuntimeError):
        L.MeanScaler().transform(make([[1.0]]))


def test_scalers_on_constant_and_odd_cells(make):
    points = make([[1.0, 5.0], [3.0, 5.0], [NAN, 5.0]])
    mid = cells(L.MidrangeScaler().fit_transform(points))
    assert mid.tolist() == [[-1.0, 0.0], [1.0, 0.0], [0.0, 0.0]]
    binned = cells(L.EqualWidthBinner(10).fit_transform(points))
    assert binned[0].tolist() == [0.0, 0.0] and binned[1].tolist() == [9.0, 0.0]
    assert cells(L.row_midrange(make([[2.0, 2.0], [0.0, 4.0]]))).tolist() == [[0.0, 0.0], [-1.0, 1.0]]


def test_wide_vectors_take_the_array_form(make, monkeypatch):
    from vecmine.functions import vectors as V
    X = np.random.default_rng(2).normal(size=(20, 6))
    narrow = cells(L.MeanScaler().fit_transform(make(X)))
    monkeypatch.setattr(V, "UNROLL", 2)
    assert np.allclose(narrow, cells(L.MeanScaler().fit_transform(make(X))))
    assert np.allclose(narrow, (X - X.mean(axis=0)) / X.std(axis=0))


def test_knn_imputation(make):
    points = make([[0.0, 1.0], [0.1, 3.0], [9.0, 100.0], [0.05, NAN]])
    assert cells(L.impute_knn(points, 2))[3].tolist() == [0.05, 2.0]


def entropy(labels):
    _, n = np.unique(labels, return_counts=True)
    p = n / n.sum()
    return float(-(p * np.log2(p)).sum())


def brute_cuts(values, labels, bins):
    from itertools import combinations
    distinct = np.unique(values)
    best = None
    for cut in combinations(range(1, len(distinct)), bins - 1):
        edges = [0, *cut, len(distinct)]
        cost = sum((b - a) / len(distinct) * entropy(labels[(values >= distinct[a]) & (values <= distinct[b - 1])])
                   for a, b in zip(edges[:-1], edges[1:]))
        key = (round(cost, 10), [distinct[c] for c in cut])
        best = key if best is None or key < best else best
    return best


@pytest.fixture(scope="module")
def labelled():
    rng = np.random.default_rng(5)
    X = np.c_[rng.integers(0, 9, 150), np.round(rng.normal(size=150), 1)].astype(float)
    labels = np.where(X[:, 0] + rng.normal(size=150) > 5, "x", np.where(X[:, 1] > 0.3, "y", "z"))
    return X, labels


@pytest.mark.parametrize("bins", [2, 3, 4])
def test_optimal_cuts_match_brute_force(make, labelled, bins):
    X, labels = labelled
    points = make(X, labels=labels.tolist())
    if bins == 2:
        got = {r["attr"]: (r["lef"], [r["cut"]]) for r in Z.two_bin_cuts(points).collect()}
    else:
        got = {r["attr"]: (r["lef"], r["cuts"]) for r in Z.optimal_cuts(points, bins).collect()}
    for a in range(2):
        cost, cuts = brute_cuts(X[:, a], labels, bins)
        assert abs(got[a][0] - cost) < 1e-8 and got[a][1] == cuts


def mdl(values, labels):
    distinct = np.unique(values)
    out = []

    def split(a, b):
        n = b - a
        if n < 2:
            return
        part = lambda i, j: labels[(values >= distinct[i]) & (values <= distinct[j - 1])]
        cost, cut = min(((c - a) / n * entropy(part(a, c)) + (b - c) / n * entropy(part(c, b)), c) for c in range(a + 1, b))
        whole, left, right = part(a, b), part(a, cut), part(cut, b)
        k, k1, k2 = (len(np.unique(x)) for x in (whole, left, right))
        delta = math.log2(3 ** k - 2) - (k * entropy(whole) - k1 * entropy(left) - k2 * entropy(right))
        bar = (math.log2(n - 1) / n if n > 1 else -INF) + delta / n
        if entropy(whole) - cost >= bar:
            out.append(distinct[cut])
            split(a, cut)
            split(cut, b)

    split(0, len(distinct))
    return sorted(out)


def test_mdl_cuts_match_recursion(make):
    rng = np.random.default_rng(8)
    v = np.round(rng.uniform(0, 10, 300), 2)
    labels = np.where(v < 3, "a", np.where(v < 6.5, "b", "c"))
    w = np.round(rng.normal(size=300), 2)
    points = make(np.c_[v, w], labels=labels.tolist())
    cuts = Z.mdl_cuts(points)
    got = {a: sorted(r["cut"] for r in cuts.collect() if r["attr"] == a) for a in (0, 1)}
    assert got[0] == mdl(v, labels) and len(got[0]) >= 2
    assert got[1] == mdl(w, labels)
    binned = cells(Z.apply_cuts(points, cuts))
    assert (binned[:, 0] == np.searchsorted(got[0], v, side="right")).all()


def test_samples_are_exact_in_size_and_complete(make):
    points = make(np.arange(103)[:, None], labels=["a"] * 70 + ["b"] * 33)
    folds = {r["fold"]: r["count"] for r in P.kfold_split(points, 10).groupBy("fold").count().collect()}
    assert sorted(folds.values()) == [10] * 7 + [11] * 3
    chosen, rest = P.subsample(points, size=40)
    assert chosen.count() == 40 and chosen.unionByName(rest).select("id").distinct().count() == 103
    strat, _ = P.subsample(points, fraction=0.2, stratified=True)
    assert {r["label"]: r["count"] for r in strat.groupBy("label").count().collect()} == {"a": 14, "b": 7}
    bag, oob = P.bootstrap(points, bags=2)
    assert bag.count() == 206
    assert bag.where("bag = 0").select("id").distinct().count() + oob.where("bag = 0").count() == 103


def test_sampling_does_not_depend_on_partitioning(make):
    points = make(np.arange(60)[:, None])
    one = {(r["id"], r["fold"]) for r in P.kfold_split(points.repartition(1), 7).collect()}
    many = {(r["id"], r["fold"]) for r in P.kfold_split(points.repartition(23), 7).collect()}
    assert one == many


def test_nearest_by_known_cells_sums_few_pairs(monkeypatch):
    from vecmine.functions.distances import block_distance
    from vecmine.operators import pairs

    rng = np.random.default_rng(3)
    whole = np.round(rng.normal(size=(90, 20)) * 4) / 10 + 1000.0
    whole[40:44] = whole[7]
    gaps = np.where(rng.random(whole.shape) < 0.2, np.nan, whole)
    for X in (gaps, gaps[:3], np.where(rng.random(whole.shape) < 0.01, np.inf, gaps), gaps * 1e160, gaps * 1e-160, np.full((4, 2), np.nan)):
        usable = ~np.eye(len(X), dtype=bool)
        with np.errstate(all="ignore"):
            want = block_distance("nan_euclidean", X, X)
            got = pairs._near_known(X, X, usable, 5)
        for i in range(len(X)):
            others = [j for j in range(len(X)) if j != i]
            first = sorted((w, j) for w, j in ((want[i, j], j) for j in others))[:5]
            assert sorted((g, j) for g, j in ((got[i, j], j) for j in others) if not np.isnan(g))[:5] == first
    monkeypatch.setattr(pairs, "block_distance", lambda *_: pytest.fail("every pair was summed cell by cell"))
    seen = pairs._near_known(gaps, gaps, ~np.eye(90, dtype=bool), 5)
    assert (~np.isnan(seen)).sum() < 90 * 15
