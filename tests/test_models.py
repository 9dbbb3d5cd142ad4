"""Classifiers as objects: distributions, fits by group, bagging and cross-validation of any of them."""

import numpy as np
import pytest

from vecmine.operators import classify as K
from vecmine.operators import models as M


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(4)
    y = r.choice(["a", "b", "c"], 90, p=[0.5, 0.3, 0.2])
    X = np.round(r.normal(size=(90, 3)) + np.array([{"a": 0, "b": 2, "c": -2}[c] for c in y])[:, None])
    return X, [str(c) for c in y]


@pytest.fixture
def points(make, data):
    return make(data[0], labels=data[1]).drop("prediction")


@pytest.mark.parametrize("classifier", [M.Majority(), M.NearestMean(), M.NearestNeighbours(3), M.NaiveBayes(), M.RandomTree(depth=3),
                                        M.Bagging(M.NearestMean(), 3), M.FitPredict(K.knn_predict)], ids=lambda c: type(c).__name__)
def test_every_classifier_gives_a_distribution(points, classifier):
    rows = classifier.fit(points).transform(points).collect()
    assert len(rows) == 90
    for r in rows:
        assert sum(r.distribution.values()) == pytest.approx(1.0)
        assert r.distribution[r.predicted] == max(r.distribution.values())


def plain_means(X, y, w, Z):
    classes = sorted(set(np.array(y)[w > 0]))
    means = np.array([np.average(X[[c == k for c in y]], axis=0, weights=w[[c == k for c in y]]) for k in classes])
    return [classes[int(np.argmin(((means - z) ** 2).sum(1)))] for z in Z]


def test_bagging_equals_brute_force(points, data):
    X, y = data
    model = M.Bagging(M.NearestMean(), 5).fit(points)
    w = np.array([r.w for r in model.rows.orderBy("id").collect()])
    votes = np.array([plain_means(X, y, w[:, b], X) for b in range(5)]).T
    top = lambda v: min(set(v), key=lambda c: (-list(v).count(c), c)) if len(v) else None
    got = {r.id: r for r in model.transform(points).collect()}
    for i in range(90):
        assert got[i].predicted == top(votes[i]) and got[i].distribution == pytest.approx({c: list(votes[i]).count(c) / 5 for c in set(votes[i])})
    out = [top(votes[i][w[i] == 0]) for i in range(90)]
    seen = [i for i in range(90) if out[i] is not None]
    row = model.out_of_bag_error().first()
    assert row.tested == len(seen) and row.error == pytest.approx(np.mean([out[i] != y[i] for i in seen]))


def test_cross_validation_of_any_classifier(points):
    one = sorted(map(tuple, M.cross_validate(M.NearestMean(), points, 4).collect()))
    assert one == sorted(map(tuple, K.cross_validate_nearest_mean(points, 4).collect()))
    slow = K.cross_validate(points, K.knn_predict, 3)
    assert sorted(map(tuple, slow.collect())) == sorted(map(tuple, M.cross_validate(M.FitPredict(K.knn_predict), points, 3).collect()))


def test_groups_in_one_pass_equal_single_fits(points, data):
    grouped = points.withColumn("g", (points.id % 3).cast("int"))
    for classifier in (M.Majority(), M.NearestMean()):
        for g, model in enumerate(classifier.fit_groups(grouped, "g", 3)):
            alone = classifier.fit(points.where(points.id % 3 == g))
            assert sorted((r.id, r.predicted) for r in model.transform(points).collect()) == sorted((r.id, r.predicted) for r in alone.transform(points).collect())


def test_unlabelled_rows_teach_nothing(make):
    rows = make([[0.0], [1.0], [9.0], [9.0], [9.0]], labels=["x", "y", None, None, None]).drop("prediction")
    got = {r.id: r.predicted for r in M.NearestMean().fit(rows).transform(rows).collect()}
    assert got == {0: "x", 1: "y", 2: "y", 3: "y", 4: "y"}
    assert {r.predicted for r in M.Majority().fit(rows).transform(rows).collect()} == {"x"}
