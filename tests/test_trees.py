"""Random trees and forests against a sequential grower with the same draws."""

import numpy as np
import pytest

from vecmine.functions.hashing import hash_uniform_of
from vecmine.operators import trees as T
from vecmine.operators.classify import confusion_counts, measures
from pyspark.sql import functions as F


class Node:
    """Grown one row set at a time."""

    def __init__(self, X, y, w, tree, node, depth, sizes, seed):
        have = w > 0
        classes = sorted(set(y[have]))
        total = {c: int(w[y == c].sum()) for c in classes}
        self.leaf = self.attrs = None
        if len(classes) == 1:
            self.leaf = classes[0]
            return
        if depth == 0:
            self.leaf = min(classes, key=lambda c: (-total[c], c))
            return
        first = y == classes[0]
        self.zero = (X * (w * first)[:, None]).sum(0) / (w * first).sum()
        self.rest = (X * (w * ~first)[:, None]).sum(0) / (w * ~first).sum()
        for k, size in enumerate(sizes):
            order = sorted(range(X.shape[1]), key=lambda a: (hash_uniform_of(a, f"{seed}:{tree}:{node}:{k}"), a))
            self.attrs = sorted(order[:size])
            right = self.right(X)
            if 0 < w[right].sum() < w.sum():
                self.kids = [Node(X[~right], y[~right], w[~right], tree, 2 * node, depth - 1, sizes, seed),
                             Node(X[right], y[right], w[right], tree, 2 * node + 1, depth - 1, sizes, seed)]
                return
        self.attrs, self.leaf = None, min(classes, key=lambda c: (hash_uniform_of(c, f"{seed}:{tree}:{node}:leaf"), c))

    def right(self, X):
        a = self.attrs
        return np.abs(X[:, a] - self.zero[a]).sum(1) > np.abs(X[:, a] - self.rest[a]).sum(1)

    def ask(self, x):
        return self.leaf if self.leaf is not None else self.kids[int(self.right(x[None])[0])].ask(x)


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(11)
    y = r.choice(["a", "b", "c"], 160, p=[0.5, 0.3, 0.2])
    X = r.normal(size=(160, 4)) + np.array([{"a": 0.0, "b": 1.0, "c": -1.5}[c] for c in y])[:, None] * np.array([1.0, 0.5, 0.0, -0.7])
    X[140:150], y[140:150] = X[140], ["a", "b"] * 5  # equal rows of two classes: no try parts them
    return X, y


def rows_of(make, data):
    X, y = data
    return make(X, labels=[str(c) for c in y]).drop("prediction")


def grown_plainly(data, w, trees, depth, seed=1):
    X, y = data
    sizes = T.try_sizes(4, 2)
    return [Node(X, y, w[:, t], t, 1, depth, sizes, seed) for t in range(trees)]


def test_try_sizes():
    assert T.try_sizes(4, 2) == [2, 4] and T.try_sizes(4, 1) == [1, 4] and T.try_sizes(64, 3) == [3, 12, 27, 48, 64] and T.try_sizes(3, 9) == [3]


def check_tree(make, data, depth):
    rows = rows_of(make, data)
    plain = grown_plainly(data, np.ones((160, 1), int), 1, depth)[0]
    got = {r.id: r for r in T.random_tree(rows, attributes=2, depth=depth).transform(rows).collect()}
    assert [got[i].predicted for i in range(160)] == [plain.ask(x) for x in data[0]]
    assert all(r.distribution == {r.predicted: 1.0} for r in got.values())


@pytest.mark.parametrize("depth", [0, 7])
def test_tree_equals_sequential_grower(make, data, depth):
    check_tree(make, data, depth)


def test_tree_equals_sequential_grower_beyond_the_limit(make, data, tiles_only):
    check_tree(make, data, 4)


def plain_forest(make, data, trees, depth):
    rows = rows_of(make, data)
    forest, bagged = T.random_forest(rows, trees=trees, attributes=2, depth=depth)
    held = {r.id: np.array(r.w) for r in bagged.collect()}
    w = np.array([held[i] for i in range(160)])
    grown = grown_plainly(data, w, trees, depth)
    return rows, forest, bagged, w, np.array([[g.ask(x) for g in grown] for x in data[0]])


def majority(votes):
    return min(set(votes), key=lambda c: (-list(votes).count(c), c)) if len(votes) else None


def test_forest_and_its_error_equal_brute_force(make, data):
    rows, forest, bagged, w, votes = plain_forest(make, data, 7, 5)
    assert 0.2 < (w == 0).mean() < 0.55 and w.max() > 1
    got = {r.id: r for r in forest.transform(rows).collect()}
    for i in range(160):
        assert got[i].predicted == majority(votes[i])
        assert got[i].distribution == pytest.approx({c: list(votes[i]).count(c) / 7 for c in set(votes[i])})
    said = [majority(votes[i][w[i] == 0]) for i in range(160)]
    seen = [i for i in range(160) if said[i] is not None]
    row = T.out_of_bag_error(forest, bagged).first()
    assert row.tested == len(seen) and row.error == pytest.approx(np.mean([said[i] != data[1][i] for i in seen]))


def test_forest_beyond_the_limit(make, data, tiles_only):
    rows, forest, bagged, w, votes = plain_forest(make, data, 3, 3)
    assert forest.rows is None
    got = {r.id: r.predicted for r in forest.transform(rows).collect()}
    assert got == {i: majority(votes[i]) for i in range(160)}
    assert T.out_of_bag_error(forest, bagged).first().tested == sum((w == 0).any(axis=1))


def test_permutation_equals_brute_force(spark, make, data):
    rows, forest, bagged, w, _ = plain_forest(make, data, 5, 4)
    plain = grown_plainly(data, w, 5, 4)
    X, y = data
    lo, hi = X.min(0), X.max(0)
    f = []
    for a in range(-1, 4):
        Z = X.copy()
        if a >= 0:
            Z[:, a] = [lo[a] + hash_uniform_of(f"{i}|{a}", "1:noise") * (hi[a] - lo[a]) for i in range(160)]
        said = [(i, str(y[i]), majority(np.array([g.ask(Z[i]) for t, g in enumerate(plain) if w[i, t] == 0]))) for i in range(160)]
        frame = spark.createDataFrame([s for s in said if s[2] is not None], "id long, label string, predicted string")
        f.append(measures(confusion_counts(frame)).agg(F.sum("f_measure")).first()[0])
    drop = f[0] - np.array(f[1:])
    want = (drop - drop.min()) / (drop.max() - drop.min())
    got = {r.attr: r.score for r in T.permutation_scores(forest, bagged).collect()}
    assert [got[a] for a in range(4)] == pytest.approx(want)


def test_permutation_counts_votes_where_the_rows_are(make, data, monkeypatch):
    X, y = data
    X = X.copy()
    X[5, 2] = np.nan  # speaks in every sum of its row, whatever attributes a node asks for
    rows = make(X, labels=[None if i == 7 else str(c) for i, c in enumerate(y)]).drop("prediction")
    forest, bagged = T.random_forest(rows, trees=5, attributes=2, depth=4)
    shipped, forest.rows = forest.rows, None
    want = {r.attr: r.score for r in T.permutation_scores(forest, bagged).collect()}  # votes by joins
    forest.rows = shipped
    monkeypatch.setattr(T, "out_of_bag", lambda *_: pytest.fail("changed rows or their votes left the tasks"))
    assert {r.attr: r.score for r in T.permutation_scores(forest, bagged).collect()} == pytest.approx(want)


def test_odd_inputs(spark, make):
    one = make([[1.0, 2.0], [3.0, 4.0]], labels=["x", "x"]).drop("prediction")
    assert {r.predicted for r in T.random_tree(one).transform(one).collect()} == {"x"}
    unlabelled = make([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], labels=["x", "y", None]).drop("prediction")
    got = {r.id: r.predicted for r in T.random_tree(unlabelled).transform(unlabelled).collect()}
    assert got[0] == "x" and got[1] == "y" and got[2] == "y"
    none = one.where("label = 'z'")
    assert [r.predicted for r in T.random_tree(none).transform(one).collect()] == [None, None]
