"""Hard negatives against the plain definition, with ties, odd vectors, several blocks and groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecmine.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, anchor, k=5):
    """Sorted answers; anchors of one vec_id with another vector or label ask apart, equal ones once."""
    good = []
    for i, v, c in rows:
        if i is None or c is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        good.append((i, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v), c))
    lengths = [len(v) for _, v, _ in good]
    usual = min(set(lengths), key=lambda n: (-lengths.count(n), n)) if lengths else 0
    good = [g for g in good if len(g[1]) == usual]
    out = []
    for i, v, c in sorted(set(good)):
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, d) for j, w, d in good if j != i)
        for s, p, _ in [x for x in scored if x[2] == c][:k]:
            s = -s
            fit = [x for x in scored if x[2] != c and 80 * s <= -100 * x[0] <= 100 * s][:k]
            out += [(i, p, r + 1, j, s, -t) for r, (t, j, _) in enumerate(fit)]
    return sorted(out)


def answered(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({"block": F.lit("b"), "group": F.lit(7), "x": F.lit(None).cast("string"), "score": F.lit(0)})


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 8))
    out = []
    for i in range(700):
        v = centres[i % 6] + r.normal(size=8) * 0.4
        out.append((i, [float(np.float32(x)) for x in (np.round(v * 4) / 4 if i % 3 else v)], int(r.integers(0, 4))))
    out += [(1000 + i, [0.5] * 8, i % 2) for i in range(60)]            # copies of one vector: ties by vec_id
    out += [(20, [0.5] * 8, 1), (20, [0.5] * 8, 1), (30, out[30][1], out[30][2])]   # repeated ids
    out += [(40, [0.0] * 8, 2), (2000, None, 1), (2001, [1.0] * 8, None), (None, [1.0] * 8, 1), (2010, [1.0, None] + [0.0] * 6, 1),
            (2020, [float("nan")] + [0.0] * 7, 1), (2030, [float("inf")] + [0.0] * 7, 1), (2040, [1.0] * 3, 1), (2050, [], 1)]
    return out


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 60, "anchor_rows": 9, "sample": 50, "clusters": 3}])
def test_equals_definition(spark, rows, sizes):
    got = hardneg.mine(table(spark, rows).repartition(3), F.col("vec_id") % 10 == 0, **sizes)
    assert answered(got) == plain(rows, lambda i: i % 10 == 0)


def test_walk_stops_early_and_loses_nothing():
    r = np.random.default_rng(6)
    centres = r.normal(size=(20, 16)) * 4
    x = np.floor(256 * (centres[r.integers(0, 20, 8000)] + r.normal(size=(8000, 16)) * 0.2)).astype(np.int64)
    rows = hardneg.Rows(np.arange(8000), r.integers(0, 5, 8000), x)
    members = hardneg.Rows(np.arange(0, 8000, 100), rows.labels[::100], x[::100])
    unit = hardneg.fit_centres(x.astype(float), 20)
    far = np.iinfo(np.int64).max
    everyone = np.arange(80)
    slot, row, score, made = hardneg.shared_walks(members, np.argmax(members.real @ unit.T, 1), unit, rows, everyone, np.full(80, -far), np.full(80, far), 5, True)
    assert made < 80 * 8000 / 2
    for s in everyone:
        p = x @ members.x[s]
        p[(rows.labels != members.labels[s]) | (rows.ids == members.ids[s])] = -far
        want = np.lexsort((rows.ids, -p))[:5]
        assert row[slot == s].tolist() == want.tolist() and score[slot == s].tolist() == p[want].tolist()


def test_large_components_stay_exact():
    a = hardneg.Rows(np.array([1]), np.array([0]), np.array([[2 ** 30 + 1, 3]]))
    b = hardneg.Rows(np.array([2]), np.array([0]), np.array([[2 ** 30 - 1, 5]]))
    assert hardneg.products(a, np.array([0]), b, np.array([0]))[0, 0] == (2 ** 30 + 1) * (2 ** 30 - 1) + 15


def test_empty_and_useless_tables(spark):
    for rows in ([], [(1, None, 1)], [(1, [1.0], 1)], [(100, [1.0, 2.0], 1)]):
        assert hardneg.mine(table(spark, rows), F.col("vec_id") % 100 == 0).count() == 0


def test_positive_score_of_zero_or_less(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [-1.0, 0.0], 0), (2, [-1.0, 0.5], 1), (3, [0.0, 1.0], 1), (4, [0.0, 2.0], 0)]
    assert answered(hardneg.mine(table(spark, rows), F.col("vec_id") % 100 == 0)) == plain(rows, lambda i: i % 100 == 0)
