"""Sampling reports with settings, clustering with files, generated points with labels, chi-square tails, applied cuts."""

import math

import numpy as np
import pytest

from vecmine.functions.special import tail_probability
from vecmine.operators import discretize as Z
from vecmine.operators import sampling as P
from vecmine.sources import files as X
from vecmine.sources import generate as Y


def test_uniform_report_counts_every_point(make):
    points = make(np.zeros((50, 2)), clusters=[0] * 40 + [1] * 10)
    rows = {(r.run, r.prediction): r for r in P.uniform_report(points, 20, seeds=(1, 2), eps=0.1, delta=0.2).collect()}
    assert set(rows) == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert all((r.n, r.expected) == ((40, pytest.approx(20)) if c == 0 else (10, 10)) for (_, c), r in rows.items())
    assert all((r.t, r.eps, r.delta) == (20, 0.1, 0.2) for r in rows.values())
    drawn = P.uniform_sample(points, 20, (1, 2)).groupBy("run", "prediction").count().collect()
    assert {(r.run, r.prediction): r["count"] for r in drawn} == {k: r.realised for k, r in rows.items()}


def test_clusterize_reads_and_writes(spark, make, tmp_path):
    r = np.random.default_rng(2)
    X_ = np.concatenate([r.normal(size=(30, 2)), r.normal(size=(20, 2)) + 50])
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    X.export_clustering(make(X_), source, 2)
    X.clusterize(spark, source, target, 2)
    rows = X.read_clustered_csv(spark, target).collect()
    groups = {}
    for row in rows:
        groups.setdefault(row.prediction, set()).add(row.features[0] > 25)
    assert len(rows) == 50 and sorted(map(len, groups.values())) == [1, 1]


def test_generated_points_carry_clusters(spark):
    rows = Y.clustered_points(spark, 200, 2, dims=3, outliers=3, major=100.0).collect()
    assert len(rows) == 203 and {r.prediction for r in rows} <= {0, 1} and sum(r.outlier for r in rows) == 3


def test_chi_square_tail():
    assert tail_probability(10.520896359, 4) == pytest.approx(0.032510362, abs=1e-8)
    assert tail_probability(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert tail_probability(7.814727903251179, 3) == pytest.approx(0.05, abs=1e-12)
    assert tail_probability(5.991464547107979, 2) == pytest.approx(0.05, abs=1e-12)
    assert tail_probability(0.0, 5) == 1.0 and tail_probability(5.0, 0) == 1.0 and tail_probability(1e6, 7) == 0.0
    assert 0.4 < tail_probability(100_000.0, 100_000) < 0.6 and math.isfinite(tail_probability(99_999.5, 99_999))


def test_cuts_by_join_equal_shipped_ones(spark, make, tiles_only):
    X_ = np.random.default_rng(3).integers(0, 9, (60, 3)).astype(float)
    X_[4, 1] = np.nan
    cuts = spark.createDataFrame([(0, 3.0), (0, 5.5), (1, 1.0), (1, 2.0), (1, 8.0)], "attr int, cut double")
    got = {r.id: r.features for r in Z.apply_cuts(make(X_), cuts).collect()}
    for i, x in enumerate(X_):
        want = [sum(x[0] >= c for c in (3.0, 5.5)), 3 if math.isnan(x[1]) else sum(x[1] >= c for c in (1.0, 2.0, 8.0)), 0]
        assert got[i] == want


def test_split_record_adds_up(make):
    r = np.random.default_rng(5)
    X_ = r.integers(0, 20, (80, 2)).astype(float)
    y = np.where(X_[:, 0] > 11, "hi", "lo")
    for row in Z.split_records(make(X_, labels=y.tolist())).collect():
        left = X_[:, row.attr] < row.cut
        assert row.counts1 == {c: int((y[left] == c).sum()) for c in ("hi", "lo")} and row.counts2 == {c: int((y[~left] == c).sum()) for c in ("hi", "lo")}
        assert row.kinds1 == len(set(y[left])) and row.size1 + row.size2 == len(set(X_[:, row.attr]))
        if row.attr == 0:
            assert row.cut == 12.0 and row.lef == 0 and row.entropy1 == 0 == row.entropy2
    binner = Z.EntropyBinner(2).fit(make(X_, labels=y.tolist()))
    assert {tuple(v.features)[0] for v in binner.transform(make(X_)).where("features[0] > 0").collect()} == {1.0}
    with pytest.raises(ValueError):
        Z.EntropyBinner().transform(make(X_))
