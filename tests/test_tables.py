import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecmine.operators import contingency as T
from vecmine.operators import series as R
from vecmine.sources import files as X
from vecmine.sources import generate as Y
from vecmine.functions import vectors as V


@pytest.fixture
def golden(spark):
    """Three by three table with independently computed statistics."""
    rows = [(r, c, n) for r, line in enumerate([[10, 5, 20], [2, 10, 6], [5, 10, 10]]) for c, n in enumerate(line)]
    return spark.createDataFrame(rows, "row_key int, col_key int, n long")


def test_golden_contingency_table(golden):
    near = lambda got, want: abs(got - want) < 1e-8
    chi = T.chi_square(golden).first()
    assert near(chi["chi_square"], 10.520896359) and chi["df"] == 4
    assert near(T.cramers_v(golden).first()[0], 0.259695289)
    c = T.cochran_criterion(golden).first()
    assert c["fulfilled"] and c["few"] == 1 and abs(c["smallest"] - 3.923077) < 1e-6
    e = T.entropies(golden).first()
    assert near(e["over_rows"], 1.533095035) and near(e["over_columns"], 1.520010256)
    assert near(e["given_columns"], 1.431485019) and near(e["given_rows"], 1.418400240)
    assert near(T.cross_entropy_on_rows(golden, golden, 3).first()[0], 1.420971242)
    g = T.gain_ratio(golden).first()
    assert near(g["gain_ratio"], 0.066277702) and near(g["symmetrical_uncertainty"], 0.066561750)
    assert near(T.goodman_kruskal_lambda(golden).first()[0], 0.095238095)
    assert near(T.hypergeometric_log2(golden).first()[0], 15.521521953)


def test_chi_square_p_value(spark, golden):
    rows = golden.select("row_key", "col_key", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("row_key", "col_key")
    got = T.chi_square_test(rows, "row_key", "col_key").first()
    assert abs(got["p_value"] - 0.032510362) < 1e-8 and got["df"] == 4


def test_empty_cells_and_yates(spark):
    table = spark.createDataFrame([("a", "x", 6), ("b", "y", 4), ("c", "z", 0)], "row_key string, col_key string, n long")
    got = T.chi_square(table).first()
    assert abs(got["chi_square"] - 10) < 1e-9 and got["df"] == 1
    n, want = 10, 0.0
    for r, c, x in ((6, 6, 6), (6, 4, 0), (4, 6, 0), (4, 4, 4)):
        e = r * c / n
        want += max(abs(x - e) - 0.5, 0) ** 2 / e
    assert abs(T.chi_square(table, yates=True).first()["chi_square"] - want) < 1e-9


def test_series_numbering_with_one_hot_key(spark):
    rows = [(7 if i % 3 else i, 1000 - i, float(i)) for i in range(300)]
    got = R.build_series(spark.createDataFrame(rows, "k long, ts long, v double"), "k", ["ts"], "v").collect()
    want = {}
    for k, ts, v in sorted(rows):
        want.setdefault(k, []).append(v)
    assert {(r["key"], r["pos"], r["value"]) for r in got} == {(k, i, v) for k, vs in want.items() for i, v in enumerate(vs)}


def test_paa_and_normalisation(spark):
    rows = [(1, i, float(x)) for i, x in enumerate([1, 2, 3, 4, 5, 6, 7])] + [(2, i, 3.0) for i in range(4)] + [(3, 0, 1.0)]
    s = spark.createDataFrame(rows, "key long, pos long, value double")
    got = {(r["key"], r["pos"]): (r["time"], r["value"], r["size"]) for r in R.paa(s, 3).collect()}
    assert got[1, 0] == (0.5, 1.5, 2) and got[1, 1] == (3.0, 4.0, 3) and got[1, 2] == (5.5, 6.5, 2)
    assert (3, 0) not in got
    flat = {(r["key"], r["pos"]): r["value"] for r in R.normalize_series(s).collect()}
    assert flat[2, 1] == 0 and abs(flat[1, 0] - (1 - 4) / (12 / 7)) < 1e-12


def dtw(a, b):
    inf = float("inf")
    t = [[inf] * (len(b) + 1) for _ in range(len(a) + 1)]
    t[0][0] = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = abs(a[i - 1] - b[j - 1]) + min(t[i - 1][j - 1], t[i - 1][j], t[i][j - 1])
    return t[-1][-1]


def test_warping(spark):
    a = [math.sin(i / 3) for i in range(40)]
    b = [math.sin(i / 3 + 0.4) for i in range(34)]
    pairs = spark.createDataFrame([(1, a, 2, b), (1, a, 1, a)], "key_a long, a array<double>, key_b long, b array<double>")
    got = {m: {r["key_b"]: r for r in R.warp_pairs(pairs, m, 5).collect()} for m in ("full", "band", "fast", "similarity")}
    exact = dtw(a, b)
    assert abs(got["full"][2]["distance"] - exact) < 1e-9 and got["full"][1]["distance"] == 0
    assert got["full"][1]["path"] == 40
    assert exact - 1e-9 <= got["band"][2]["distance"]
    assert exact - 1e-9 <= got["fast"][2]["distance"] <= 1.5 * exact
    assert got["similarity"][1]["distance"] == 1


def test_both_walks_and_paths_are_alike():
    rng = np.random.default_rng(5)
    absolute = lambda u, v: np.abs(u - v)
    for _ in range(60):
        n, m = rng.integers(1, 40, 2)
        a, b = rng.integers(0, 4, n).astype(float), rng.integers(0, 4, m).astype(float)
        for low, high in (R._full(n, m), R._band(n, m, int(rng.integers(0, 6)))):
            offsets = np.r_[0, np.cumsum(high - low + 1)]
            one, two = np.zeros(offsets[-1], np.uint8), np.zeros(offsets[-1], np.uint8)
            x, y = R._by_cells(a, b, absolute, low, high, offsets, one), R._by_diagonals(a, b, absolute, low, high, offsets, two)
            assert x == y and (one == two).all()
            i, j = R._path(one, offsets, low, n, m)
            assert x == pytest.approx(np.abs(a[i] - b[j]).sum()) and (i[0], j[0]) == (0, 0)
            assert set(zip(np.diff(i).tolist(), np.diff(j).tolist())) <= {(1, 1), (1, 0), (0, 1)}
        assert R._warp(a, b, absolute, *R._full(n, m))[0] == pytest.approx(dtw(a, b))


def test_long_band_and_empty_series(spark):
    long = np.sin(np.arange(50_000) / 50)
    distance, at, _ = R._warp(long, np.roll(long, 3), lambda u, v: np.abs(u - v), *R._band(50_000, 50_000, 5))
    assert distance < 50 and len(at) >= 50_000
    pairs = spark.createDataFrame([(1, [], 2, [1.0]), (1, None, 3, [1.0]), (4, [1.0], 5, [2.0])], "key_a long, a array<double>, key_b long, b array<double>")
    for method in ("full", "band", "fast", "similarity"):
        got = {r["key_b"]: r for r in R.warp_pairs(pairs, method, 2).collect()}
        assert math.isnan(got[2]["distance"]) and got[2]["path"] == 0 and math.isnan(got[3]["distance"]) and got[5]["path"] == 1


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def features(df):
    return [r["features"] for r in df.orderBy("id").collect()]


def test_sparse_rows_are_parsed_once(spark, tmp_path):
    path = write(tmp_path, "s.tsv", "# none\n2: 7 \tlast\t0:x\n5:1:9\n\tno cells\n")
    got = X.read_sparse(spark, path, class_column=1, default=-1.0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # The map of a row is the argument of a lambda, not part of its body, which runs once for every attribute.
    assert "array(map_from_entries" in plan and "element_at(map_from_entries" not in plan
    rows = got.orderBy("id").collect()
    assert math.isnan(rows[0]["features"][0]) and rows[0]["features"][1:] == [-1.0, 7.0, -1.0, -1.0, -1.0] and rows[0]["label"] == "last"
    assert rows[1]["features"] == [-1.0] * 5 + [1.0] and rows[1]["label"] is None
    assert rows[2]["features"] == [-1.0] * 6 and rows[2]["label"] == "no cells"


def test_readers(spark, tmp_path):
    one = write(tmp_path, "one.csv", "element0,element1,cluster\n1,2,0\n3,x,1\n")
    rows = X.read_clustered_csv(spark, one).orderBy("id").collect()
    assert rows[0]["features"] == [1.0, 2.0] and math.isnan(rows[1]["features"][1]) and rows[1]["prediction"] == 1
    two = write(tmp_path, "two.csv", "element0,cluster\n1,2,foo\n5,1\n6,0\n")
    assert features(X.read_clustered_csv(spark, two, 2)) == [[5.0], [6.0]]
    tab = write(tmp_path, "d.tsv", "# comment\na\t1\t2\n\nb\t3\t?\n")
    got = X.read_delimited(spark, tab, class_column=0).orderBy("id").collect()
    assert [r["label"] for r in got] == ["a", "b"] and math.isnan(got[1]["features"][1])
    sparse = write(tmp_path, "s.tsv", "a\t0:1\t3:2\nb\t1:5\n")
    assert features(X.read_sparse(spark, sparse, class_column=0)) == [[1.0, 0.0, 0.0, 2.0], [0.0, 5.0, 0.0, 0.0]]
    arff = write(tmp_path, "x.arff", "% c\n@relation r\n@attribute a numeric\n@data\n1,2,yes\n3,?,no\n")
    got = X.read_arff(spark, arff, class_column=2).orderBy("id").collect()
    assert [r["label"] for r in got] == ["yes", "no"] and got[0]["features"] == [1.0, 2.0]
    ts = write(tmp_path, "t.csv", "0,1.5,2\n1,2.5,3\n")
    assert [r["values"] for r in X.read_series_csv(spark, ts).orderBy("pos").collect()] == [[1.5, 2.0], [2.5, 3.0]]


def test_vector_json(spark, tmp_path):
    text = ('{"label":0.0,"features":{"type":1,"values":[1.0,2.0]},"prediction":1}\n'
            '{"label":1.0,"features":{"type":0,"size":2,"indices":[1],"values":[4.0]},"prediction":0}\n')
    got = X.read_points_json(spark, write(tmp_path, "v.json", text)).orderBy("label").collect()
    assert [r["features"] for r in got] == [[1.0, 2.0], [0.0, 4.0]]


def test_report_appends(spark, tmp_path):
    out = str(tmp_path / "report")
    row = spark.createDataFrame([("x", 1, 2, 0.5, 0.1)], "type string, n long, k long, silh double, time double")
    X.write_report(row, out, append=False)
    X.write_report(row, out)
    assert spark.read.option("header", True).csv(out).count() == 2


def test_ball_points(spark):
    p = Y.ball_points(spark, 500, 4, 3, 2.0, 100.0).withColumn("norm", V.norm(F.col("features"))).collect()
    assert sum(r["outlier"] for r in p) == 3
    assert all(abs(r["norm"] - 100) < 1e-6 if r["outlier"] else r["norm"] <= 2.0 for r in p)
    again = Y.ball_points(spark, 500, 4, 3, 2.0, 100.0).repartition(9).orderBy("id").collect()
    assert [r["features"] for r in again] == [r["features"] for r in sorted(p, key=lambda r: r["id"])]


def test_sparse_to_dense(spark):
    df = spark.sql("select map(0, 1.0D, 2, 5.0D) as m")
    assert df.select(V.densify(F.col("m"), 4, -1.0)).first()[0] == [1.0, -1.0, 5.0, -1.0]
