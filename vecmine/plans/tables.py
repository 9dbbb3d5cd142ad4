"""Contingency, series and source/sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contingency as T
from ..operators import series as R
from ..operators import silhouette as S
from ..session import scratch_dir
from ..sources import files as X
from ..sources import generate as Y
from ..sources.points import embedding_points, lineitem_points, long_form, table
from ..functions import vectors as V
from .common import EMBL, LI, LIL, r, rounded, sr, su


def order_table(s, d):
    return T.contingency(table(s, d, "orders"), "o_orderpriority", "o_orderstatus")


def item_table(s, d):
    return T.contingency(table(s, d, "lineitem"), "l_returnflag", "l_linestatus")


def cross_entropy(s, d):
    """Flags by status: all line items as training table, those sold after 2000 as test table."""
    late = table(s, d, "lineitem").where(F.col("l_shipdate") >= F.lit("2000-01-01"))
    return T.cross_entropy_on_rows(item_table(s, d), T.contingency(late, "l_returnflag", "l_linestatus"), 2)


def user_series(s, d):
    return R.build_series(table(s, d, "events"), "user_id", ["ts", "event_id"], "value")


def neighbour_pairs(s, d):
    """Every user's series with that of the next user."""
    a = R.series_arrays(R.normalize_series(user_series(s, d)))
    b = a.select((F.col("key") - 1).alias("key_a"), F.col("key").alias("key_b"), F.col("values").alias("b"))
    return a.select(F.col("key").alias("key_a"), F.col("values").alias("a")).join(b, "key_a")


def _warp(method, radius=1):
    return lambda s, d: rounded(R.warp_pairs(neighbour_pairs(s, d), method, radius), "distance")


def clusterize_files(s, d):
    """Points from a CSV, clustered and written as a CSV again: the sizes of the clusters read back."""
    raw, out = scratch_dir(s, "to-cluster"), scratch_dir(s, "clustered")
    X.export_clustering(lineitem_points(s, d), raw, 4)
    X.clusterize(s, raw, out, 4)
    return X.read_clustered_csv(s, out).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


def _totals(points, by):
    """What a file round trip must preserve: rows, cells and attribute totals per group."""
    long = long_form(points, by)
    return long.groupBy(by, "attr").agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), 4).alias("total"))


def import_clustered_csv(s, d):
    raw, out = scratch_dir(s, "clustered-csv"), scratch_dir(s, "imported")
    X.export_clustering(lineitem_points(s, d), raw, 4)
    X.import_clustered_csv(s, raw, out)
    return _totals(s.read.parquet(out), "prediction")


def read_points_json(s, d):
    raw, out = scratch_dir(s, "clustered-csv"), scratch_dir(s, "points-json")
    X.export_clustering(lineitem_points(s, d), raw, 4)
    X.import_clustered_csv(s, raw, out, "json")
    return _totals(X.read_points_json(s, out), "prediction")


def read_two_header_csv(s, d):
    """Every written file starts with the two header lines, then holds its share of the points."""
    out = scratch_dir(s, "two-headers")
    line = F.concat_ws(",", F.array_join(F.transform("features", lambda x: x.cast("string")), ","), F.col("prediction").cast("string"))

    def with_headers(batches):
        import pyarrow as pa

        for i, batch in enumerate(batches):
            if i == 0:
                yield pa.RecordBatch.from_pydict(
                    {"value": ["element0,element1,element2,element3,cluster", "4,3,generated"]}, schema=batch.schema)
            yield batch

    lineitem_points(s, d).select(line.alias("value")).mapInArrow(with_headers, "value string").write.text(out)
    return _totals(X.read_clustered_csv(s, out, skip_header_rows=2), "prediction")


def read_delimited(s, d):
    out = scratch_dir(s, "delimited")
    X.export_points(lineitem_points(s, d), out, gzip=True)
    return _totals(X.read_delimited(s, out, class_column=0), "label")


def read_sparse(s, d):
    out = scratch_dir(s, "sparse")
    X.export_points(lineitem_points(s, d), out, sparse=True)
    return _totals(X.read_sparse(s, out, class_column=0), "label")


def read_arff(s, d):
    out = scratch_dir(s, "arff")
    data = lineitem_points(s, d).select(F.concat_ws(",", F.array_join(F.transform("features", lambda x: x.cast("string")), ","), "label").alias("value"))
    head = s.createDataFrame([("% line items",), ("@relation items",), ("@attribute f0 numeric",), ("@data",)], "value string")
    head.unionByName(data).write.text(out)
    return _totals(X.read_arff(s, out, class_column=4), "label")


def export_points(s, d):
    out = scratch_dir(s, "export")
    X.export_points(lineitem_points(s, d), out, sep=",")
    lines = s.read.text(out)
    return lines.select(F.split("value", ",").alias("c")).groupBy(F.col("c")[0].alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("c")).cast("bigint").alias("cells"))


def export_clustering(s, d):
    out = scratch_dir(s, "clustering")
    X.export_clustering(lineitem_points(s, d), out, 4)
    back = s.read.option("header", True).csv(out, schema="element0 double, element1 double, element2 double, element3 double, cluster bigint")
    return back.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), r(F.sum("element1"), 2).alias("total1"))


def result_report(s, d):
    out = scratch_dir(s, "report")
    summary = S.summarize(S.sq_euclidean_scores(lineitem_points(s, d)))
    X.write_report(S.report("spark", summary, 0.0), out, append=False)
    X.write_report(S.report("spark", summary, 0.0), out, append=True)
    back = s.read.option("header", True).csv(out, schema="type string, n bigint, k bigint, silh double, time double")
    return rounded(back.select("type", "n", "k", "silh"), "silh")


def series_file(s, d):
    out = scratch_dir(s, "series")
    e = table(s, d, "events").select(F.col("event_id").alias("pos"), F.col("event_id").cast("double").alias("time"), F.array("value").alias("values"))
    X.write_series_csv(e, out)
    back = X.read_series_csv(s, out)
    return back.agg(F.count(F.lit(1)).alias("n"), r(F.sum("time"), 2).alias("time"), r(F.sum(F.get("values", 0)), 2).alias("value"))


def generate_ball_points(s, d):
    """As many points as line items, in a ball of the radius of the largest quantity, and four far outliers."""
    info = table(s, d, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("q")).first()
    p = Y.ball_points(s, info["n"], 3, 4, info["q"], 10_000.0).withColumn("norm", V.norm(F.col("features")))
    return p.groupBy("outlier").agg(F.count(F.lit(1)).alias("n"), r(F.max("norm"), 2).alias("farthest"))


def random_points_in_box(s, d):
    n = table(s, d, "lineitem").count()
    p = Y.random_points_in_box(lineitem_points(s, d), n, 4)
    return rounded(p.select("id", *[F.get("features", i).alias(f"f{i}") for i in range(4)]), "f0", "f1", "f2", "f3")


QUERIES = {
    "chi_square": lambda s, d: rounded(T.chi_square(order_table(s, d)), "chi_square"),
    "chi_square_yates": lambda s, d: rounded(T.chi_square(item_table(s, d), yates=True), "chi_square"),
    "chi_square_test": lambda s, d: rounded(T.chi_square_test(table(s, d, "orders"), "o_orderpriority", "o_orderstatus"), "statistic", "p_value"),
    "cochran_criterion": lambda s, d: rounded(T.cochran_criterion(order_table(s, d)), "smallest"),
    "cramers_v": lambda s, d: rounded(T.cramers_v(order_table(s, d)), "cramers_v"),
    "contingency_entropy": lambda s, d: rounded(T.entropies(order_table(s, d)), "over_rows", "over_columns", "given_columns", "given_rows"),
    "contingency_cross_entropy": lambda s, d: rounded(cross_entropy(s, d), "cross_entropy"),
    "contingency_gain_ratio": lambda s, d: rounded(T.gain_ratio(order_table(s, d)), "gain_ratio", "symmetrical_uncertainty", digits=9),
    "goodman_kruskal": lambda s, d: rounded(T.goodman_kruskal_lambda(order_table(s, d)), "lambda"),
    "hypergeometric_log2": lambda s, d: rounded(T.hypergeometric_log2(order_table(s, d)), "neg_log2_p", digits=4),
    "build_series": user_series,
    "series_normalize": lambda s, d: rounded(R.normalize_series(user_series(s, d)), "value"),
    "series_paa": lambda s, d: rounded(R.paa(user_series(s, d), 8), "value"),
    "series_dtw_pairs": _warp("full"),
    "series_dtw_band": _warp("band", 5),
    "series_dtw_fast": _warp("fast", 3),
    "series_dtw_similarity": _warp("similarity"),
    "clusterize_files": clusterize_files,
    "import_clustered_csv": import_clustered_csv,
    "read_points_json": read_points_json,
    "read_two_header_csv": read_two_header_csv,
    "read_delimited": read_delimited,
    "read_sparse": read_sparse,
    "read_arff": read_arff,
    "export_points": export_points,
    "export_clustering": export_clustering,
    "result_report": result_report,
    "series_file": series_file,
    "generate_ball_points": generate_ball_points,
    "random_points_in_box": random_points_in_box,
}


def _ct(src: str, a: str, b: str) -> str:
    return f"""ct AS (SELECT {a} AS r, {b} AS c, count(*)::double AS n FROM {src} GROUP BY ALL), rr AS (SELECT r, sum(n) AS rn, max(n) AS rm FROM ct GROUP BY 1),
    cc AS (SELECT c, sum(n) AS cn FROM ct GROUP BY 1), tt AS (SELECT sum(n) AS t FROM ct),
    ex AS (SELECT rr.r, cc.c, coalesce(ct.n, 0) AS n, rn * cn / t AS e FROM rr CROSS JOIN cc CROSS JOIN tt LEFT JOIN ct ON ct.r = rr.r AND ct.c = cc.c)"""


_O = "WITH " + _ct("orders", "o_orderpriority", "o_orderstatus")
_I = "WITH " + _ct("lineitem", "l_returnflag", "l_linestatus")
_DF = "(SELECT (count(DISTINCT r) - 1) * (count(DISTINCT c) - 1) FROM ct)"
_H = ", h AS (SELECT (SELECT sum(rn * log2(rn)) FROM rr) AS hr, (SELECT sum(cn * log2(cn)) FROM cc) AS hc, (SELECT sum(n * log2(n)) FROM ct) AS hx, t FROM tt)"
_EV = "WITH ev AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value FROM events)"


def _dtw(cost: str, result: str = "t", radius: int | None = None) -> str:
    """Warping of neighbouring users' normalised series: anti-diagonals of all pairs, a row per series position with the cost there
    (t), one diagonal before (tp), and the lengths of the paths (l, lp)."""
    ratio = "(m::double / n)"
    low, high = "0", "m - 1"
    if radius is not None:
        low = f"greatest(0, least(m - 1, floor(i * {ratio}) - {radius}))"
        high = f"CASE WHEN i = n - 1 THEN m - 1 ELSE greatest(greatest(0, least(m - 1, ceil(i * {ratio} + {ratio}) - 1 + {radius})), {low}) END"
    return f"""WITH RECURSIVE {_EV.removeprefix("WITH ")}, mu AS (SELECT *, value - avg(value) OVER (PARTITION BY key) AS v FROM ev),
      de AS (SELECT *, avg(abs(v)) OVER (PARTITION BY key) AS d FROM mu), se AS (SELECT key, list(CASE WHEN d = 0 THEN 0 ELSE v / d END ORDER BY pos) AS a FROM de GROUP BY key),
      pr AS (SELECT x.key AS ka, y.key AS kb, x.a, y.a AS b, len(x.a) AS n, len(y.a) AS m FROM se x JOIN se y ON y.key = x.key + 1),
      rw AS MATERIALIZED (SELECT ka, kb, n, m, i, a[i + 1] AS av, b, {low} AS lo, {high} AS hi FROM (SELECT *, unnest(range(n)) AS i FROM pr)),
      dp AS (SELECT ka, i, 0::bigint AS s, CASE WHEN i = 0 THEN {cost.format(y='b[1]')} ELSE 'inf'::double END AS t, 'inf'::double AS tp, 1 AS l, 1 AS lp FROM rw
        UNION ALL SELECT ka, i, s + 1, CASE WHEN s + 1 - i BETWEEN lo AND hi THEN {cost.format(y='b[s - i + 2]')} + least(dg, up, t) ELSE 'inf'::double END, t,
          1 + CASE WHEN dg <= up AND dg <= t THEN dl WHEN up <= t THEN ul ELSE l END, l
        FROM (SELECT dp.*, coalesce(lag(tp) OVER w, 'inf'::double) AS dg, coalesce(lag(t) OVER w, 'inf'::double) AS up, coalesce(lag(lp) OVER w, 0) AS dl, coalesce(lag(l) OVER w, 0) AS ul
              FROM dp WINDOW w AS (PARTITION BY ka ORDER BY i)) JOIN rw USING (ka, i) WHERE s + 1 <= n + m - 2)
      SELECT ka AS key_a, kb AS key_b, {sr(result)} AS distance, l AS path FROM dp JOIN rw USING (ka, i) WHERE i = n - 1 AND s = n + m - 2"""


def _trip(key: str) -> str:
    return f"WITH {LIL} SELECT {key}, CAST(attr AS INTEGER) AS attr, count(*) AS n, {sr('sum(v)', 4)} AS total FROM lil GROUP BY ALL"


ORACLES = {
    "chi_square": f"{_O} SELECT {sr('sum(pow(n - e, 2) / e)')} AS chi_square, {_DF} AS df FROM ex",
    "chi_square_yates": f"{_I} SELECT CASE WHEN {_DF} = 1 THEN {sr('sum(pow(greatest(abs(n - e) - 0.5, 0), 2) / e)')} ELSE {sr('sum(pow(n - e, 2) / e)')} END AS chi_square, {_DF} AS df FROM ex",
    "cochran_criterion": f"{_O} SELECT {sr('min(e)')} AS smallest, CAST(sum((e < 5)::int) AS BIGINT) AS few, min(e) >= 1 AND sum((e < 5)::int) <= count(*) / 5 AS fulfilled FROM ex",
    "cramers_v": f"{_O} SELECT {sr('sqrt(sum(pow(n - e, 2) / e) / (max(t) * least(count(DISTINCT r) - 1, count(DISTINCT c) - 1)))')} AS cramers_v FROM ex, tt",
    "contingency_entropy": f"{_O}{_H} SELECT {sr('log2(t) - hr / t')} AS over_rows, {sr('log2(t) - hc / t')} AS over_columns, {sr('(hc - hx) / t')} AS given_columns, {sr('(hr - hx) / t')} AS given_rows FROM h",
    "contingency_cross_entropy": f"{_I}, te AS (SELECT l_returnflag AS r, l_linestatus AS c, count(*)::double AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01' GROUP BY ALL) "
                                 f"SELECT {sr('sum(te.n * (log2(rn + 2) - log2(coalesce(ct.n, 0) + 1))) / sum(te.n)')} AS cross_entropy FROM te LEFT JOIN ct ON ct.r = te.r AND ct.c = te.c JOIN rr ON rr.r = te.r",
    "contingency_gain_ratio": f"{_O}{_H}, g AS (SELECT (log2(t) - hc / t) - (hr - hx) / t AS g, log2(t) - hr / t AS a, log2(t) - hc / t AS b FROM h) SELECT {sr('g / a', 9)} AS gain_ratio, {sr('2 * g / (a + b)', 9)} AS symmetrical_uncertainty FROM g",
    "goodman_kruskal": f"{_O} SELECT {sr('((SELECT sum(rm) FROM rr) - (SELECT max(cn) FROM cc)) / (t - (SELECT max(cn) FROM cc))')} AS lambda FROM tt",
    "hypergeometric_log2": f"{_O} SELECT {sr('(lgamma(t + 1) + (SELECT sum(lgamma(n + 1)) FROM ct) - (SELECT sum(lgamma(rn + 1)) FROM rr) - (SELECT sum(lgamma(cn + 1)) FROM cc)) / ln(2)', 4)} AS neg_log2_p FROM tt",
    "build_series": f"{_EV} SELECT key, pos, value FROM ev",
    "series_normalize": f"{_EV}, m AS (SELECT *, avg(value) OVER (PARTITION BY key) AS mu FROM ev), q AS (SELECT *, avg(abs(value - mu)) OVER (PARTITION BY key) AS mad FROM m) SELECT key, pos, {sr('CASE WHEN mad = 0 THEN 0 ELSE (value - mu) / mad END')} AS value FROM q",
    "series_paa": f"""{_EV}, n AS (SELECT key, count(*)::double AS n FROM ev GROUP BY 1), b AS (SELECT key, p, CAST(floor(n / 8.0::double * p + 0.5) AS INTEGER) AS a, CAST(floor(n / 8.0::double * (p + 1) + 0.5) AS INTEGER) AS z FROM n, range(8) t(p) WHERE n >= 8)
      SELECT b.key, p AS pos, (a + z - 1) / 2.0::double AS time, {sr('avg(value)')} AS value, count(*) AS size FROM b JOIN ev ON ev.key = b.key AND ev.pos >= a AND ev.pos < z GROUP BY b.key, p, a, z""",
    "series_dtw_pairs": _dtw("abs(av - {y})"),
    "series_dtw_band": _dtw("abs(av - {y})", radius=5),
    "series_dtw_similarity": _dtw("pow(av - {y}, 2)", "1 - (sqrt(t) / l) / (1 + sqrt(t) / l)"),
    "import_clustered_csv": _trip("c AS prediction"),
    "read_points_json": _trip("c AS prediction"),
    "read_two_header_csv": _trip("c AS prediction"),
    "read_delimited": _trip("label"),
    "read_sparse": _trip("label"),
    "read_arff": _trip("label"),
    "export_points": f"WITH {LI} SELECT label, count(*) AS n, 5::bigint AS cells FROM li GROUP BY 1",
    "export_clustering": f"WITH {LI} SELECT c AS cluster, count(*) AS n, {sr('sum(f1)', 2)} AS total1 FROM li GROUP BY 1",
    "series_file": f"SELECT count(*) AS n, {sr('sum(event_id)', 2)} AS time, {sr('sum(value)', 2)} AS value FROM events",
    "generate_ball_points": "SELECT false AS outlier, count(*) AS n, round(max(l_quantity), 2) AS farthest FROM lineitem UNION ALL SELECT true, 4, 10000.0",
    "random_points_in_box": f"""WITH {LI}, ids AS (SELECT range AS id FROM range((SELECT count(*) FROM li))), b AS (SELECT {', '.join(f'min(f{i}) AS l{i}, max(f{i}) AS h{i}' for i in range(4))} FROM li)
      SELECT id, {', '.join(sr(f"l{i} + {su('id', f'1:uni:{i}')} * (h{i} - l{i})") + f' AS f{i}' for i in range(4))} FROM ids, b""",
}
from .silhouettes import ORACLES as _SIL  # noqa: E402

ORACLES["result_report"] = (_SIL["silhouette_sq_euclidean"].replace("SELECT count(*) AS n, count(DISTINCT c) AS k", "SELECT unnest(['spark', 'spark']) AS type, * FROM (SELECT count(*) AS n, count(DISTINCT c) AS k") + ")")
