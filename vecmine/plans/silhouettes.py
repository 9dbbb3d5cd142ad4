"""Silhouette, sampling and index queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import indices as I
from ..operators import sampling as P
from ..operators import silhouette as S
from ..operators.centroids import centroids
from ..session import cut_lineage
from ..sources.points import embedding_points, lineitem_points
from .common import CENT, EMB, EMBL, LI, LIL, SZ, r, rounded, sr, su

T_EMB, T_LI = 16, 64


def _scores(df):
    return rounded(df.select("id", "prediction", "a", "b", "s"), "a", "b", "s")


def _summary(scores):
    return rounded(S.summarize(scores), "silh")


def coarse(points):
    """A second and third clustering of the embeddings, by merging classes."""
    return {0: points, 1: points.withColumn("prediction", (F.col("prediction") / 2).cast("bigint")),
            2: points.withColumn("prediction", (F.col("prediction") / 5).cast("bigint"))}


def best_clustering(s, d):
    points = embedding_points(s, d)
    scores = None
    for conf, p in coarse(points).items():
        one = S.summarize(S.exact_scores(p)).select(F.lit(conf).alias("conf"), "k", "silh")
        scores = one if scores is None else scores.unionByName(one)
    return rounded(S.rank_configurations(scores), "silh")


def pps_probabilities(s, d):
    p = P.pps_probabilities(embedding_points(s, d), T_EMB)
    return p.select("id", "prediction", r("gamma", 10).alias("gamma"), r("pi", 8).alias("pi"))


def pps_sample(s, d):
    return P.pps_sample(embedding_points(s, d), T_EMB).select("id", "prediction", r("pi", 8).alias("pi"))


def silhouette_pps(s, d):
    return S.pps_silhouette(lineitem_points(s, d), T_LI).select("n", r("silh").alias("silh"))


def silhouette_uniform(s, d):
    return S.uniform_silhouette(lineitem_points(s, d), T_LI).select("n", r("silh").alias("silh"))


def silhouette_estimate(s, d):
    points = embedding_points(s, d)
    sample = P.uniform_sample(points, T_EMB)
    return _scores(S.estimate_scores(points, sample))


def uniform_sample(s, d):
    return P.uniform_sample(lineitem_points(s, d), 2000).select("id", "prediction", r("pi", 8).alias("pi"))


def sampling_report(s, d):
    p = P.pps_probabilities(lineitem_points(s, d), T_LI)
    return P.sampling_report(p).select("prediction", "n", r("expected").alias("expected"), "realised")


def sampling_report_settings(s, d):
    """The report of a run with its settings."""
    p = P.pps_probabilities(lineitem_points(s, d), T_LI, 0.1)
    return rounded(P.sampling_report(p, t=T_LI, eps=0.1, delta=0.1).drop("run"), "expected")


def uniform_report(s, d):
    return rounded(P.uniform_report(lineitem_points(s, d), T_LI, seeds=(1, 2)), "expected")


def silhouette_exact_many(s, d):
    """Three clusterings of the embeddings at once: the labels, ids by parity and size of a coordinate."""
    p = embedding_points(s, d).withColumn("labels", F.array(F.col("prediction"), F.col("id") % 3, (F.get("features", 0) > 0).cast("long")))
    return rounded(S.exact_scores_many(p).groupBy("conf").agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("silh")), "silh")


def silhouette_error_study(s, d):
    study = S.error_study(coarse(embedding_points(s, d)), t=T_EMB, runs=100)
    return rounded(S.error_summary(study), "max_error", "avg_error", "var_error", "share_correct")


def silhouette_method_comparison(s, d):
    return rounded(S.method_comparison(coarse(embedding_points(s, d)), t=T_EMB, runs=100), "score", "error")


def silhouette_report(s, d):
    import time

    start = time.time()
    summary = cut_lineage(S.summarize(S.simplified_scores(lineitem_points(s, d))))
    return S.report("simplified", summary, time.time() - start)


def cluster_centroids(s, d):
    c = centroids(lineitem_points(s, d)).select("prediction", "n", F.posexplode("centroid").alias("attr", "value"))
    return rounded(c, "value")


QUERIES = {
    "silhouette_exact": lambda s, d: _summary(S.exact_scores(embedding_points(s, d))),
    "silhouette_exact_per_point": lambda s, d: _scores(S.exact_scores(embedding_points(s, d))),
    "silhouette_exact_many": silhouette_exact_many,
    "sampling_report_settings": sampling_report_settings,
    "uniform_report": uniform_report,
    "silhouette_by_cluster": lambda s, d: rounded(S.by_cluster(S.exact_scores(embedding_points(s, d))), "avg_s", "min_s", "max_s"),
    "pps_probabilities": pps_probabilities,
    "pps_sample": pps_sample,
    "silhouette_pps": silhouette_pps,
    "uniform_sample": uniform_sample,
    "silhouette_estimate": silhouette_estimate,
    "silhouette_uniform": silhouette_uniform,
    "silhouette_sample_size": lambda s, d: S.sample_size_table(lineitem_points(s, d)),
    "silhouette_simplified": lambda s, d: _summary(S.simplified_scores(embedding_points(s, d))),
    "silhouette_simplified_centroid": lambda s, d: _summary(S.simplified_centroid_scores(embedding_points(s, d))),
    "silhouette_frahling_sohler": lambda s, d: _summary(S.frahling_sohler_scores(embedding_points(s, d))),
    "silhouette_sq_euclidean": lambda s, d: _summary(S.sq_euclidean_scores(lineitem_points(s, d))),
    "best_clustering": best_clustering,
    "silhouette_error_study": silhouette_error_study,
    "silhouette_method_comparison": silhouette_method_comparison,
    "sampling_report": sampling_report,
    "silhouette_report": silhouette_report,
    "cluster_centroids": cluster_centroids,
    "kmeans_cost": lambda s, d: rounded(I.kmeans_cost(embedding_points(s, d)), "cost"),
}
for _name, _fn in I.INDICES.items():
    QUERIES[f"idx_{_name}"] = (lambda fn: lambda s, d: rounded(fn(embedding_points(s, d)), "score"))(_fn)


def _points_sql(pairs: str, dist: str = "list_distance(a.f, b.f)") -> str:
    return f"""pr AS (SELECT a.id, a.c, b.c AS oc, sum({dist}) AS tot FROM {pairs} GROUP BY ALL),
    pt AS (SELECT pr.id, pr.c, sum(CASE WHEN oc = pr.c AND sz.n > 1 THEN tot / (sz.n - 1) ELSE 0 END) AS a,
      min(CASE WHEN oc <> pr.c THEN tot / sz.n END) AS b FROM pr JOIN sz ON sz.c = pr.oc GROUP BY 1, 2),
    sc AS (SELECT id, c, a, b, coalesce((b - a) / nullif(greatest(a, b), 0), 0) AS s FROM pt)"""


EXACT = f"WITH {EMB}, {SZ}, {_points_sql('emb a, emb b')}"
SUMMARY = f"SELECT count(*) AS n, count(DISTINCT c) AS k, {sr('avg(s)')} AS silh FROM sc"


def _exact_of(conf: int, expr: str) -> str:
    e = EMB.replace("CAST(label AS BIGINT) AS c", f"CAST({expr} AS BIGINT) AS c")
    return f"(WITH {e}, {SZ}, {_points_sql('emb a, emb b')} SELECT {conf} AS conf, count(DISTINCT c) AS k, avg(s) AS silh FROM sc)"


# Initial sample size: ceil(log2(2k / 0.1)) with k clusters.
def _pps_sql(base: str, dist: str, t: int) -> str:
    return f"""WITH {base}, sz AS (SELECT c, count(*) AS n FROM p GROUP BY c), kk AS (SELECT ceil(log2(2 * count(*) / 0.1)) AS m FROM sz),
    s0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY {su('id', '1:s0')}, id) AS rn FROM p) WHERE rn <= (SELECT m FROM kk)),
    w AS (SELECT b.id AS sid, sum({dist}) AS w FROM p a JOIN s0 b ON a.c = b.c GROUP BY 1),
    g AS (SELECT a.id, a.c, greatest(max({dist} / w.w), 1.0 / max(sz.n)) AS gamma, max(sz.n) AS n
      FROM p a JOIN s0 b ON a.c = b.c JOIN w ON w.sid = b.id JOIN sz ON sz.c = a.c GROUP BY 1, 2),
    q AS (SELECT id, c, n, gamma, CASE WHEN n <= {t} THEN 1.0 ELSE least(1.0, {t} * gamma) END AS pi, {su('id', '1:pps')} AS u FROM g)"""


_P_EMB = EMB + ", p AS (SELECT * FROM emb)"
_P_LI = LI + ", p AS (SELECT id, c, [f0, f1, f2, f3] AS f FROM li)"
_D = "list_distance(a.f, b.f)"


def _estimate_sql(sample: str) -> str:
    return f"""sm AS ({sample}), pr AS (SELECT a.id, a.c, b.c AS oc, sum({_D} / b.pi) AS tot FROM p a, sm b GROUP BY ALL),
    pt AS (SELECT pr.id, pr.c, sum(CASE WHEN oc = pr.c THEN tot / (sz.n - 1) ELSE 0 END) AS a,
      min(CASE WHEN oc <> pr.c THEN tot / sz.n END) AS b FROM pr JOIN sz ON sz.c = pr.oc GROUP BY 1, 2),
    sc AS (SELECT id, c, a, b, coalesce((b - a) / nullif(greatest(a, b), 0), 0) AS s FROM pt)"""


def _uniform_sql(base: str, t: int) -> str:
    return f"""WITH {base}, sz AS (SELECT c, count(*) AS n FROM p GROUP BY c),
    un AS (SELECT p.*, least(1.0, {t}.0::double / n) AS pi FROM p JOIN sz USING (c) WHERE {su('id', '1:uni')} < least(1.0, {t}.0::double / n))"""


_ROWS = f"SELECT id, c AS prediction, {sr('a')} AS a, {sr('b')} AS b, {sr('s')} AS s FROM sc"
_COS = "greatest(list_cosine_similarity(a.f, b.f), 0.0)"
_WITHIN = f"WITH {EMB}, {SZ}, pw AS (SELECT a.c AS ca, b.c AS cb, {_D} AS d FROM emb a JOIN emb b ON a.id < b.id)"
_STAT = (_WITHIN + ", st AS (SELECT sum((ca = cb)::int)::double AS fw, sum((ca <> cb)::int)::double AS fb, "
         "sum(CASE WHEN ca = cb THEN d END) AS dw, sum(CASE WHEN ca <> cb THEN d END) AS db, "
         "min(CASE WHEN ca = cb THEN d END) AS lo, max(CASE WHEN ca = cb THEN d END) AS hi FROM pw)")
_CNT = (_STAT + ", ct AS (SELECT sum((d < hi)::int)::double AS below, sum((d > hi)::int)::double AS above FROM pw, st WHERE ca <> cb)")
_TAU = (_STAT + ", mx AS (SELECT ca AS c, max(d) AS m FROM pw WHERE ca = cb GROUP BY 1), "
        "ct AS (SELECT sum((d < m)::int)::double AS below, sum((d > m)::int)::double AS above FROM pw JOIN mx ON mx.c = least(ca, cb) WHERE ca <> cb)")
_TRACE = f"WITH {EMBL}, {CENT}, {SZ}, gl AS (SELECT list(v ORDER BY attr) AS g FROM (SELECT attr, avg(v) AS v FROM embl GROUP BY attr))"
_Q4 = "(SELECT sum(n * greatest(list_cosine_similarity(m, g), 0.0)) FROM cent JOIN sz USING (c), gl)"
_Q3 = "(SELECT sum(greatest(list_cosine_similarity(f, m), 0.0)) FROM emb JOIN cent USING (c))"
_Q2 = f"(SELECT sum(t / n) FROM (SELECT a.c, sum({_COS}) AS t FROM emb a JOIN emb b ON a.c = b.c GROUP BY 1) JOIN sz USING (c))"
_LIK = f"""WITH {EMBL}, pc AS (SELECT c, count(*)::double AS n, count(DISTINCT attr) AS d, count(DISTINCT id) AS nr, sum(v) AS s, sum(v * v) AS s2 FROM embl GROUP BY c),
    ll AS (SELECT nr, d * (-0.5 * n * ln(2 * pi()) + 0.5 * ln(0.1) + 0.1 * ln(0.1) - lgamma(0.1) + lgamma(0.1 + 0.5 * n)
      - (0.1 + 0.5 * n) * ln(0.1 + 0.5 * (s2 - s * s / n) + 0.1 * s * s / (2 * (0.1 + n) * n)) - 0.5 * ln(0.1 + n)) AS l FROM pc)"""
_CENTP = f"WITH {EMBL}, {CENT}, {SZ}"
_SQ = """WITH {li}, lil AS (SELECT id, c, unnest([0, 1, 2, 3]) AS attr, unnest([f0, f1, f2, f3]) AS v FROM li),
    sz AS (SELECT c, count(*)::double AS n FROM li GROUP BY c),
    mu AS (SELECT c, list(v ORDER BY attr) AS m FROM (SELECT c, attr, avg(v) AS v FROM lil GROUP BY ALL) GROUP BY c),
    pv AS (SELECT c, sum(vv) AS var FROM (SELECT c, attr, var_pop(v) AS vv FROM lil GROUP BY ALL) GROUP BY c),
    pr AS (SELECT a.id, a.c, mu.c AS oc, pow(list_distance([f0, f1, f2, f3], m), 2) + var AS md, n FROM li a, mu JOIN pv USING (c) JOIN sz USING (c)),
    pt AS (SELECT id, c, max(CASE WHEN oc = c THEN md * n / (n - 1) END) AS a, min(CASE WHEN oc <> c THEN md END) AS b FROM pr GROUP BY 1, 2),
    sc AS (SELECT id, c, coalesce((b - a) / nullif(greatest(a, b), 0), 0) AS s FROM pt)"""

_MANY = f"""WITH {EMB}, em AS (SELECT id, f, unnest([0, 1, 2])::int AS conf, unnest([c, id % 3, (f[1] > 0)::bigint]) AS c FROM emb),
    sz AS (SELECT conf, c, count(*)::double AS n FROM em GROUP BY ALL), pd AS (SELECT a.id, b.id AS nb, list_distance(a.f, b.f) AS d FROM emb a JOIN emb b ON a.id <> b.id),
    pr AS (SELECT x.conf, x.id, x.c, y.c AS oc, sum(d) AS t FROM pd JOIN em x USING (id) JOIN em y ON y.id = pd.nb AND y.conf = x.conf GROUP BY ALL),
    pt AS (SELECT pr.conf, id, pr.c, coalesce(sum(CASE WHEN oc = pr.c THEN t / nullif(n - 1, 0) END), 0) AS a, min(CASE WHEN oc <> pr.c THEN t / n END) AS b
      FROM pr JOIN sz ON sz.conf = pr.conf AND sz.c = oc GROUP BY ALL)
    SELECT conf, count(*) AS n, {sr('avg((b - a) / greatest(a, b))')} AS silh FROM pt GROUP BY conf"""

ORACLES = {
    "silhouette_exact_many": _MANY,
    "sampling_report_settings": f"{_pps_sql(_P_LI, _D, T_LI)} SELECT c AS prediction, count(*) AS n, {sr('sum(pi)')} AS expected, "
                                f"CAST(sum((u < pi)::int) AS BIGINT) AS realised, {T_LI} AS t, 0.1::double AS eps, 0.1::double AS delta FROM q GROUP BY c",
    "uniform_report": " UNION ALL ".join(
        f"""SELECT {run}::int AS run, c AS prediction, count(*) AS n, {sr('sum(pi)')} AS expected, sum((u < pi)::int)::bigint AS realised, {T_LI} AS t FROM (
          SELECT c, {su('id', f'{run + 1}:uni')} AS u, least(1.0, {T_LI}.0::double / count(*) OVER (PARTITION BY c)) AS pi FROM (WITH {LI} SELECT * FROM li)) GROUP BY c""" for run in (0, 1)),
    "silhouette_exact": f"{EXACT} {SUMMARY}",
    "silhouette_exact_per_point": f"{EXACT} {_ROWS}",
    "silhouette_by_cluster": f"{EXACT} SELECT c AS prediction, count(*) AS n, {sr('avg(s)')} AS avg_s, {sr('min(s)')} AS min_s, {sr('max(s)')} AS max_s FROM sc GROUP BY c",
    "pps_probabilities": f"{_pps_sql(_P_EMB, _D, T_EMB)} SELECT id, c AS prediction, {sr('gamma', 10)} AS gamma, {sr('pi', 8)} AS pi FROM q",
    "pps_sample": f"{_pps_sql(_P_EMB, _D, T_EMB)} SELECT id, c AS prediction, {sr('pi', 8)} AS pi FROM q WHERE u < pi",
    "silhouette_pps": f"{_pps_sql(_P_LI, _D, T_LI)}, {_estimate_sql('SELECT p.*, q.pi FROM p JOIN q USING (id) WHERE q.u < q.pi')} SELECT count(*) AS n, {sr('avg(s)')} AS silh FROM sc",
    "uniform_sample": f"{_uniform_sql(_P_LI, 2000)} SELECT id, c AS prediction, {sr('pi', 8)} AS pi FROM un",
    "silhouette_estimate": f"{_uniform_sql(_P_EMB, T_EMB)}, {_estimate_sql('SELECT * FROM un')} {_ROWS}",
    "silhouette_uniform": f"{_uniform_sql(_P_LI, T_LI)}, {_estimate_sql('SELECT * FROM un')} SELECT count(*) AS n, {sr('avg(s)')} AS silh FROM sc",
    "silhouette_sample_size": f"WITH {LI} SELECT count(*) AS n, count(DISTINCT c) AS k, CAST(ceil((ln(4) + ln(count(*)) + ln(count(DISTINCT c)) - ln(0.1)) / (2 * 0.1 * 0.1)) AS BIGINT) AS t FROM li",
    "silhouette_simplified": f"""{_CENTP}, rep AS (SELECT c AS rc, f AS rf FROM (SELECT emb.*, row_number() OVER (PARTITION BY c ORDER BY list_distance(f, m), id) AS rn FROM emb JOIN cent USING (c)) WHERE rn = 1),
      pt AS (SELECT id, c, max(CASE WHEN rc = c THEN list_distance(f, rf) END) AS a, min(CASE WHEN rc <> c THEN list_distance(f, rf) END) AS b FROM emb, rep GROUP BY 1, 2),
      sc AS (SELECT id, c, coalesce((b - a) / nullif(greatest(a, b), 0), 0) AS s FROM pt) {SUMMARY}""",
    "silhouette_simplified_centroid": f"""{_CENTP}, ce AS (SELECT cent.c AS rc, m, n FROM cent JOIN sz USING (c)),
      pt AS (SELECT id, c, max(CASE WHEN rc = c THEN pow(list_distance(f, m), 2) / nullif(n - 1, 0) END) AS a, min(CASE WHEN rc <> c THEN pow(list_distance(f, m), 2) / n END) AS b FROM emb, ce GROUP BY 1, 2),
      sc AS (SELECT id, c, coalesce((b - coalesce(a, 0)) / nullif(greatest(coalesce(a, 0), b), 0), 0) AS s FROM pt) {SUMMARY}""",
    "silhouette_frahling_sohler": f"""{_CENTP}, nb AS (SELECT id, emb.c, arg_min(cent.c, list_distance(f, m)) AS nc FROM emb, cent WHERE emb.c <> cent.c GROUP BY 1, 2),
      pr AS (SELECT a.id, a.c, nb.nc, sum(CASE WHEN b.c = a.c THEN {_D} ELSE 0 END) AS own, sum(CASE WHEN b.c = nb.nc THEN {_D} ELSE 0 END) AS near
        FROM emb a JOIN nb ON nb.id = a.id, emb b WHERE b.c = a.c OR b.c = nb.nc GROUP BY ALL),
      pt AS (SELECT id, pr.c, coalesce(own / nullif(s1.n - 1, 0), 0) AS a, near / s2.n AS b FROM pr JOIN sz s1 ON s1.c = pr.c JOIN sz s2 ON s2.c = pr.nc),
      sc AS (SELECT id, c, coalesce((b - a) / nullif(greatest(a, b), 0), 0) AS s FROM pt) {SUMMARY}""",
    "silhouette_sq_euclidean": f"{_SQ.format(li=LI)} {SUMMARY}",
    "best_clustering": f"WITH u AS ({_exact_of(0, 'label')} UNION ALL {_exact_of(1, 'floor(label / 2)')} UNION ALL {_exact_of(2, 'floor(label / 5)')}) "
                       f"SELECT CAST(conf AS INTEGER) AS conf, k, {sr('silh')} AS silh, conf = (SELECT conf FROM u ORDER BY silh DESC, conf LIMIT 1) AS best FROM u",
    "sampling_report": f"{_pps_sql(_P_LI, _D, T_LI)} SELECT c AS prediction, count(*) AS n, {sr('sum(pi)')} AS expected, CAST(sum((u < pi)::int) AS BIGINT) AS realised FROM q GROUP BY c",
    "cluster_centroids": f"WITH {LIL} SELECT c AS prediction, count(*) AS n, attr, {sr('avg(v)')} AS value FROM lil GROUP BY c, attr",
    "kmeans_cost": f"{_CENTP} SELECT {sr('sum(pow(list_distance(f, m), 2))')} AS cost FROM emb JOIN cent USING (c)",
    "idx_sse": f"WITH {EMB}, {SZ} SELECT {sr('sum(t / n)')} AS score FROM (SELECT a.c, sum(pow({_D}, 2)) AS t FROM emb a JOIN emb b ON a.c = b.c GROUP BY 1) JOIN sz USING (c)",
    "idx_avg_pairwise_sim": f"WITH {EMB}, {SZ} SELECT {sr(_Q2)} AS score",
    "idx_centroid_sim": f"{_TRACE} SELECT {sr(_Q3)} AS score",
    "idx_trace_scatter": f"{_TRACE} SELECT {sr(_Q4)} AS score",
    "idx_hybrid_centroid": f"{_TRACE} SELECT {sr(f'{_Q3} / {_Q4}')} AS score",
    "idx_hybrid_pairwise": f"{_TRACE} SELECT {sr(f'{_Q2} / {_Q4}')} AS score",
    "idx_minmaxcut": f"WITH {EMB} SELECT {sr('sum(top / within)')} AS score FROM (SELECT a.c, sum({_D}) AS top, sum(CASE WHEN a.c = b.c THEN {_D} END) AS within FROM emb a, emb b GROUP BY 1)",
    "idx_c_index": f"{_STAT} SELECT {sr('(dw - lo) / (hi - lo)')} AS score FROM st",
    "idx_gamma": f"{_CNT} SELECT {sr('(above - below) / (above + below)')} AS score FROM ct",
    "idx_gplus": f"{_CNT} SELECT {sr('2 * below / ((fw + fb) * (fw + fb - 1))')} AS score FROM ct, st",
    "idx_tau": f"{_TAU} SELECT {sr('(above - below) / sqrt(((fw + fb) * (fw + fb - 1) / 2 - (fw + 2 * fb)) * ((fw + fb) * (fw + fb - 1) / 2))')} AS score FROM ct, st",
    "idx_wb": f"{_STAT} SELECT {sr('(dw / fw) / (db / fb)')} AS score FROM st",
    "idx_point_biserial": f"{_STAT}, sd AS (SELECT sqrt(sum(pow(d - CASE WHEN ca = cb THEN dw / fw ELSE db / fb END, 2)) / max(fw + fb)) AS sd FROM pw, st) "
                          f"SELECT {sr('(db / fb - dw / fw) * sqrt(fw * fb / ((fw + fb) * (fw + fb))) / sd')} AS score FROM st, sd",
    "idx_aic": f"{_LIK} SELECT {sr('-2 * sum(l) + 2', 4)} AS score FROM ll",
    "idx_bic": f"{_LIK} SELECT {sr('-2 * sum(l) + log10(sum(nr))', 4)} AS score FROM ll",
}
for _name in ("aic", "bic"):
    QUERIES[f"idx_{_name}"] = (lambda fn: lambda s, d: rounded(fn(embedding_points(s, d)), "score", digits=4))(I.INDICES[_name])
