"""Neighbour, clustering, classification and feature queries."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..operators import classify as K
from ..operators import clustering as C
from ..operators import features as E
from ..operators import graph as G
from ..operators import neighbours as N
from ..operators.centroids import Representatives, assign_nearest, centroids, dims_of
from ..operators.filters import retain_attributes
from ..operators.sampling import kfold_split
from ..sources.points import embedding_points, lineitem_points
from .common import CENT, EMB, EMBL, LI, LIL, SZ, r, rounded, sr, su

EPS, MIN_POINTS, SIM = 1.1, 3, 0.25


def label_centres(points):
    return centroids(points).select(F.col("prediction").alias("id"), F.col("centroid").alias("features"))


def discrete(s, d):
    """Line items on their three attributes with few distinct values."""
    return retain_attributes(lineitem_points(s, d), [0, 2, 3]).drop("prediction")


def status_points(s, d):
    """Line items labelled by whether they are expensive, for the two-class models."""
    p = lineitem_points(s, d)
    return p.withColumn("label", F.when(F.get("features", 1) > 50000, "high").otherwise("low")).withColumn(
        "features", F.transform("features", lambda x, i: F.when(i == 1, x / 100000).when(i == 0, x / 50).otherwise(x)))


def assign(s, d):
    p = embedding_points(s, d)
    got = assign_nearest(p, Representatives(label_centres(p), dims_of(p)))
    return got.select("id", "prediction", r("distance").alias("distance"))


def kmeans_step(s, d):
    p = embedding_points(s, d)
    out = C.kmeans_step(p, label_centres(p)).select("prediction", "n", F.posexplode("centroid").alias("attr", "value"))
    return rounded(out, "value")


def first_medoids(p):
    return p.groupBy(F.col("prediction").alias("c")).agg(F.min_by("features", "id").alias("features")).select(
        F.col("c").alias("id"), "features")


def kmedoids_step(s, d):
    p = embedding_points(s, d)
    return C.kmedoids_step(p, first_medoids(p)).select(F.col("id").alias("prediction"), "point")


def mcl_matrix(s, d):
    p = embedding_points(s, d)
    return G.transition_matrix(C.similarity_edges(p, SIM), p, once=True)


def som_weights() -> np.ndarray:
    """Fixed 2 x 2 map over 64 attributes, reproducible in SQL."""
    return np.array([[((g + 1) * (a + 1)) % 7 / 20.0 - 0.15 for a in range(64)] for g in range(4)])


def _select_k(result, s):
    key, _, scores = result
    shown = [(*map(int, row[:-1]), math.floor(row[-1] * 1e6 + 0.5) / 1e6, tuple(row[:-1]) == key) for row in scores]
    return s.createDataFrame(shown,
                             ", ".join(f"{n} int" for n in ("k", "repeat")[:len(key)]) + ", score double, best boolean")


def clusterize(s, d):
    p = retain_attributes(lineitem_points(s, d), [0, 2, 3])
    return C.kmeans(p, 3).select("id", "prediction")


def knn_votes(s, d):
    p = embedding_points(s, d)
    return rounded(K.knn_classify(p, p, 5, same=True), "votes")


def nearest_mean(s, d):
    p = lineitem_points(s, d)
    return K.nearest_mean(p, p).select("id", "label", "predicted")


def feature_voting(s, d):
    p = lineitem_points(s, d)
    return K.feature_voting(p, p).select("id", "predicted", "share")


def naive_bayes(s, d):
    p = discrete(s, d)
    return rounded(K.naive_bayes(p, p), "probability")


def kdb(s, d):
    p = discrete(s, d)
    return rounded(K.dependent_bayes(p, p, k=1), "score", "percentage")


def _split(p):
    folds = kfold_split(p, 4)
    return folds.where("fold > 0").drop("fold"), folds.where("fold = 0").drop("fold")


def _ml(fn, points=embedding_points):
    def query(s, d):
        train, test = _split(points(s, d))
        return fn(train, test).select("id", "label", "predicted")
    return query


def bagging(s, d):
    p = lineitem_points(s, d)
    return rounded(K.bagged_nearest_mean(p, p, bags=5), "share")


def confusion(s, d):
    return K.confusion_counts(nearest_mean(s, d))


MEASURES = ["tp_rate", "tn_rate", "fn_rate", "fp_rate", "error_rate", "accuracy", "recall", "precision", "f_measure",
            "correlation_coefficient", "correlation", "cost", "q9", "bcr"]

QUERIES = {
    "knn_join": lambda s, d: rounded(N.knn_join(embedding_points(s, d), 3), "score"),
    "range_join": lambda s, d: rounded(N.range_join(embedding_points(s, d), EPS), "distance"),
    "assign_nearest": assign,
    "box_range": lambda s, d: N.box_range(lineitem_points(s, d), [10, 20000, 0.02, 0.01], [40, 60000, 0.08, 0.06]).select("id", "label"),
    "kmeans": lambda s, d: C.kmeans(lineitem_points(s, d), 4).groupBy("prediction").agg(F.count(F.lit(1)).alias("n")),
    "kmeans_step": kmeans_step,
    "kmedoids": lambda s, d: C.kmedoids(embedding_points(s, d), 4).select("id", "prediction"),
    "kmedoids_step": kmedoids_step,
    "farthest_first": lambda s, d: C.farthest_first(embedding_points(s, d), 4, first=0).select("id", "prediction"),
    "farthest_first_select_k": lambda s, d: _select_k(C.farthest_first_select_k(embedding_points(s, d), 2, 5, first=0), s),
    "kmeans_select_k": lambda s, d: _select_k(C.kmeans_select_k(embedding_points(s, d)), s),
    "kmeans_best_of": lambda s, d: _select_k(C.kmeans_select_k(embedding_points(s, d), 3, 3, repeats=3), s),
    "dbscan": lambda s, d: C.dbscan(embedding_points(s, d), EPS, MIN_POINTS, normalize=False).select("id", "prediction"),
    "dbscan_core_points": lambda s, d: C.core_points(embedding_points(s, d), EPS, MIN_POINTS),
    "mcl": lambda s, d: G.mcl(mcl_matrix(s, d)),
    "mcl_expand_inflate_step": lambda s, d: rounded(G.expand_inflate(mcl_matrix(s, d)), "w"),
    "som_batch": lambda s, d: C.som(lineitem_points(s, d)).select("id", "prediction"),
    "som_assign": lambda s, d: C.som_assign(embedding_points(s, d), som_weights()).select("id", "prediction"),
    "clusterize": clusterize,
    "clf_zero_r": lambda s, d: K.class_counts(lineitem_points(s, d)),
    "clf_knn": knn_votes,
    "clf_nearest_mean": nearest_mean,
    "clf_feature_voting": feature_voting,
    "clf_naive_bayes": naive_bayes,
    "feature_mutual_information": lambda s, d: rounded(K.mutual_information(discrete(s, d)), "mi", digits=9),
    "feature_conditional_mi": lambda s, d: rounded(K.conditional_mutual_information(discrete(s, d)), "cmi"),
    "clf_kdb": kdb,
    "clf_tree_gini": _ml(K.tree, lineitem_points),
    "clf_random_forest_gini": _ml(K.random_forest, lineitem_points),
    "bagging_nearest_mean": bagging,
    "oob_error": lambda s, d: rounded(K.out_of_bag_error(lineitem_points(s, d), bags=5), "error"),
    "clf_som": _ml(lambda a, b: K.som_classify(a, b), lineitem_points),
    "clf_linear_svm": _ml(K.linear_svm, status_points),
    "svm_grid_search": lambda s, d: K.svm_grid_search(status_points(s, d), iterations=5),
    "cv_nearest_mean": lambda s, d: K.cross_validate_nearest_mean(lineitem_points(s, d), 10),
    "confusion_counts": confusion,
    "classification_measures": lambda s, d: rounded(K.measures(confusion(s, d)).select("label", *MEASURES), *MEASURES),
    "score_gain_ratio": lambda s, d: rounded(E.gain_ratio(lineitem_points(s, d)), "score", digits=9),
    "score_symmetrical_uncertainty": lambda s, d: rounded(E.symmetrical_uncertainty(lineitem_points(s, d)), "score", digits=9),
    "score_kl_divergence": lambda s, d: rounded(E.kl_divergence(lineitem_points(s, d)), "score"),
    "score_relief": lambda s, d: rounded(E.relief(embedding_points(s, d)), "score"),
    "score_rf_permutation_gini": lambda s, d: rounded(E.forest_permutation(status_points(s, d)), "score"),
    "rank_from_score": lambda s, d: E.rank_scores(E.gain_ratio(lineitem_points(s, d))),
    "select_forward": lambda s, d: rounded(E.select_forward(lineitem_points(s, d), 2), "score", digits=9),
    "select_backward": lambda s, d: rounded(E.select_backward(lineitem_points(s, d), 3), "score", digits=9),
    "rank_svm_rfe": lambda s, d: E.rank_svm_rfe(status_points(s, d), iterations=20),
    "rank_ensemble": lambda s, d: E.rank_ensemble(lineitem_points(s, d)),
}

_D = "list_distance(a.f, b.f)"
_CE = f"WITH {EMBL}, {CENT}"
_KNN = f"nn AS (SELECT * FROM (SELECT a.id, b.id AS nb, a.c AS ca, b.c AS cb, {_D} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {_D}, b.id) AS rk FROM emb a JOIN emb b ON a.id <> b.id)"
_STEP = f"{_CE}, asg AS (SELECT id, arg_min(cent.c, struct_pack(d := list_distance(f, m), c := cent.c)) AS p FROM emb, cent GROUP BY id)"
_MED = f"""WITH {EMBL}, md AS (SELECT c, arg_min(f, id) AS m FROM emb GROUP BY c),
  asg AS (SELECT id, arg_min(md.c, struct_pack(d := list_distance(f, m), c := md.c)) AS p FROM emb, md GROUP BY id),
  mean AS (SELECT p, list(v ORDER BY attr) AS m FROM (SELECT p, attr, avg(v) AS v FROM embl JOIN asg USING (id) GROUP BY ALL) GROUP BY p)
  SELECT p AS prediction, arg_min(id, struct_pack(d := list_distance(f, m), i := id)) AS point FROM mean, emb GROUP BY p"""
_FAR = f"""WITH {EMB}, c1 AS (SELECT f FROM emb WHERE id = 0),
  d1 AS (SELECT id, emb.f, list_distance(emb.f, c1.f) AS e0 FROM emb, c1), c2 AS (SELECT f FROM d1 ORDER BY e0 DESC, id LIMIT 1),
  d2 AS (SELECT d1.*, list_distance(d1.f, c2.f) AS e1 FROM d1, c2), c3 AS (SELECT f FROM d2 ORDER BY least(e0, e1) DESC, id LIMIT 1),
  d3 AS (SELECT d2.*, list_distance(d2.f, c3.f) AS e2 FROM d2, c3), c4 AS (SELECT f FROM d3 ORDER BY least(e0, e1, e2) DESC, id LIMIT 1),
  d4 AS (SELECT d3.*, list_distance(d3.f, c4.f) AS e3 FROM d3, c4)
  SELECT id, CAST(list_position([e0, e1, e2, e3], least(e0, e1, e2, e3)) - 1 AS BIGINT) AS prediction FROM d4"""
_DEG = f"WITH RECURSIVE {EMB}, dg AS (SELECT a.id, count(*) AS degree FROM emb a JOIN emb b ON {_D} < {EPS} GROUP BY 1)"
_DBSCAN = f"""{_DEG}, co AS (SELECT emb.id, f FROM emb JOIN dg USING (id) WHERE degree >= {MIN_POINTS}),
  ed AS (SELECT a.id AS u, b.id AS v FROM co a JOIN co b ON {_D} < {EPS}),
  re AS (SELECT u, v FROM ed UNION SELECT re.u, ed.v FROM re JOIN ed ON re.v = ed.u),
  cc AS (SELECT u AS id, min(v) AS p FROM re GROUP BY u),
  bo AS (SELECT a.id, min(cc.p) AS p FROM emb a JOIN co b ON {_D} < {EPS} JOIN cc ON cc.id = b.id WHERE a.id NOT IN (SELECT id FROM co) GROUP BY 1)
  SELECT id, p AS prediction FROM cc UNION ALL SELECT id, p FROM bo"""
_MCL = f"""WITH {EMB}, e AS (SELECT a.id AS src, b.id AS dst, list_cosine_similarity(a.f, b.f) AS w FROM emb a JOIN emb b ON a.id <> b.id WHERE list_cosine_similarity(a.f, b.f) > {SIM}
    UNION ALL SELECT id, id, 1.0 FROM emb),
  m AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM e),
  sq AS (SELECT a.src, b.dst, pow(sum(a.w * b.w), 2) AS w FROM m a JOIN m b ON a.dst = b.src GROUP BY ALL)
  SELECT src, dst, {sr('w / sum(w) OVER (PARTITION BY src)')} AS w FROM sq WHERE w >= 0.001"""
_SOM = f"""WITH {EMB}, g AS (SELECT g, list_transform(range(64), lambda a: ((g + 1) * (a + 1)) % 7 / 20.0::double - 0.15::double) AS m FROM range(4) t(g))
  SELECT id, CAST(arg_min(g, struct_pack(d := list_distance(f, m), g := g)) AS BIGINT) AS prediction FROM emb, g GROUP BY id"""
_MEANS = f"WITH {LIL}, mn AS (SELECT label AS l, avg(f0) AS m0, avg(f1) AS m1, avg(f2) AS m2, avg(f3) AS m3 FROM li GROUP BY 1)"
_NM = (_MEANS + ", pr AS (SELECT id, label, arg_min(l, struct_pack(d := pow(f0 - m0, 2) + pow(f1 - m1, 2) + pow(f2 - m2, 2) + pow(f3 - m3, 2), l := l)) AS predicted FROM li, mn GROUP BY 1, 2)")
_CONF = """, tt AS (SELECT count(*) AS n FROM pr), k AS (SELECT DISTINCT label FROM pr),
  cf AS (SELECT k.label, sum((pr.label = k.label AND predicted = k.label)::int)::bigint AS tp, sum((pr.label <> k.label AND predicted = k.label)::int)::bigint AS fp,
    sum((pr.label <> k.label AND predicted <> k.label)::int)::bigint AS tn, sum((pr.label = k.label AND predicted <> k.label)::int)::bigint AS fn FROM k, pr GROUP BY 1)"""
_DISC = "li3 AS (SELECT id, label, unnest([0, 1, 2]) AS attr, unnest([f0, f2, f3]) AS v FROM li)"
_NB = f"""WITH {LI}, {_DISC}, nc AS (SELECT label, count(*)::double AS n FROM li GROUP BY 1), vv AS (SELECT attr, count(DISTINCT v) AS nv FROM li3 GROUP BY 1),
  ct AS (SELECT attr, v, label, count(*)::double AS n FROM li3 GROUP BY ALL),
  lk AS (SELECT d.attr, d.v, nc.label, log2(coalesce(ct.n, 0) + 1) - log2(nc.n + nv) AS s FROM (SELECT DISTINCT attr, v FROM li3) d JOIN vv USING (attr), nc LEFT JOIN ct ON ct.attr = d.attr AND ct.v = d.v AND ct.label = nc.label),
  sc AS (SELECT li3.id, lk.label, sum(s) + max(log2(nc.n / (SELECT count(*) FROM li))) AS s FROM li3 JOIN lk ON lk.attr = li3.attr AND lk.v = li3.v JOIN nc ON nc.label = lk.label GROUP BY 1, 2)
  SELECT id, label, {sr('pow(2.0, s) / sum(pow(2.0, s)) OVER (PARTITION BY id)')} AS probability FROM sc"""
_MI = f"""WITH {LI}, {_DISC}, N AS (SELECT count(*)::double AS n FROM li),
  a AS (SELECT attr, sum(c / n * log10(c / n)) AS s FROM (SELECT attr, v, label, count(*) AS c FROM li3 GROUP BY ALL), N GROUP BY 1),
  b AS (SELECT attr, sum(c / n * log10(c / n)) AS s FROM (SELECT attr, v, count(*) AS c FROM li3 GROUP BY ALL), N GROUP BY 1),
  c AS (SELECT sum(c / n * log10(c / n)) AS s FROM (SELECT label, count(*) AS c FROM li GROUP BY ALL), N)
  SELECT attr, {sr('a.s - b.s - c.s', 9)} AS mi FROM a JOIN b USING (attr), c"""
_CMI = f"""WITH {LI}, {_DISC}, nc AS (SELECT label, count(*)::double AS n FROM li GROUP BY 1),
  one AS (SELECT attr, sum(c / n * log10(c / n)) AS s FROM (SELECT attr, v, label, count(*) AS c FROM li3 GROUP BY ALL) JOIN nc USING (label) GROUP BY 1),
  two AS (SELECT a1, a2, sum(c / n * log10(c / n)) AS s FROM (SELECT x.attr AS a1, x.v AS v1, y.attr AS a2, y.v AS v2, x.label, count(*) AS c FROM li3 x JOIN li3 y ON x.id = y.id AND x.attr < y.attr GROUP BY ALL) JOIN nc USING (label) GROUP BY 1, 2)
  SELECT a1 AS attr1, a2 AS attr2, {sr('two.s - p.s - q.s')} AS cmi FROM two JOIN one p ON p.attr = a1 JOIN one q ON q.attr = a2"""
_CV = f"""WITH {LI}, ps AS (SELECT *, (row_number() OVER (ORDER BY {su('id', '1')}, id) - 1) % 10 AS fold FROM li),
  mn AS (SELECT k.fold, label AS l, avg(f0) AS m0, avg(f1) AS m1, avg(f2) AS m2, avg(f3) AS m3 FROM ps JOIN range(10) k(fold) ON ps.fold <> k.fold GROUP BY 1, 2),
  pr AS (SELECT id, label, arg_min(l, struct_pack(d := pow(f0 - m0, 2) + pow(f1 - m1, 2) + pow(f2 - m2, 2) + pow(f3 - m3, 2), l := l)) AS predicted FROM ps JOIN mn USING (fold) GROUP BY 1, 2)"""
_BIN = f"""WITH {LIL}, bx AS (SELECT attr, min(v) AS lo, max(v) AS hi FROM lil GROUP BY 1),
  ct AS (SELECT attr, trunc((v - lo) / (hi - lo) * 9.0) AS b, label, count(*)::double AS n FROM lil JOIN bx USING (attr) GROUP BY ALL),
  h AS (SELECT attr, sum(n * log2(n)) AS cell, sum(n) AS t FROM ct GROUP BY 1),
  hr AS (SELECT attr, sum(n * log2(n)) AS r FROM (SELECT attr, b, sum(n) AS n FROM ct GROUP BY ALL) GROUP BY 1),
  hc AS (SELECT attr, sum(n * log2(n)) AS c FROM (SELECT attr, label, sum(n) AS n FROM ct GROUP BY ALL) GROUP BY 1),
  e AS (SELECT attr, (t * log2(t) - c) - (r - cell) AS gain, t * log2(t) - r AS hr, t * log2(t) - c AS hc FROM h JOIN hr USING (attr) JOIN hc USING (attr))"""
_KL = f"""WITH {LIL}, bx AS (SELECT attr, min(v) AS lo, max(v) AS hi FROM lil GROUP BY 1),
  ct AS (SELECT attr, label, CAST(floor((v - (lo + hi) / 2) / (hi - lo) * 99.999999::double + 50.0) AS INTEGER) AS b, count(*)::double AS n FROM lil JOIN bx USING (attr) GROUP BY ALL),
  gr AS (SELECT a.attr, l.label, b.b FROM (SELECT DISTINCT attr FROM ct) a, (SELECT DISTINCT label FROM ct) l, range(100) b(b)),
  p AS (SELECT gr.attr, gr.label, gr.b, coalesce(ct.n / sum(ct.n) OVER (PARTITION BY gr.attr, gr.label), 0.0000001) AS p FROM gr LEFT JOIN ct ON ct.attr = gr.attr AND ct.label = gr.label AND ct.b = gr.b),
  kl AS (SELECT x.attr, x.label AS lp, y.label AS lq, sum(x.p * ln(x.p / y.p)) AS kl FROM p x JOIN p y ON x.attr = y.attr AND x.b = y.b AND x.label <> y.label GROUP BY ALL)
  SELECT attr, {sr('max(s)')} AS score FROM (SELECT attr, kl / max(kl) OVER (PARTITION BY lp, lq) AS s FROM kl) GROUP BY attr"""
_RELIEF = f"""WITH {EMBL}, bx AS (SELECT attr, min(v) AS lo, max(v) AS hi FROM embl GROUP BY 1),
  n AS (SELECT id, c, attr, (v - lo) / (hi - lo) AS v FROM embl JOIN bx USING (attr)),
  pd AS (SELECT a.id, b.id AS nb, max((a.c = b.c)::int) AS hit, sum(abs(a.v - b.v)) AS d FROM n a JOIN n b ON a.attr = b.attr AND a.id <> b.id GROUP BY 1, 2),
  nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, hit ORDER BY d, nb) AS rn FROM pd) WHERE rn <= 2),
  df AS (SELECT nn.id, hit, a.attr, avg(abs(a.v - b.v)) AS g FROM nn JOIN n a ON a.id = nn.id JOIN n b ON b.id = nn.nb AND b.attr = a.attr GROUP BY ALL)
  SELECT CAST(attr AS INTEGER) AS attr, {sr('sum(CASE WHEN hit = 1 THEN -g ELSE g END) / (SELECT count(*) FROM emb)')} AS score FROM df GROUP BY attr"""
_REL = f"WITH {LIL}, ci AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS y FROM (SELECT DISTINCT label FROM li)), rl AS (SELECT attr, corr(v, y) AS s FROM lil JOIN ci USING (label) GROUP BY 1)"
_RATES = f"""SELECT label, {sr('tp/(tp+fn)')} AS tp_rate, {sr('tn/(tn+fp)')} AS tn_rate, {sr('fn/(tp+fn)')} AS fn_rate, {sr('fp/(tn+fp)')} AS fp_rate,
  {sr('(fp+fn)/(tp+fp+tn+fn)')} AS error_rate, {sr('(tp+tn)/(tp+fp+tn+fn)')} AS accuracy, {sr('tp/(tp+fn)')} AS recall, {sr('tp/nullif(tp+fp, 0)')} AS precision,
  coalesce({sr('2*tp/nullif(2*tp+fp+fn, 0)')}, 0) AS f_measure, {sr('(tp*tn-fp*fn)/nullif(sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)), 0)')} AS correlation_coefficient,
  {sr('(tp*tn+fp*fn)/nullif(sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)), 0)')} AS correlation, {sr('fp/nullif(tp, 0)')} AS cost,
  {sr('1-sqrt(2)*sqrt(pow(fn/(tp+fn),2)+pow(fp/(tn+fp),2))')} AS q9, {sr('0.5*(tp/(tp+fn)+tn/(tn+fp))')} AS bcr FROM (SELECT label, tp::double AS tp, fp::double AS fp, tn::double AS tn, fn::double AS fn FROM cf)"""

_BAGS = f"""WITH {LI}, ps AS (SELECT *, row_number() OVER (ORDER BY {su('id', '1:pos')}, id) - 1 AS pos FROM li),
  dr AS (SELECT bag, draw, CAST(floor((cast('0x' || substr(md5(cast(draw as varchar) || '|1:' || bag), 1, 13) as bigint) / 4503599627370496.0::double) * (SELECT count(*) FROM li)) AS BIGINT) AS pos
    FROM range((SELECT count(*) FROM li)) t(draw), range(5) b(bag)),
  bg AS (SELECT bag, ps.* FROM dr JOIN ps USING (pos)),
  mn AS (SELECT bag, label AS l, avg(f0) AS m0, avg(f1) AS m1, avg(f2) AS m2, avg(f3) AS m3 FROM bg GROUP BY 1, 2),
  pr AS (SELECT bag, id, label, arg_min(l, struct_pack(d := pow(f0 - m0, 2) + pow(f1 - m1, 2) + pow(f2 - m2, 2) + pow(f3 - m3, 2), l := l)) AS predicted FROM li, mn GROUP BY 1, 2, 3)"""

ORACLES = {
    "bagging_nearest_mean": f"{_BAGS} SELECT id, predicted AS label, {sr('count(*) / 5.0::double')} AS share FROM pr GROUP BY 1, 2",
    "oob_error": f"{_BAGS} SELECT count(*) AS tested, {sr('avg((predicted <> label)::int)')} AS error FROM pr WHERE (bag, id) NOT IN (SELECT bag, id FROM bg)",
    "knn_join": f"WITH {EMB}, {_KNN} WHERE rk <= 3) SELECT id, nb AS neighbour, {sr('d')} AS score, CAST(rk AS INTEGER) AS rank FROM nn",
    "range_join": f"WITH {EMB} SELECT a.id, b.id AS other, {sr(_D)} AS distance FROM emb a JOIN emb b ON a.id < b.id WHERE {_D} < {EPS}",
    "assign_nearest": f"{_CE} SELECT id, arg_min(cent.c, struct_pack(d := list_distance(f, m), c := cent.c)) AS prediction, {sr('min(list_distance(f, m))')} AS distance FROM emb, cent GROUP BY id",
    "box_range": f"WITH {LI} SELECT id, label FROM li WHERE f0 BETWEEN 10 AND 40 AND f1 BETWEEN 20000 AND 60000 AND f2 BETWEEN 0.02::double AND 0.08::double AND f3 BETWEEN 0.01::double AND 0.06::double",
    "kmeans_step": f"{_STEP} SELECT p AS prediction, count(DISTINCT embl.id) AS n, CAST(attr AS INTEGER) AS attr, {sr('avg(v)')} AS value FROM embl JOIN asg USING (id) GROUP BY p, attr",
    "kmedoids_step": _MED,
    "farthest_first": _FAR,
    "dbscan": _DBSCAN,
    "dbscan_core_points": f"{_DEG} SELECT id, degree FROM dg WHERE degree >= {MIN_POINTS}",
    "mcl_expand_inflate_step": _MCL,
    "som_assign": _SOM,
    "clf_zero_r": f"WITH {LI} SELECT label, count(*) AS n FROM li GROUP BY 1",
    "clf_knn": f"WITH {EMB}, {_KNN} WHERE rk <= 5), vt AS (SELECT id, cb, count(*)::double AS n FROM nn GROUP BY 1, 2), mx AS (SELECT id, max(n) AS hi, CASE WHEN count(*) < 10 THEN 0 ELSE min(n) END AS lo FROM vt GROUP BY 1) "
               f"SELECT id, cast(cb AS varchar) AS label, {sr('CASE WHEN hi <> lo THEN (n - lo) / (hi - lo) ELSE n END')} AS votes FROM vt JOIN mx USING (id)",
    "clf_nearest_mean": f"{_NM} SELECT * FROM pr",
    "clf_feature_voting": f"""{_MEANS}, ml AS (SELECT l, unnest([0, 1, 2, 3]) AS attr, unnest([m0, m1, m2, m3]) AS m FROM mn),
      vo AS (SELECT id, lil.attr, arg_min(l, struct_pack(g := abs(v - m), l := l)) AS vote FROM lil JOIN ml USING (attr) GROUP BY 1, 2),
      ct AS (SELECT id, vote, count(*) AS n FROM vo GROUP BY 1, 2) SELECT id, vote AS predicted, n / 4.0::double AS share FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, vote) AS rn FROM ct) WHERE rn = 1""",
    "clf_naive_bayes": _NB,
    "feature_mutual_information": _MI,
    "feature_conditional_mi": _CMI,
    "cv_nearest_mean": f"{_CV}{_CONF} SELECT * FROM cf",
    "confusion_counts": f"{_NM}{_CONF} SELECT * FROM cf",
    "classification_measures": f"{_NM}{_CONF} {_RATES}",
    "score_gain_ratio": f"{_BIN} SELECT attr, {sr('gain / hr', 9)} AS score FROM e",
    "score_symmetrical_uncertainty": f"{_BIN} SELECT attr, {sr('2 * gain / (hr + hc)', 9)} AS score FROM e",
    "score_kl_divergence": _KL,
    "score_relief": _RELIEF,
    "rank_from_score": f"{_BIN} SELECT attr, CAST(row_number() OVER (ORDER BY gain / hr DESC, attr) - 1 AS INTEGER) AS rank FROM e",
    "select_forward": f"{_REL} SELECT attr, {sr('s', 9)} AS score FROM rl ORDER BY abs(s) DESC LIMIT 2",
    "select_backward": f"{_REL} SELECT attr, {sr('s', 9)} AS score FROM rl ORDER BY abs(s) DESC LIMIT 3",
}
