"""Statistics, filters, normalisation, discretisation, sampling, vector and distance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import distances as D
from ..functions import vectors as V
from ..operators import discretize as Z
from ..operators import filters as L
from ..operators import sampling as P
from ..operators import stats as A
from ..session import one_row
from ..sources.points import class_index, embedding_points, lineitem_points, merge_points, spread
from .common import EMB, EMBL, LI, LIL, each, r, rounded, sr, su

NAN = float("nan")


def _li(fn, digits: int | None = 6):
    """Apply a point filter to lineitem and show the four attributes as columns."""
    def query(s, d):
        out = spread(fn(lineitem_points(s, d)), 4, "id")
        return rounded(out, "f0", "f1", "f2", "f3", digits=digits) if digits is not None else out
    return query


def _classes(fn):
    def query(s, d):
        return fn(lineitem_points(s, d)).groupBy("label").agg(
            F.count(F.lit(1)).alias("n"), r(F.sum(F.get("features", 0)), 2).alias("sum_f0"))
    return query


def with_gaps(points):
    """Embeddings with their extreme cells made missing (NaN)."""
    return points.withColumn("features", F.transform("features", lambda x: F.when(x > 0.3, F.lit(NAN)).otherwise(x)))


def drop_missing(s, d):
    return L.drop_missing(with_gaps(embedding_points(s, d))).select("id", r(V.total(F.col("features"))).alias("total"))


def impute_constant(s, d):
    p = L.impute_constant(with_gaps(embedding_points(s, d)), -1.0)
    return p.select("id", r(V.total(F.col("features"))).alias("total"))


def impute_knn(s, d):
    p = L.impute_knn(with_gaps(embedding_points(s, d)), 5).select("id", F.posexplode("features").alias("attr", "value"))
    return p.withColumn("value", F.when(F.isnan("value"), F.col("value")).otherwise(r("value")))


def remove_attributes(s, d):
    return spread(L.remove_attributes(lineitem_points(s, d), [1, 3]), 2, "id")


def retain_attributes(s, d):
    return spread(L.retain_attributes(lineitem_points(s, d), [1, 3]), 2, "id")


def attr_percentile(s, d):
    return rounded(A.percentiles(lineitem_points(s, d), [10.0, 50.0, 99.9]), "value")


def merge(s, d):
    both = merge_points(lineitem_points(s, d).select("id", "features", "label"), embedding_points(s, d).select("id", "features", "label"))
    return both.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).cast("bigint").alias("dims"))


def vector_arith(s, d):
    p = lineitem_points(s, d)
    x, y = F.col("features"), F.reverse("features")
    first = lambda v, i: F.get(v, i)
    return p.select(
        "id", r(first(V.add(x, y), 0)).alias("add0"), r(first(V.subtract(x, y), 1)).alias("sub1"),
        r(first(V.multiply(x, y), 2)).alias("mul2"), r(first(V.divide(x, y), 3), 9).alias("div3"),
        r(first(V.add(x, 2.5), 0)).alias("add_s"), r(first(V.divide(x, 4.0), 1)).alias("div_s"),
        r(first(V.sqrt(x), 1)).alias("sqrt1"))


def vector_summary(s, d):
    f = F.col("features")
    p = lineitem_points(s, d)
    return p.select(
        "id", r(V.total(f)).alias("total"), r(F.array_max(f)).alias("max"), r(F.array_min(f)).alias("min"),
        V.argmax(f).alias("argmax"), r(V.norm(f)).alias("norm"), r(V.mean(f)).alias("mean"),
        r(V.harmonic_mean(V.add(f, 1.0))).alias("harmonic"), r(F.log2(F.get(f, 1))).alias("log2_1"),
        r(F.get(V.normalize_sum(f), 1), 9).alias("share1"), F.get(V.sort_order(f), 0).alias("first_pos"),
        r(F.get(F.reverse(f), 0)).alias("last"), r(F.get(V.absolute(V.subtract(f, 100.0)), 0)).alias("abs0"))


def set_ops_arrays(s, d):
    p = embedding_points(s, d)
    a = V.int_set(V.multiply(F.col("features"), 10.0))
    b = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: i.cast("bigint"))
    return p.select("id", F.size(F.array_union(a, b)).alias("n_union"), F.size(F.array_intersect(a, b)).alias("n_common"))


# ---- distances: every embedding against its successor --------------------------------------------

def successor_pairs(points):
    nxt = points.select((F.col("id") - 1).alias("id"), F.col("features").alias("y"))
    return points.select("id", F.col("features").alias("x")).join(nxt, "id")


def _dist(fn, scale: float = 1.0, digits: int = 6):
    def query(s, d):
        p = embedding_points(s, d)
        if scale != 1.0:
            p = p.withColumn("features", V.multiply(F.col("features"), scale))
        return successor_pairs(p).select("id", r(fn(F.col("x"), F.col("y")), digits).alias("dist"))
    return query


def _dist_ranged(fn):
    def query(s, d):
        p = embedding_points(s, d)
        box = one_row(A.as_row(A.attribute_stats(p).select("attr", "min", "max")))
        pairs = successor_pairs(p).withColumn("s", box)
        return pairs.select("id", r(fn(F.col("x"), F.col("y"), F.col("s.min"), F.col("s.max"))).alias("dist"))
    return query


def dist_mahalanobis(s, d):
    """Covariance of the whole set, inverted once (4 x 4)."""
    import numpy as np

    p = lineitem_points(s, d)
    cols = [F.get("features", i).alias(f"x{i}") for i in range(4)]
    cov = p.select(*cols).agg(*[F.covar_samp(f"x{i}", f"x{j}").alias(f"c{i}{j}") for i in range(4) for j in range(4)]).first()
    inv = np.linalg.inv(np.array(list(cov)).reshape(4, 4))
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in inv])
    center = one_row(A.as_row(A.attribute_stats(p).select("attr", "mean")))
    return p.withColumn("s", center).select("id", r(D.mahalanobis(F.col("features"), F.col("s.mean"), rows)).alias("dist"))


def dist_angular(s, d):
    """Three-attribute line items against the mean line item."""
    p = L.retain_attributes(lineitem_points(s, d), [0, 2, 3])
    center = one_row(A.as_row(A.attribute_stats(p).select("attr", "mean")))
    return p.withColumn("s", center).select("id", r(D.angular(F.col("features"), F.col("s.mean"))).alias("dist"))


def bin_mdl(s, d):
    """Cuts that tell expensive discounted line items from the rest."""
    price, discount = F.get("features", 1), F.get("features", 2)
    marked = lineitem_points(s, d).withColumn(
        "label", F.when(price > 50000, F.when(discount > 0.05, "A").otherwise("B")).otherwise("C"))
    return Z.mdl_cuts(L.remove_attributes(marked, [3]))


def split_record(s, d):
    out = Z.split_records(lineitem_points(s, d))
    flat = out.select("attr", "cut", "lef", "entropy", "entropy1", "entropy2", "kinds1", "kinds2", "size1", "size2",
                      *[F.element_at(f"counts{k}", F.lit(c)).alias(f"{c.lower()}{k}") for k in (1, 2) for c in "ANR"])
    return rounded(flat, "lef", "entropy", "entropy1", "entropy2")


def _binned(s, d, bins):
    """Bin numbers of the three attributes with few distinct values."""
    p = L.retain_attributes(lineitem_points(s, d), [0, 2, 3])
    return spread(Z.EntropyBinner(bins).fit_transform(p), 3, "id")


def _draw_rows(df):
    return df.select("id", "label")


QUERIES = {
    "attr_min_max": lambda s, d: A.attribute_stats(lineitem_points(s, d)).select("attr", "min", "max"),
    "attr_mean": lambda s, d: rounded(A.attribute_stats(lineitem_points(s, d)).select("attr", "mean"), "mean", digits=8),
    "attr_stddev": lambda s, d: rounded(A.attribute_stats(lineitem_points(s, d)).select("attr", "std"), "std"),
    "attr_percentile": attr_percentile,
    "merge_points": merge,
    "vector_arith": vector_arith,
    "class_index": lambda s, d: class_index(lineitem_points(s, d)),
    "vector_summary": vector_summary,
    "set_ops_arrays": set_ops_arrays,
    "column_correlation": lambda s, d: rounded(A.column_correlation(lineitem_points(s, d), 0, 1), "mean_x", "mean_y", "var_x", "var_y", "corr", digits=4),
    "class_remove": _classes(lambda p: L.remove_class(p, "A")),
    "class_retain": _classes(lambda p: L.retain_class(p, "A")),
    "class_replace": _classes(lambda p: L.replace_class(p, "A", "Z")),
    "class_unset": _classes(L.unset_class),
    "drop_missing_class": _classes(lambda p: L.drop_missing_class(p.withColumn("label", F.when(F.col("label") != "A", F.col("label"))))),
    "remove_attributes": remove_attributes,
    "retain_attributes": retain_attributes,
    "value_floor": _li(L.floor_values),
    "value_ceil": _li(L.ceil_values),
    "value_round": _li(L.round_values),
    "value_replace": _li(lambda p: L.replace_value(p, 0.0, -7.0)),
    "drop_missing": drop_missing,
    "impute_constant": impute_constant,
    "impute_knn": impute_knn,
    "normalize_mean": _li(lambda p: L.MeanScaler().fit_transform(p)),
    "normalize_median_iqr": _li(lambda p: L.MedianIqrScaler().fit_transform(p)),
    "normalize_midrange": _li(lambda p: L.MidrangeScaler().fit_transform(p)),
    "normalize_row_midrange": _li(L.row_midrange),
    "bin_equal_width": _li(lambda p: L.EqualWidthBinner(10).fit_transform(p)),
    "bin_mdl": bin_mdl,
    "bin_entropy_2": lambda s, d: rounded(Z.two_bin_cuts(lineitem_points(s, d)), "lef"),
    "bin_entropy_3": lambda s, d: _cuts(s, d, 3),
    "bin_entropy_4": lambda s, d: _cuts(s, d, 4),
    "bin_split_record": split_record,
    "bin_apply_2": _li(lambda p: Z.EntropyBinner(2).fit_transform(p)),
    "bin_apply_3": lambda s, d: _binned(s, d, 3),
    "bin_apply_4": lambda s, d: _binned(s, d, 4),
    "bootstrap_sample": lambda s, d: P.bootstrap(lineitem_points(s, d))[0].select("draw", "id"),
    "out_of_bag": lambda s, d: P.bootstrap(lineitem_points(s, d))[1].select("id"),
    "subsample": lambda s, d: _draw_rows(P.subsample(lineitem_points(s, d), size=1000)[0]),
    "stratified_subsample": lambda s, d: _draw_rows(P.subsample(lineitem_points(s, d), fraction=0.1, stratified=True)[0]),
    "stratified_bootstrap": lambda s, d: P.bootstrap(lineitem_points(s, d), fraction=0.1, stratified=True)[0].select("draw", "id", "label"),
    "kfold_split": lambda s, d: P.kfold_split(lineitem_points(s, d), 10).select("id", "fold"),
    "dist_euclidean": _dist(D.euclidean),
    "dist_minkowski": _dist(lambda x, y: D.minkowski(x, y, 3.0)),
    "dist_manhattan": _dist(D.manhattan),
    "dist_chebyshev": _dist(D.chebyshev),
    "dist_cosine_similarity": _dist(D.cosine_similarity),
    "dist_cosine_distance": _dist(D.cosine_distance),
    "dist_jaccard_similarity": _dist(D.jaccard_similarity, 40.0),
    "dist_jaccard_distance": _dist(D.jaccard_distance, 40.0),
    "dist_consistency_index": _dist(lambda x, y: D.consistency_index(x, y, 64), 40.0),
    "dist_pearson": _dist(D.pearson),
    "dist_spearman_rank": _dist(D.spearman_rank, 40.0),
    "dist_spearman_footrule": _dist(D.spearman_footrule, 40.0),
    "dist_normalized_euclidean": _dist_ranged(D.normalized_euclidean),
    "dist_normalized_euclidean_similarity": _dist_ranged(D.normalized_euclidean_similarity),
    "dist_angular": dist_angular,
    "dist_mahalanobis": dist_mahalanobis,
    "dist_max_product": _dist(D.max_product),
    "dist_linear_kernel": _dist(D.linear_kernel),
    "dist_polynomial_kernel": _dist(lambda x, y: D.polynomial_kernel(x, y, 3.0), digits=9),
    "dist_rbf_kernel": _dist(D.rbf_kernel),
    "dist_rbf_distance": _dist(D.rbf_distance),
}


def _cuts(s, d, bins):
    """Optimal cuts of the three attributes with few distinct values."""
    p = L.retain_attributes(lineitem_points(s, d), [0, 2, 3])
    return Z.optimal_cuts(p, bins).select("attr", *[F.get("cuts", i).alias(f"cut{i + 1}") for i in range(bins - 1)], r("lef").alias("lef"))


def _cls(where: str = "true", label: str = "label") -> str:
    return f"WITH {LI} SELECT {label} AS label, count(*) AS n, {sr('sum(f0)', 2)} AS sum_f0 FROM li WHERE {where} GROUP BY 1"


_ST = f"WITH {LIL}, st AS (SELECT attr, min(v) AS lo, max(v) AS hi, avg(v) AS mu, stddev_pop(v) AS sd, list_sort(list(v)) AS l, count(*) AS n FROM lil GROUP BY attr)"


def _pct(p: float) -> str:
    pos = f"(n * {p} / 100.0 + {p} / 100.0)"
    k = f"greatest(1, least(floor({pos}), n))::bigint"
    return (f"(l[{k}] + (CASE WHEN {pos} < 1 OR {pos} >= n THEN 0.0 ELSE {pos} - {k} END) * (l[least({k} + 1, n)] - l[{k}]))")


def _wide(stats: str, template: str) -> str:
    """Per-attribute statistics as one row s(a0.., ...) joined to li; template uses {x} and s.<stat>[{j}]."""
    inner = ", ".join(f"list({c} ORDER BY attr) AS {n}" for n, c in [x.split("=") for x in stats.split(";")])
    cols = ", ".join(sr(template.format(x=f"f{i}", j=i + 1)) + f" AS f{i}" for i in range(4))
    return f"{_ST}, s AS (SELECT {inner} FROM (SELECT *, {_pct(25)} AS q1, {_pct(50)} AS q2, {_pct(75)} AS q3 FROM st)) SELECT id, {cols} FROM li, s"


_GAP = f"WITH {EMBL}, g AS (SELECT id, attr, CASE WHEN v > 0.3 THEN NULL ELSE v END AS v FROM embl)"
_PAIRS = f"WITH {EMB}, pr AS (SELECT a.id, a.f AS x, b.f AS y FROM emb a JOIN emb b ON b.id = a.id + 1)"
_PAIRS40 = _PAIRS.replace("a.f AS x", "list_transform(a.f, lambda q: q * 40.0) AS x").replace("b.f AS y", "list_transform(b.f, lambda q: q * 40.0) AS y")
_ZIP = "list_transform(list_zip(x, y), lambda z: {e})"


def _d(expr: str, base: str = _PAIRS, digits: int = 6) -> str:
    return f"{base} SELECT id, {sr(expr, digits)} AS dist FROM pr"


def _agg(e: str, fn: str = "list_sum") -> str:
    return f"{fn}({_ZIP.format(e=e)})"


_SETS = f"{_PAIRS40}, st AS (SELECT id, list_distinct(list_transform(x, lambda q: trunc(q)::bigint)) AS a, list_distinct(list_transform(y, lambda q: trunc(q)::bigint)) AS b FROM pr), sz AS (SELECT id, greatest(len(a), len(b))::double AS k, len(list_intersect(a, b))::double AS r, len(list_distinct(list_concat(a, b)))::double AS u FROM st)"
_RANGED = f"""WITH {EMBL}, bx AS (SELECT attr, min(v) AS lo, max(v) AS hi FROM embl GROUP BY attr),
  n AS (SELECT a.id, sqrt(sum(pow((a.v - b.v) / nullif(hi - lo, 0), 2))) / sqrt(count(*)) AS d FROM embl a JOIN embl b ON b.id = a.id + 1 AND a.attr = b.attr JOIN bx ON bx.attr = a.attr GROUP BY 1)"""
_SIM = _agg("z[1] * z[2]") + " / (sqrt(list_sum(list_transform(x, lambda q: q * q))) * sqrt(list_sum(list_transform(y, lambda q: q * q))))"
_RBF = "exp(-0.01 * pow(list_distance(x, y), 2))"

_ENT = lambda n: " + ".join(f"(CASE WHEN {n}{c} > 0 THEN -({n}{c} / {n}t) * log2({n}{c} / {n}t) ELSE 0 END)" for c in "anr")
_LIVAL = """vc AS (SELECT attr, v, sum((label = 'A')::int)::double AS ca, sum((label = 'N')::int)::double AS cn, sum((label = 'R')::int)::double AS cr FROM {src} GROUP BY ALL),
  cu AS (SELECT attr, v, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY attr) AS m,
    coalesce(sum(ca) OVER p, 0) AS ba, coalesce(sum(cn) OVER p, 0) AS bn, coalesce(sum(cr) OVER p, 0) AS br,
    sum(ca) OVER (PARTITION BY attr) AS ta, sum(cn) OVER (PARTITION BY attr) AS tn, sum(cr) OVER (PARTITION BY attr) AS tr
    FROM vc WINDOW w AS (PARTITION BY attr ORDER BY v), p AS (PARTITION BY attr ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _entropy_sql(cs: list[str]) -> str:
    t = "(" + " + ".join(cs) + ")"
    return "(" + " + ".join(f"(CASE WHEN {c} > 0 THEN -(({c}) / {t}) * log2(({c}) / {t}) ELSE 0 END)" for c in cs) + ")"


def _cut_sql(bins: int) -> str:
    """Brute force over all cut tuples."""
    src = "(SELECT id, label, unnest([0, 1, 2]) AS attr, unnest([f0, f2, f3]) AS v FROM li)"
    base = f"WITH {LI}, {_LIVAL.format(src=src)}, q AS (SELECT * FROM cu WHERE pos > 0)"
    names = [f"q{i}" for i in range(1, bins)]
    join = f"q {names[0]}" + "".join(f" JOIN q {b} ON {b}.attr = {a}.attr AND {b}.pos > {a}.pos" for a, b in zip(names, names[1:]))
    parts = []
    for left, right in zip([None] + names, names + [None]):
        lo = lambda c, t=left: f"{t}.b{c}" if t else "0"
        hi = lambda c, t=right: f"{t}.b{c}" if t else f"{names[0]}.t{c}"
        size = f"({right + '.pos' if right else names[0] + '.m'} - {left + '.pos' if left else '0'})"
        parts.append(f"{size}::double / {names[0]}.m * {_entropy_sql([f'({hi(c)} - {lo(c)})' for c in 'anr'])}")
    cuts = ", ".join(f"{n}.v AS cut{i + 1}" for i, n in enumerate(names))
    order = ", ".join(f"cut{i + 1}" for i in range(bins - 1))
    return f"""{base}, al AS (SELECT q1.attr, {cuts}, {' + '.join(parts)} AS lef FROM {join}),
      rk AS (SELECT *, row_number() OVER (PARTITION BY attr ORDER BY round(lef, 12), {order}) AS rn FROM al)
      SELECT CAST(attr AS INTEGER) AS attr, {order}, {sr('lef')} AS lef FROM rk WHERE rn = 1"""


def _apply_sql(bins: int) -> str:
    cells = ", ".join("(" + " + ".join(f"(f{f} >= c{k}[{i + 1}])::int" for k in range(1, bins)) + f")::double AS f{i}" for i, f in enumerate((0, 2, 3)))
    cuts = ", ".join(f"list(cut{k} ORDER BY attr) AS c{k}" for k in range(1, bins))
    return f"WITH cuts AS ({_cut_sql(bins)}), c AS (SELECT {cuts} FROM cuts), {LI} SELECT id, {cells} FROM li, c"


_POS = f"WITH {LI}, ps AS (SELECT *, row_number() OVER (ORDER BY {su('id', '1')}, id) - 1 AS pos FROM li)"
_BOOT = f"""WITH {LI}, ps AS (SELECT *, row_number() OVER (ORDER BY {su('id', '1:pos')}, id) - 1 AS pos FROM li),
  dr AS (SELECT draw, CAST(floor({su('draw', '1:0')} * (SELECT count(*) FROM li)) AS BIGINT) AS pos FROM range((SELECT count(*) FROM li)) t(draw)),
  bag AS (SELECT draw, id FROM dr JOIN ps USING (pos))"""
_STRATBOOT = f"""WITH {LI}, ps AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {su('id', '1:pos')}, id) - 1 AS pos FROM li),
  ct AS (SELECT label, count(*) AS n, CAST(ceil(count(*) * 0.1::double) AS BIGINT) AS want FROM li GROUP BY 1),
  dr AS (SELECT label, n, unnest(range(want)) AS draw FROM ct),
  dp AS (SELECT label, draw, CAST(floor((cast('0x' || substr(md5(cast(draw as varchar) || '|1:0:' || label), 1, 13) as bigint) / 4503599627370496.0::double) * n) AS BIGINT) AS pos FROM dr)
  SELECT draw, id, label FROM dp JOIN ps USING (label, pos)"""

ORACLES = {
    "attr_min_max": f"{_ST} SELECT attr, lo AS min, hi AS max FROM st",
    "attr_mean": f"{_ST} SELECT attr, {sr('mu', 8)} AS mean FROM st",
    "attr_stddev": f"{_ST} SELECT attr, {sr('sd')} AS std FROM st",
    "attr_percentile": f"{_ST} " + " UNION ALL ".join(f"SELECT attr, {p}::double AS p, {sr(_pct(p))} AS value FROM st" for p in (10.0, 50.0, 99.9)),
    "merge_points": f"WITH {LI}, {EMB} SELECT label, count(*) AS n, 4::bigint AS dims FROM li GROUP BY 1 UNION ALL SELECT cast(c AS varchar), count(*), max(len(f))::bigint FROM emb GROUP BY 1",
    "vector_arith": f"WITH {LI} SELECT id, {sr('f0 + f3')} AS add0, {sr('f1 - f2')} AS sub1, {sr('f2 * f1')} AS mul2, {sr('f3 / nullif(f0, 0)', 9)} AS div3, {sr('f0 + 2.5::double')} AS add_s, {sr('f1 / 4.0::double')} AS div_s, {sr('sqrt(f1)')} AS sqrt1 FROM li",
    "class_index": f"WITH {LI} SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS class_index FROM (SELECT DISTINCT label FROM li)",
    "vector_summary": f"""WITH {LI}, x AS (SELECT *, [f0, f1, f2, f3] AS f, f0 + f1 + f2 + f3 AS t FROM li) SELECT id, {sr('t')} AS total, {sr('list_max(f)')} AS max, {sr('list_min(f)')} AS min,
      CAST(list_position(f, list_max(f)) - 1 AS INTEGER) AS argmax, {sr('sqrt(f0*f0 + f1*f1 + f2*f2 + f3*f3)')} AS norm, {sr('t / 4')} AS mean,
      {sr('4 / (1/(f0+1) + 1/(f1+1) + 1/(f2+1) + 1/(f3+1))')} AS harmonic, {sr('log2(f1)')} AS log2_1, {sr('f1 / t', 9)} AS share1,
      CAST(list_position(f, list_min(f)) - 1 AS INTEGER) AS first_pos, {sr('f3')} AS last, {sr('abs(f0 - 100)')} AS abs0 FROM x""",
    "set_ops_arrays": f"WITH {EMB}, s AS (SELECT id, list_distinct(list_transform(f, lambda q: trunc(q * 10.0::double)::bigint)) AS a, [0, 1, 2, 3]::bigint[] AS b FROM emb) SELECT id, CAST(len(list_distinct(list_concat(a, b))) AS INTEGER) AS n_union, CAST(len(list_intersect(a, b)) AS INTEGER) AS n_common FROM s",
    "column_correlation": f"WITH {LI} SELECT {sr('avg(f0)', 4)} AS mean_x, {sr('avg(f1)', 4)} AS mean_y, {sr('var_samp(f0)', 4)} AS var_x, {sr('var_samp(f1)', 4)} AS var_y, {sr('corr(f0, f1)', 4)} AS corr FROM li",
    "class_remove": _cls("label <> 'A'"),
    "class_retain": _cls("label = 'A'"),
    "class_replace": _cls(label="CASE WHEN label = 'A' THEN 'Z' ELSE label END"),
    "class_unset": _cls(label="CAST(NULL AS VARCHAR)"),
    "drop_missing_class": _cls("label <> 'A'"),
    "remove_attributes": f"WITH {LI} SELECT id, f0, f2 AS f1 FROM li",
    "retain_attributes": f"WITH {LI} SELECT id, f1 AS f0, f3 AS f1 FROM li",
    "value_floor": f"WITH {LI} SELECT id, {each('trunc({x})')} FROM li",
    "value_ceil": f"WITH {LI} SELECT id, {each('trunc({x} + 1)')} FROM li",
    "value_round": f"WITH {LI} SELECT id, {each('trunc({x} + 0.5)')} FROM li",
    "value_replace": f"WITH {LI} SELECT id, {each('CASE WHEN {x} = 0 THEN -7.0::double ELSE {x} END')} FROM li",
    "drop_missing": f"{_GAP} SELECT id, {sr('sum(v)')} AS total FROM g GROUP BY id HAVING count(v) = count(*)",
    "impute_constant": f"{_GAP} SELECT id, {sr('sum(coalesce(v, -1.0))')} AS total FROM g GROUP BY id",
    "impute_knn": f"""{_GAP}, pd AS (SELECT a.id, b.id AS nb, sqrt(sum(pow(a.v - b.v, 2))) AS d FROM g a JOIN g b ON a.attr = b.attr AND a.id <> b.id GROUP BY ALL),
      nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nb) AS rn FROM pd) WHERE rn <= 5),
      fl AS (SELECT nn.id, g.attr, avg(g.v) AS m FROM nn JOIN g ON g.id = nn.nb GROUP BY ALL)
      SELECT g.id, CAST(g.attr AS INTEGER) AS attr, CASE WHEN coalesce(g.v, m) IS NULL THEN 'nan'::double ELSE {sr('coalesce(g.v, m)')} END AS value FROM g LEFT JOIN fl ON fl.id = g.id AND fl.attr = g.attr""",
    "normalize_mean": _wide("mu=mu;sd=sd", "({x} - s.mu[{j}]) / s.sd[{j}]"),
    "normalize_median_iqr": _wide("q1=q1;q2=q2;q3=q3", "({x} - s.q2[{j}]) / ((s.q3[{j}] - s.q1[{j}]) / 1.35)"),
    "normalize_midrange": _wide("lo=lo;hi=hi", "({x} - (s.lo[{j}] + s.hi[{j}]) / 2) / (s.hi[{j}] - s.lo[{j}]) * 2.0"),
    "normalize_row_midrange": f"WITH {LI}, x AS (SELECT *, least(f0, f1, f2, f3) AS lo, greatest(f0, f1, f2, f3) AS hi FROM li) SELECT id, {', '.join(sr(f'(f{i} - (lo + hi) / 2) / (hi - lo) * 2.0') + f' AS f{i}' for i in range(4))} FROM x",
    "bin_equal_width": _wide("lo=lo;hi=hi", "trunc(({x} - s.lo[{j}]) / (s.hi[{j}] - s.lo[{j}]) * 9.0)"),
    "bin_entropy_2": f"""WITH {LIL}, {_LIVAL.format(src='lil')}, al AS (SELECT attr, v AS cut, pos::double / m * {_entropy_sql(['ba', 'bn', 'br'])} + (m - pos)::double / m * {_entropy_sql(['(ta - ba)', '(tn - bn)', '(tr - br)'])} AS lef FROM cu WHERE pos > 0),
      rk AS (SELECT *, row_number() OVER (PARTITION BY attr ORDER BY round(lef, 12), cut) AS rn FROM al) SELECT CAST(attr AS INTEGER) AS attr, cut, {sr('lef')} AS lef FROM rk WHERE rn = 1""",
    "bin_split_record": f"""WITH {LIL}, {_LIVAL.format(src='lil')}, al AS (SELECT attr, v AS cut, pos, m, {_entropy_sql(['ta', 'tn', 'tr'])} AS e, {_entropy_sql(['ba', 'bn', 'br'])} AS e1,
        {_entropy_sql(['(ta - ba)', '(tn - bn)', '(tr - br)'])} AS e2, ba, bn, br, ta, tn, tr FROM cu WHERE pos > 0),
      rk AS (SELECT *, pos::double / m * e1 + (m - pos)::double / m * e2 AS lef, row_number() OVER (PARTITION BY attr ORDER BY round(pos::double / m * e1 + (m - pos)::double / m * e2, 12), cut) AS rn FROM al)
      SELECT CAST(attr AS INTEGER) AS attr, cut, {sr('lef')} AS lef, {sr('e')} AS entropy, {sr('e1')} AS entropy1, {sr('e2')} AS entropy2,
        (ba > 0)::int + (bn > 0)::int + (br > 0)::int AS kinds1, (ta > ba)::int + (tn > bn)::int + (tr > br)::int AS kinds2, pos AS size1, m - pos AS size2,
        ba::bigint AS a1, bn::bigint AS n1, br::bigint AS r1, (ta - ba)::bigint AS a2, (tn - bn)::bigint AS n2, (tr - br)::bigint AS r2 FROM rk WHERE rn = 1""",
    "bin_apply_2": f"""WITH {LIL}, {_LIVAL.format(src='lil')}, al AS (SELECT attr, v AS cut, pos::double / m * {_entropy_sql(['ba', 'bn', 'br'])} + (m - pos)::double / m * {_entropy_sql(['(ta - ba)', '(tn - bn)', '(tr - br)'])} AS lef FROM cu WHERE pos > 0),
      rk AS (SELECT *, row_number() OVER (PARTITION BY attr ORDER BY round(lef, 12), cut) AS rn FROM al), c AS (SELECT list(cut ORDER BY attr) AS l FROM rk WHERE rn = 1)
      SELECT id, {', '.join(f'(f{i} >= l[{i + 1}])::int::double AS f{i}' for i in range(4))} FROM li, c""",
    "bin_apply_3": _apply_sql(3),
    "bin_apply_4": _apply_sql(4),
    "bin_entropy_3": _cut_sql(3),
    "bin_entropy_4": _cut_sql(4),
    "bootstrap_sample": f"{_BOOT} SELECT draw, id FROM bag",
    "out_of_bag": f"{_BOOT} SELECT id FROM li WHERE id NOT IN (SELECT id FROM bag)",
    "subsample": f"{_POS} SELECT id, label FROM ps WHERE pos < 1000",
    "stratified_subsample": f"WITH {LI}, ps AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {su('id', '1')}, id) - 1 AS pos, count(*) OVER (PARTITION BY label) AS n FROM li) SELECT id, label FROM ps WHERE pos < ceil(n * 0.1::double)",
    "stratified_bootstrap": _STRATBOOT,
    "kfold_split": f"{_POS} SELECT id, CAST(pos % 10 AS INTEGER) AS fold FROM ps",
    "dist_euclidean": _d("list_distance(x, y)"),
    "dist_minkowski": _d("pow(" + _agg("pow(abs(z[1] - z[2]), 3.0)") + ", 1.0 / 3.0)"),
    "dist_manhattan": _d(_agg("abs(z[1] - z[2])")),
    "dist_chebyshev": _d(_agg("abs(z[1] - z[2])", "list_max")),
    "dist_cosine_similarity": _d(f"greatest({_SIM}, 0)"),
    "dist_cosine_distance": _d(f"1 - greatest({_SIM}, 0)"),
    "dist_jaccard_similarity": f"{_SETS} SELECT id, {sr('r / u')} AS dist FROM sz",
    "dist_jaccard_distance": f"{_SETS} SELECT id, {sr('1 - r / u')} AS dist FROM sz",
    "dist_consistency_index": f"{_SETS} SELECT id, {sr('(r * 64 - k * k) / (k * (64 - k))')} AS dist FROM sz",
    "dist_pearson": _d(f"({_agg('z[1] * z[2]')} - list_sum(x) * list_sum(y) / 64) / (sqrt(list_sum(list_transform(x, lambda q: q * q)) - pow(list_sum(x), 2) / 64) * sqrt(list_sum(list_transform(y, lambda q: q * q)) - pow(list_sum(y), 2) / 64))"),
    "dist_spearman_rank": _d(f"1 - 6.0 * {_agg('pow(z[1] - z[2], 2)')} / (64 * (64 * 64 - 1))", _PAIRS40),
    "dist_spearman_footrule": _d(f"1 - {_agg('abs(z[1] - z[2])')} / (64 * 64 / 2.0)", _PAIRS40),
    "dist_normalized_euclidean": f"{_RANGED} SELECT id, {sr('d')} AS dist FROM n",
    "dist_normalized_euclidean_similarity": f"{_RANGED} SELECT id, {sr('1 - d')} AS dist FROM n",
    "dist_angular": f"WITH {LI}, m AS (SELECT avg(f0) AS a, avg(f2) AS b, avg(f3) AS c FROM li), g AS (SELECT id, atan2(sqrt(f0 * f0 + f2 * f2), f3) - atan2(sqrt(m.a * m.a + m.b * m.b), m.c) AS t, abs(atan2(f2, f0) - atan2(m.b, m.a)) AS p FROM li, m) SELECT id, {sr('sqrt(t * t + p * p)')} AS dist FROM g",
    "dist_max_product": _d(_agg("z[1] * z[2]", "list_max")),
    "dist_linear_kernel": _d(_agg("z[1] * z[2]")),
    "dist_polynomial_kernel": _d(f"pow({_agg('z[1] * z[2]')}, 3.0)", digits=9),
    "dist_rbf_kernel": _d(_RBF),
    "dist_rbf_distance": _d(f"1 - {_RBF}"),
}
