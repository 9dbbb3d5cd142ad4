"""Random tree and forest queries with their SQL twins, which repeat the growth level by level."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as M
from ..operators import trees as T
from ..sources.points import lineitem_points
from .common import LI, rounded, sr, su

DIMS = 4


def tree(s, d):
    p = lineitem_points(s, d).drop("prediction")
    return T.random_tree(p, attributes=2, depth=4).transform(p).select("id", "label", "predicted")


def forest(s, d):
    p = lineitem_points(s, d).drop("prediction")
    grown, _ = T.random_forest(p, trees=3, depth=3)
    share = F.element_at("distribution", F.col("predicted"))
    return rounded(grown.transform(p).select("id", "label", "predicted", share.alias("share")), "share")


def forest_error(s, d):
    grown, rows = T.random_forest(lineitem_points(s, d), trees=3, depth=3)
    return rounded(T.out_of_bag_error(grown, rows), "error")


def permutation(s, d):
    grown, rows = T.random_forest(lineitem_points(s, d), trees=10, depth=5)
    return rounded(T.permutation_scores(grown, rows), "score")


def bagged_means(s, d):
    p = lineitem_points(s, d).drop("prediction")
    share = F.element_at("distribution", F.col("predicted"))
    out = M.Bagging(M.NearestMean(), 4).fit(p).transform(p)
    return rounded(out.select("id", "predicted", share.alias("share")), "share")


def bagged_error(s, d):
    return rounded(M.Bagging(M.NearestMean(), 4).fit(lineitem_points(s, d)).out_of_bag_error(), "error")


QUERIES = {"model_bagging": bagged_means, "model_bagging_oob": bagged_error,
           "model_cross_validate": lambda s, d: M.cross_validate(M.Majority(), lineitem_points(s, d), 5),
           "clf_tree": tree, "clf_random_forest": forest, "forest_oob_error": forest_error, "score_rf_permutation": permutation}


def _listed(template: str, joint: str = ", ") -> str:
    return joint.join(template.format(a=a) for a in range(DIMS))


def _copies(bag: str, seed: int = 1) -> str:
    u = f"(cast('0x' || substr(md5(cast(id as varchar) || '|{seed}:bag:' || {bag}), 1, 13) as bigint) / 4503599627370496.0::double)"
    return "(" + " + ".join(f"({u} >= {c!r}::double)::int" for c in T.COPIES) + ")::bigint"


def grown_sql(trees: int, depth: int, attributes: int, bags: bool, seed: int = 1) -> str:
    """CTEs up to `said` (tree, id, label, w, predicted)."""
    sizes = T.try_sizes(DIMS, attributes)
    w = _copies("tree", seed) if bags else "1::bigint"
    parts = [f"{LI}, r0 AS (SELECT tree, id, label, {_listed('f{a}')}, {w} AS w, 1::bigint AS node FROM li, range({trees}) t(tree))"]
    u = lambda key, tail: f"(cast('0x' || substr(md5({key} || '|{seed}:' || tree || ':' || node || ':' || {tail}), 1, 13) as bigint) / 4503599627370496.0::double)"
    parts.append(f"s0 AS (SELECT tree, node, label, sum(w)::bigint AS n, {_listed('sum(w * f{a}) AS s{a}')} FROM r0 WHERE w > 0 GROUP BY ALL)")
    for k in range(depth + 1):
        last = "true" if k == depth else "false"
        parts.append(f"""d{k} AS (SELECT tree, node, CASE WHEN count(*) = 1 THEN min(label) WHEN {last} THEN arg_min(label, struct_pack(a := -n, b := label)) END AS leaf,
          arg_min(label, struct_pack(a := {u('label', "'leaf'")}, b := label)) AS drawn, {_listed('arg_min(s{a}, label) / arg_min(n, label) AS z{a}')},
          {_listed('(sum(s{a}) - arg_min(s{a}, label)) / (sum(n) - arg_min(n, label)) AS e{a}')} FROM s{k} GROUP BY tree, node)""")
        if k == depth:
            break
        picks = " UNION ALL ".join(f"SELECT *, {size} AS size, {i} AS try FROM d{k} WHERE leaf IS NULL" for i, size in enumerate(sizes))
        parts.append(f"""m{k} AS MATERIALIZED (SELECT tree, node, try, {_listed('max((a = {a} AND place <= size)::int) AS m{a}')} FROM (
          SELECT tree, node, try, size, a, row_number() OVER (PARTITION BY tree, node, try ORDER BY {u('a', 'try')}, a) AS place FROM ({picks}), range({DIMS}) x(a)) GROUP BY ALL)""")
        parts.append(f"""q{k} AS MATERIALIZED (SELECT r.*, m.try, (({_listed('m{a} * abs(f{a} - z{a})', ' + ')}) > ({_listed('m{a} * abs(f{a} - e{a})', ' + ')}))::int AS side
          FROM r{k} r JOIN d{k} d USING (tree, node) JOIN m{k} m USING (tree, node))""")
        parts.append(f"c{k} AS MATERIALIZED (SELECT tree, node, min(try) AS try FROM (SELECT tree, node, try FROM q{k} WHERE w > 0 GROUP BY ALL HAVING min(side) < max(side)) GROUP BY ALL)")
        parts.append(f"r{k + 1} AS MATERIALIZED (SELECT tree, id, label, {_listed('f{a}')}, w, 2 * node + side AS node FROM q{k} JOIN c{k} USING (tree, node, try))")
        parts.append(f"s{k + 1} AS MATERIALIZED (SELECT tree, node, label, sum(w)::bigint AS n, {_listed('sum(w * f{a}) AS s{a}')} FROM r{k + 1} WHERE w > 0 GROUP BY ALL)")
    # A row's tree answers where it stops: at a leaf, or at a node that no try parted.
    stops = " UNION ALL ".join(f"SELECT r.tree, id, label, w, coalesce(leaf, drawn) AS predicted FROM r{k} r JOIN d{k} USING (tree, node)"
                               + (f" LEFT JOIN c{k} c USING (tree, node) WHERE leaf IS NOT NULL OR c.try IS NULL" if k < depth else "") for k in range(depth + 1))
    return "WITH " + ", ".join(parts) + f", said AS ({stops})"


_TOP = "SELECT {by}, arg_min(predicted, struct_pack(a := -n, b := predicted)) AS predicted, max(n) / sum(n)::double AS share FROM (SELECT {by}, predicted, count(*) AS n FROM said {where} GROUP BY ALL) GROUP BY ALL"

_BAG = f"""WITH {LI}, rw AS (SELECT tree, id, label, f0, f1, f2, f3, {_copies('tree')} AS w FROM li, range(4) t(tree)),
  mn AS (SELECT tree, label AS l, {_listed('sum(w * f{a}) / sum(w) AS m{a}')} FROM rw WHERE w > 0 GROUP BY ALL),
  said AS (SELECT rw.tree, id, label, any_value(w) AS w, arg_min(l, struct_pack(d := {_listed('pow(f{a} - m{a}, 2)', ' + ')}, l := l)) AS predicted FROM rw JOIN mn USING (tree) GROUP BY ALL)"""

ORACLES = {
    "model_bagging": f"{_BAG} SELECT id, predicted, {sr('share')} AS share FROM ({_TOP.format(by='id', where='')})",
    "model_bagging_oob": f"{_BAG} SELECT count(*) AS tested, {sr('avg((predicted <> label)::int)')} AS error FROM ({_TOP.format(by='id, label', where='WHERE w = 0')})",
    "model_cross_validate": f"""WITH {LI}, ps AS (SELECT label, (row_number() OVER (ORDER BY {su('id', '1')}, id) - 1) % 5 AS fold FROM li),
      ct AS (SELECT k.fold, label, count(*) AS n FROM ps JOIN range(5) k(fold) ON ps.fold <> k.fold GROUP BY ALL),
      tp AS (SELECT fold, arg_min(label, struct_pack(a := -n, b := label)) AS predicted FROM ct GROUP BY 1), pr AS (SELECT label, predicted FROM ps JOIN tp USING (fold)),
      k AS (SELECT DISTINCT label FROM pr)
      SELECT k.label, sum((pr.label = k.label AND predicted = k.label)::int)::bigint AS tp, sum((pr.label <> k.label AND predicted = k.label)::int)::bigint AS fp,
        sum((pr.label <> k.label AND predicted <> k.label)::int)::bigint AS tn, sum((pr.label = k.label AND predicted <> k.label)::int)::bigint AS fn FROM k, pr GROUP BY 1""",
    "clf_tree": f"{grown_sql(1, 4, 2, False)} SELECT id, label, predicted FROM said",
    "clf_random_forest": f"{grown_sql(3, 3, 2, True)} SELECT id, label, predicted, {sr('share')} AS share FROM ({_TOP.format(by='id, label', where='')})",
    "forest_oob_error": f"{grown_sql(3, 3, 2, True)} SELECT count(*) AS tested, {sr('avg((predicted <> label)::int)')} AS error FROM ({_TOP.format(by='id, label', where='WHERE w = 0')})",
}
