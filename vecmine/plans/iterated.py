"""SQL twins of iterative and multi-step queries: Lloyd steps and farthest-first as recursive SQL, dependent Bayes, rank ensembles,
a matrix inverse and a chi-square tail written out."""

from __future__ import annotations

from itertools import permutations

from .common import EMB, LI, sr

_HEX = "4503599627370496.0::double"


def _u(text: str) -> str:
    return f"(cast('0x' || substr(md5({text}), 1, 13) as bigint) / {_HEX})"


_LI4 = f"{LI}, pt AS (SELECT id, [f0, f1, f2, f3] AS f FROM li)"
_LI3 = f"{LI}, pt AS (SELECT id, [f0, f2, f3] AS f FROM li)"
_E64 = f"{EMB}, pt AS (SELECT id, f FROM emb)"


def lloyd_sql(points: str, dims: int, runs: list[tuple[int, int, int]]) -> str:
    """CTEs up to `fin` (k, repeat, id, prediction) for runs (k, repeat, seed): centres start and restart at hashed places of the box."""
    rows = ", ".join(f"({k}, {r}, {seed})" for k, r, seed in runs)
    place = _u("c || '-' || a || '|' || seed || '-' || {it}")
    at = f"list(lo[a + 1] + {place} * (hi[a + 1] - lo[a + 1]) ORDER BY a)"
    return f"""WITH RECURSIVE {points}, bx AS (SELECT list(lo ORDER BY a) AS lo, list(hi ORDER BY a) AS hi FROM (SELECT a, min(f[a + 1]) AS lo, max(f[a + 1]) AS hi FROM pt, range({dims}) t(a) GROUP BY a)),
      rn(k, repeat, seed) AS (VALUES {rows}),
      st AS (SELECT k, repeat, seed, list(p ORDER BY c) AS m FROM (SELECT k, repeat, seed, c, {at.format(it=0)} AS p FROM rn, range(k) t(c), range({dims}) u(a), bx GROUP BY ALL) GROUP BY ALL),
      ll AS (SELECT k, repeat, seed, 0 AS it, m, 1e300::double AS gap FROM st
        UNION ALL
        SELECT k, repeat, seed, it, list(p ORDER BY c) AS m, max(g) AS gap FROM (
          SELECT x.k, x.repeat, x.seed, x.it, x.c, coalesce(s.p, x.p) AS p, list_distance(coalesce(s.p, x.p), x.old) AS g FROM
            (SELECT k, repeat, seed, it + 1 AS it, c, any_value(m[c + 1]) AS old, {at.format(it='(it + 1)')} AS p FROM ll, range(k) t(c), range({dims}) u(a), bx WHERE gap > 1e-4 AND it < 100 GROUP BY ALL) x
            LEFT JOIN (SELECT k, repeat, c, list(v ORDER BY a) AS p FROM (
                SELECT k, repeat, c, a, avg(f[a + 1]) AS v FROM (
                  SELECT k, repeat, f, list_position(ds, list_min(ds)) - 1 AS c FROM (SELECT k, repeat, f, list_transform(m, lambda q: list_distance(q, f)) AS ds FROM ll, pt WHERE gap > 1e-4 AND it < 100)), range({dims}) u(a) GROUP BY ALL) GROUP BY ALL) s
            ON s.k = x.k AND s.repeat = x.repeat AND s.c = x.c) GROUP BY ALL),
      ls AS (SELECT k, repeat, arg_max(m, it) AS m FROM ll GROUP BY ALL),
      fin AS (SELECT k, repeat, id, f, list_position(ds, list_min(ds)) - 1 AS prediction FROM (SELECT k, repeat, id, f, list_transform(m, lambda q: list_distance(q, f)) AS ds FROM ls, pt))"""


def _scored(key: str, dims: int) -> str:
    """Score of every clustering in `fin` and whether it is the best, the first one on ties."""
    order = key.replace(" ", "").split(",")
    return f"""ms AS (SELECT {key}, prediction, a, avg(f[a + 1]) AS v FROM fin, range({dims}) t(a) GROUP BY ALL), mm AS (SELECT {key}, prediction, list(v ORDER BY a) AS mu FROM ms GROUP BY ALL),
      sc AS (SELECT {key}, 2 * sum(pow(list_distance(f, mu), 2)) AS s FROM fin JOIN mm USING ({key}, prediction) GROUP BY ALL)
      SELECT {", ".join(f"{c}::int AS {c}" for c in order)}, {sr('s')} AS score, row_number() OVER (ORDER BY round(s, 9), {key}) = 1 AS best FROM sc"""


def _traversal(k: int) -> str:
    """Farthest-first centres one after the other, with the distance of every point to the nearest so far."""
    parts = [f"WITH {_E64}, g1 AS (SELECT id, f, list_distance(f, (SELECT f FROM pt WHERE id = 0)) AS g FROM pt), h1 AS (SELECT id, f, g, 0 AS p FROM g1)"]
    for i in range(2, k + 1):
        parts.append(f"n{i} AS (SELECT f AS nf FROM h{i - 1} ORDER BY g DESC, id LIMIT 1), h{i} AS MATERIALIZED (SELECT id, f, least(g, d) AS g, CASE WHEN d < g THEN {i - 1} ELSE p END AS p FROM (SELECT h{i - 1}.*, list_distance(f, nf) AS d FROM h{i - 1}, n{i}))")
    fin = " UNION ALL ".join(f"SELECT {i} AS k, id, f, p AS prediction FROM h{i}" for i in range(2, k + 1))
    return ", ".join(parts) + f", fin AS ({fin})"


def _minor(c, skip_row: int, skip_col: int) -> str:
    rows, cols = [r for r in range(4) if r != skip_row], [x for x in range(4) if x != skip_col]
    terms = []
    for p in permutations(range(3)):
        odd = sum(p[i] > p[j] for i in range(3) for j in range(i + 1, 3)) % 2
        terms.append(("-" if odd else "+") + " * ".join(c(rows[i], cols[p[i]]) for i in range(3)))
    return "(" + " ".join(terms) + ")"


def mahalanobis_sql() -> str:
    c = lambda i, j: f"c{min(i, j)}{max(i, j)}"
    cov = ", ".join(f"covar_samp(f{i}, f{j}) AS c{i}{j}" for i in range(4) for j in range(i, 4))
    means = ", ".join(f"avg(f{i}) AS m{i}" for i in range(4))
    det = " + ".join(f"{'-' if j % 2 else ''}{c(0, j)} * {_minor(c, 0, j)}" for j in range(4))
    inv = ", ".join(f"{'-' if (i + j) % 2 else ''}{_minor(c, j, i)} / ({det}) AS v{i}{j}" for i in range(4) for j in range(4))
    form = " + ".join(f"v{i}{j} * (f{i} - m{i}) * (f{j} - m{j})" for i in range(4) for j in range(4))
    return f"WITH {LI}, cv AS (SELECT {cov}, {means} FROM li), iv AS (SELECT {inv}, m0, m1, m2, m3 FROM cv) SELECT id, {sr(f'sqrt({form})')} AS dist FROM li, iv"


_KDB = f"""WITH {LI}, d3 AS (SELECT id, label, unnest([0, 1, 2]) AS attr, unnest([f0, f2, f3]) AS v FROM li), N AS (SELECT count(*)::double AS n FROM li),
  nc AS (SELECT label, count(*)::double AS n FROM li GROUP BY 1),
  ma AS (SELECT attr, sum(c / n * log10(c / n)) AS s FROM (SELECT attr, v, label, count(*) AS c FROM d3 GROUP BY ALL), N GROUP BY 1),
  mb AS (SELECT attr, sum(c / n * log10(c / n)) AS s FROM (SELECT attr, v, count(*) AS c FROM d3 GROUP BY ALL), N GROUP BY 1),
  pl AS (SELECT attr, row_number() OVER (ORDER BY ma.s - mb.s DESC, attr) AS place FROM ma JOIN mb USING (attr)),
  one AS (SELECT attr, sum(c / n * log10(c / n)) AS s FROM (SELECT attr, v, label, count(*) AS c FROM d3 GROUP BY ALL) JOIN nc USING (label) GROUP BY 1),
  two AS (SELECT a1, a2, sum(c / n * log10(c / n)) AS s FROM (SELECT x.attr AS a1, x.v AS v1, y.attr AS a2, y.v AS v2, x.label, count(*) AS c FROM d3 x JOIN d3 y ON x.id = y.id AND x.attr <> y.attr GROUP BY ALL) JOIN nc USING (label) GROUP BY 1, 2),
  pa AS (SELECT a1 AS attr, arg_min(a2, struct_pack(a := -(two.s - p.s - q.s), b := a2)) AS parent FROM two JOIN one p ON p.attr = a1 JOIN one q ON q.attr = a2
    JOIN pl x ON x.attr = a1 JOIN pl y ON y.attr = a2 WHERE x.place > y.place AND two.s - p.s - q.s > 0 GROUP BY 1),
  ky AS (SELECT d3.*, u.v AS up FROM d3 LEFT JOIN pa USING (attr) LEFT JOIN d3 u ON u.id = d3.id AND u.attr = pa.parent),
  nv AS (SELECT attr, count(DISTINCT v) AS nv FROM d3 GROUP BY 1),
  cell AS (SELECT DISTINCT attr, v, up FROM ky), cn AS (SELECT attr, v, up, label, count(*)::double AS n FROM ky GROUP BY ALL), cd AS (SELECT attr, up, label, count(*)::double AS n FROM ky GROUP BY ALL),
  lk AS (SELECT c.attr, c.v, c.up, nc.label, log2((coalesce(cn.n, 0) + 1) / (coalesce(cd.n, 0) + nv)) AS s FROM cell c JOIN nv USING (attr) CROSS JOIN nc
    LEFT JOIN cn ON cn.attr = c.attr AND cn.v = c.v AND cn.up IS NOT DISTINCT FROM c.up AND cn.label = nc.label
    LEFT JOIN cd ON cd.attr = c.attr AND cd.up IS NOT DISTINCT FROM c.up AND cd.label = nc.label),
  sc AS (SELECT ky.id, lk.label, sum(s) + max(log2(nc.n / (SELECT n FROM N))) AS s FROM ky JOIN lk ON lk.attr = ky.attr AND lk.v = ky.v AND lk.up IS NOT DISTINCT FROM ky.up JOIN nc ON nc.label = lk.label GROUP BY 1, 2)
  SELECT id, label, {sr('s')} AS score, {sr('row_number() OVER (PARTITION BY id ORDER BY s, label) * 33.0::double')} AS percentage FROM sc"""

_ENSEMBLE = f"""WITH {LI}, ps AS (SELECT *, row_number() OVER (ORDER BY {_u("id || '|1:pos'")}, id) - 1 AS pos FROM li),
  dr AS (SELECT bag, draw, CAST(floor({_u("draw || '|1:' || bag")} * (SELECT count(*) FROM li)) AS BIGINT) AS pos FROM range((SELECT count(*) FROM li)) t(draw), range(2) b(bag)),
  bl AS (SELECT bag, label, unnest([0, 1, 2, 3]) AS attr, unnest([f0, f1, f2, f3]) AS v FROM dr JOIN ps USING (pos)),
  bx AS (SELECT bag, attr, min(v) AS lo, max(v) AS hi FROM bl GROUP BY ALL),
  ct AS (SELECT bag, attr, trunc((v - lo) / (hi - lo) * 9.0) AS b, label, count(*)::double AS n FROM bl JOIN bx USING (bag, attr) GROUP BY ALL),
  h AS (SELECT bag, attr, sum(n * log2(n)) AS cell, sum(n) AS t FROM ct GROUP BY ALL),
  hr AS (SELECT bag, attr, sum(n * log2(n)) AS r FROM (SELECT bag, attr, b, sum(n) AS n FROM ct GROUP BY ALL) GROUP BY ALL),
  hc AS (SELECT bag, attr, sum(n * log2(n)) AS c FROM (SELECT bag, attr, label, sum(n) AS n FROM ct GROUP BY ALL) GROUP BY ALL),
  e AS (SELECT bag, attr, (t * log2(t) - c) - (r - cell) AS gain, t * log2(t) - r AS hr, t * log2(t) - c AS hc FROM h JOIN hr USING (bag, attr) JOIN hc USING (bag, attr)),
  rk AS (SELECT attr, row_number() OVER (PARTITION BY bag ORDER BY CASE WHEN bag = 0 THEN gain / hr ELSE 2 * gain / (hr + hc) END DESC, attr) - 1 AS rank FROM e),
  tt AS (SELECT attr, sum(rank)::bigint AS total FROM rk GROUP BY 1)
  SELECT CAST(attr AS INTEGER) AS attr, total, CAST(row_number() OVER (ORDER BY total, attr) - 1 AS INTEGER) AS rank FROM tt"""

_CHI = f"""WITH n AS (SELECT o_orderpriority AS r, o_orderstatus AS c, count(*)::double AS n FROM orders GROUP BY ALL),
  tr AS (SELECT r, sum(n) AS nr FROM n GROUP BY 1), tc AS (SELECT c, sum(n) AS nc FROM n GROUP BY 1), tt AS (SELECT sum(n) AS t FROM n),
  st AS (SELECT sum(pow(coalesce(n, 0) - nr * nc / t, 2) / (nr * nc / t)) AS x, (count(DISTINCT r) - 1) * (count(DISTINCT c) - 1) AS df FROM tr CROSS JOIN tc CROSS JOIN tt LEFT JOIN n USING (r, c))
  SELECT {sr('x')} AS statistic, df, {sr('exp(-x / 2) * list_sum(list_transform(range(df // 2), lambda k: pow(x / 2, k) / factorial(k::int)))')} AS p_value FROM st"""

ORACLES = {
    "kmeans": f"{lloyd_sql(_LI4, 4, [(4, 0, 1)])} SELECT prediction, count(*) AS n FROM fin GROUP BY 1",
    "clusterize_files": f"{lloyd_sql(_LI4, 4, [(4, 0, 1)])} SELECT prediction, count(*) AS n FROM fin GROUP BY 1",
    "clusterize": f"{lloyd_sql(_LI3, 3, [(3, 0, 1)])} SELECT id, prediction FROM fin",
    "kmeans_best_of": f"{lloyd_sql(_E64, 64, [(3, r, 1 + r) for r in range(3)])}, {_scored('k, repeat', 64)}",
    "kmeans_select_k": f"{lloyd_sql(_E64, 64, [(k, 0, 1) for k in range(2, 7)])}, {_scored('k, repeat', 64)}",
    "farthest_first_select_k": f"{_traversal(5)}, {_scored('k', 64)}",
    "clf_kdb": _KDB,
    "rank_ensemble": _ENSEMBLE,
    "dist_mahalanobis": mahalanobis_sql(),
    "chi_square_test": _CHI,
}
