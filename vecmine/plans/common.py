"""Shared pieces of the query catalogue: rounding and the oracle's views of the test tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r(c, digits: int = 6) -> Column:
    """Rounded half up in plain double arithmetic: stays in generated code, and SQL can repeat it exactly."""
    c = F.col(c) if isinstance(c, str) else c
    scale = F.lit(10.0 ** digits)
    return F.floor(c * scale + F.lit(0.5)) / scale


def rounded(df, *names: str, digits: int = 6):
    return df.withColumns({n: r(n, digits) for n in names})


def sr(expr: str, digits: int = 6) -> str:
    """SQL twin of `r`."""
    return f"(floor(({expr})::double * 1e{digits}::double + 0.5::double) / 1e{digits}::double)"


def su(id_expr: str, seed: str) -> str:
    """SQL twin of hash_uniform."""
    return f"(cast('0x' || substr(md5(cast({id_expr} as varchar) || '|{seed}'), 1, 13) as bigint) / 4503599627370496.0::double)"


EMB = "emb AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS f, CAST(label AS BIGINT) AS c FROM embeddings)"
EMBL = EMB + ", embl AS (SELECT id, c, i - 1 AS attr, f[i] AS v FROM (SELECT id, c, f, unnest(range(1, len(f) + 1)) AS i FROM emb))"
SZ = "sz AS (SELECT c, count(*) AS n FROM emb GROUP BY c)"
CENT = ("cl AS (SELECT c, attr, avg(v) AS v FROM embl GROUP BY ALL), "
        "cent AS (SELECT c, list(v ORDER BY attr) AS m FROM cl GROUP BY c)")

LI = ("li AS (SELECT cast('0x' || substr(md5(l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey || '|' "
      "|| strftime(l_shipdate, '%Y-%m-%d')), 1, 15) as bigint) AS id, l_returnflag AS label, "
      "cast(ascii(l_returnflag) as bigint) AS c, l_quantity AS f0, l_extendedprice AS f1, l_discount AS f2, l_tax AS f3 FROM lineitem)")
LIL = LI + (", lil AS (SELECT id, label, c, unnest([0, 1, 2, 3]) AS attr, unnest([f0, f1, f2, f3]) AS v FROM li)")


def each(template: str, dims: int = 4) -> str:
    """`template` with {x} = f0.., {i} = 0.. for every attribute."""
    return ", ".join(template.format(x=f"f{i}", i=i) + f" AS f{i}" for i in range(dims))
