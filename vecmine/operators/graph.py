"""Connected components and Markov clustering on edge lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import collect_bounded, cut_lineage, narrowed, release_unused, settle_small
from .pairs import batch_of, map_batches, with_parts


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component = smallest id reachable) by alternating large-star and small-star rounds, until only stars are left.

    `edges` is (src, dst), `nodes` is (id). Each round keeps at most one edge per old edge and node; groups are only
    ever reduced to a minimum, so a hub costs no more than its edges.
    """
    spark = edges.sparkSession
    state = cut_lineage(edges.where("src <> dst").select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    while True:
        rows = state.count()
        state = narrowed(state, rows)
        # A star forest: no node above has two below it, and none is both above and below another.
        roles = F.explode(F.array(F.struct(F.col("u").alias("w"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                                  F.struct(F.col("v").alias("w"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
        seen = state.select(roles.alias("r")).select("r.*").groupBy("w").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not rows or seen.where("up > 1 OR (up > 0 AND down > 0)").isEmpty():
            break
        # Large star: every neighbour above u is linked to the smallest node around u.
        ends = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
        both = state.select(ends.alias("e")).select("e.*")
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = narrowed(cut_lineage(large.where("u <> v")), rows)
        # Small star: u and its neighbours below are linked to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = cut_lineage(down.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        del both, low, large, down, seen
        release_unused(spark)
    stars = state.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.select("id").join(stars, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


# ---- Markov clustering ---------------------------------------------------------------------------

def _divided(m: DataFrame, total: DataFrame) -> DataFrame:
    return m.join(total, "src").select("src", "dst", (F.col("w") / F.col("_t")).alias("w"))


def row_normalize(m: DataFrame) -> DataFrame:
    """(src, dst, w) with every row of weights summing to one."""
    m = cut_lineage(m)
    total, _ = settle_small(m.groupBy("src").agg(F.sum("w").alias("_t")), 16)  # a row per node, so entries need not be shuffled
    return _divided(m, total)


# A matrix of pairs of nodes is written to the checkpoint folder up to so many entries.
KEPT_ENTRIES = 10_000_000
# Products of more single terms than this are worth another pass that may leave some of them out.
FEW_TERMS = 20_000_000
# Rows a task gathers before it sums them.
HELD_ROWS = 1 << 19
_ENTRY = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("w", pa.float64())])
_ENTRY_DDL = "src long, dst long, w double"


def _gathered(batches, rows: int = HELD_ROWS):
    """Tables of about `rows` rows."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            yield pa.Table.from_batches(held)
            held, count = [], 0
    if count:
        yield pa.Table.from_batches(held)


def _summed(parts: pa.Table, keys: list[str], *aggs: tuple[str, str]) -> pa.Table:
    got = parts.group_by(keys, use_threads=False).aggregate(list(aggs))
    return got.select(keys + [f"{c}_{f}" for c, f in aggs])


class _ByNode:
    """Numbers of nodes, shipped once: `at(ids)` gives their places in `ids`, or the place after the last for other ids."""

    def __init__(self, ids: np.ndarray, **values: np.ndarray):
        order = np.argsort(ids)
        self.ids, self.n = ids[order], len(ids)
        self.values = {k: np.append(v[order], np.zeros(1, v.dtype)) for k, v in values.items()}
        self.place = None
        if self.n and int(self.ids[-1]) - int(self.ids[0]) < 8 * self.n:
            self.place = np.full(int(self.ids[-1]) - int(self.ids[0]) + 1, self.n, dtype=np.int32)
            self.place[self.ids - self.ids[0]] = np.arange(self.n)

    def at(self, ids: pa.ChunkedArray) -> np.ndarray:
        known = np.asarray(ids.is_valid()) if ids.null_count else None
        x = np.asarray(ids.fill_null(0) if ids.null_count else ids)
        if not self.n:
            return np.zeros(len(x), dtype=np.int64)
        if self.place is not None:
            gap = x - self.ids[0]
            ok = (x >= self.ids[0]) & (x <= self.ids[-1])
            out = self.place[np.where(ok, gap, 0)]
            out = out if ok.all() else np.where(ok, out, self.n)
        else:
            out = np.searchsorted(self.ids, x)
            out[self.ids[np.minimum(out, self.n - 1)] != x] = self.n
        return out if known is None else np.where(known, out, self.n)


def _shipped(df: DataFrame, row_bytes: int):
    """Rows (id, ...) of `df` as a broadcast `_ByNode`, or None where they are too many to ship. Ids are unique and not null."""
    rows = collect_bounded(df, row_bytes)
    if rows is None:
        return None
    cols = {c: np.array([r[c] for r in rows]) for c in df.columns}
    return df.sparkSession.sparkContext.broadcast(_ByNode(cols.pop("id").astype(np.int64), **cols))


def transition_matrix(edges: DataFrame, nodes: DataFrame, loop: float = 1.0, once: bool = False) -> DataFrame:
    """Symmetric edges (src < dst) plus self loops, row-normalised; one entry per pair of nodes.

    `once`: `edges` gives each pair of rows of `nodes` at most once and no weight is null, as in `similarity_edges`, so that only
    pairs with a repeated id can repeat. A matrix of more than `KEPT_ENTRIES` is then not kept: its entries are far more than the
    nodes, and who reads it reads the edges again.
    """
    two = F.array(F.struct("src", "dst", "w"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    both = edges.select(F.explode(two).alias("e")).select("e.*")
    loops = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(float(loop)).alias("w"))
    if not once:
        return row_normalize(both.unionByName(loops).groupBy("src", "dst").agg(F.sum("w").alias("w")))

    def ends(batches):
        for t in _gathered(batches):
            ids = pa.chunked_array(t.column("src").chunks + t.column("dst").chunks)
            w = pa.chunked_array(t.column("w").chunks * 2)
            yield from _summed(pa.table({"id": ids, "w": w}), ["id"], ("w", "sum"), ("w", "count")).to_batches()

    parts = map_batches(edges, ends, "id long, t double, n long").union(nodes.select("id", F.lit(float(loop)), F.lit(1).cast("long")))
    total = cut_lineage(parts.groupBy("id").agg(F.sum("t").alias("t"), F.sum("n").alias("n")))
    entries = total.agg(F.sum("n")).first()[0] or 0
    odd = cut_lineage(nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL").select("id"))
    plain = odd.isEmpty()
    ship = _shipped(total.select("id", "t"), 16) if plain else None
    release_unused(nodes.sparkSession)
    if ship is not None:
        def entry(batches):
            for batch in batches:
                t = pa.Table.from_batches([batch])
                by, w = ship.value, np.asarray(batch.column("w"))
                src, dst = t.column("src"), t.column("dst")
                for one, other in ((src, dst), (dst, src)):
                    yield batch_of(_ENTRY, one.combine_chunks(), other.combine_chunks(), w / by.values["t"][by.at(one)])

        def alone(batches):
            for batch in batches:
                t = pa.Table.from_batches([batch])
                w = np.asarray(batch.column("w")) / ship.value.values["t"][ship.value.at(t.column("src"))]
                yield batch_of(_ENTRY, batch.column("src"), batch.column("dst"), w)

        m = with_parts(map_batches(edges, entry, _ENTRY_DDL).__dict__["_parts"] + [(loops, alone)], _ENTRY_DDL)
    else:
        parts = both.unionByName(loops)
        if not plain:
            twice, _ = settle_small(odd.withColumn("_r", F.lit(True)), 16)
            for end in ("src", "dst"):
                parts = parts.join(twice.select(F.col("id").alias(end), F.col("_r").alias(f"_{end}")), end, "left")
            single = F.isnull("_src") & F.isnull("_dst") & F.isnotnull("dst")
            summed = parts.where(~single).groupBy("src", "dst").agg(F.sum("w").alias("w"))
            parts = parts.where(single).select("src", "dst", "w").unionByName(summed)
        m = _divided(parts, settle_small(total.select(F.col("id").alias("src"), F.col("t").alias("_t")), 16)[0])
    return cut_lineage(m) if entries <= KEPT_ENTRIES else m


def _by_ends(m: DataFrame, of_row, of_col, stats: tuple[str, ...]) -> DataFrame:
    """(id, row, *stats): statistics of the values that entries give to their row and to their column (functions of a table of
    entries), in one pass over the entries. Null values give nothing."""
    def run(batches):
        for t in _gathered(batches):
            for row, key, value in ((True, "src", of_row), (False, "dst", of_col)):
                v = value(t)
                if v is not None:
                    own = pa.table({"id": t.column(key), "v": v, "sq": pc.multiply(v, v)})
                    got = _summed(own, ["id"], ("v", "count"), ("v", "max"), ("v", "sum"), ("sq", "sum"))
                    got = got.append_column("row", pa.array(np.full(len(got), row)))
                    yield from got.select(["id", "row", "v_count", "v_max", "v_sum", "sq_sum"]).to_batches()

    parts = map_batches(m, run, "id long, row boolean, n long, top double, sum double, sq double")
    how = {"n": F.sum("n"), "top": F.max("top"), "sum": F.sum("sum"), "norm": F.sqrt(F.sum("sq"))}
    return cut_lineage(parts.groupBy("id", "row").agg(*[how[s].alias(s) for s in stats]))


def _within_reach(m: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Entries in the rows and in the columns of `m` that can give M * M an entry of `least` or more; no other entry can be needed.

    An entry is a row times a column, so neither the row's sum times the column's maximum nor the product of their norms is below it;
    nor is the row's sum of weights times the largest weight that each of them can meet. Only sums by node leave a pass over `m`,
    which need not be kept.
    """
    def size(t: pa.Table):
        return pc.abs(t.column("w"))

    stats = _by_ends(m, size, size, ("n", "top", "sum", "norm"))
    release_unused(m.sparkSession)
    least *= 1 - 1e-9  # sums are rounded
    most = {r["row"]: r for r in stats.groupBy("row").agg(F.max("sum").alias("sum"), F.max("norm").alias("norm")).collect()}
    if len(most) < 2:
        return m, m

    def able(row: bool) -> DataFrame:
        other = most[not row]
        reach = F.least(F.col("top") * other["sum"], F.col("norm") * other["norm"])
        return stats.where((F.col("row") == row) & F.isnotnull("id")).select("id", "n", "top", (reach >= least).alias("able"))

    rows, cols = able(True), able(False)
    of_rows, of_cols = rows.where("able").select("id"), cols.where("able").select("id")
    if of_rows.isEmpty() or of_cols.isEmpty():
        return m.where(F.lit(False)), m.where(F.lit(False))
    terms = cols.select("id", "n").join(rows.select("id", F.col("n").alias("k")), "id").agg(F.sum(F.col("n").cast("double") * F.col("k"))).first()[0]
    if terms is not None and terms > FEW_TERMS:
        marks = rows.select("id", F.col("able").alias("row_able"), F.col("top").alias("row_top")).join(
            cols.select("id", F.col("able").alias("col_able"), F.col("top").alias("col_top")), "id", "full")
        ship = _shipped(marks.na.fill(False).na.fill(0.0), 32)
        if ship is not None:
            def meets(key: str, other: str, side: str, facing: str):
                def value(t: pa.Table):
                    by = ship.value
                    used = by.values[f"{side}_able"][by.at(t.column(key))]
                    if used.any():
                        v = np.abs(np.asarray(t.column("w"))) * by.values[f"{facing}_top"][by.at(t.column(other))]
                        return pa.array(v, mask=~used)
                return value

            best = _by_ends(m, meets("src", "dst", "row", "row"), meets("dst", "src", "col", "col"), ("sum",))
            of_rows, of_cols = (best.where((F.col("row") == row) & (F.col("sum") >= least)).select("id") for row in (True, False))
            release_unused(m.sparkSession)
    left, right = (_shipped(ids, 16) for ids in (of_rows, of_cols))
    if left is None or right is None:
        left, right = (m.join(ids.withColumnRenamed("id", key), key, "left_semi") for ids, key in ((of_rows, "src"), (of_cols, "dst")))
        return left.select("src", "dst", "w"), right.select("src", "dst", "w")

    def near(batches):
        for t in _gathered(batches):
            t = t.select(["src", "dst", "w"])
            marks = [by.value.at(t.column(key)) < by.value.n for by, key in ((left, "src"), (right, "dst"))]
            for name, mark in zip(("_left", "_right"), marks):
                t = t.append_column(name, pa.array(mark))
            yield from t.filter(pa.array(marks[0] | marks[1])).to_batches()

    met = cut_lineage(map_batches(m, near, f"{_ENTRY_DDL}, _left boolean, _right boolean"))
    return met.where("_left").drop("_left", "_right"), met.where("_right").drop("_left", "_right")


def expand_inflate(m: DataFrame, power: float = 2.0, max_zero: float = 0.001) -> DataFrame:
    """One step: M * M, entries to the power, entries below `max_zero` dropped, rows normalised. `m` has one entry per (src, dst)."""
    left, right = _within_reach(m, max_zero ** (1 / power)) if power > 0 and max_zero > 0 else (m, m)
    right = right.select(F.col("src").alias("dst"), F.col("dst").alias("to"), F.col("w").alias("w2"))
    squared = left.select("src", "dst", "w").join(right, "dst").groupBy("src", F.col("to")).agg(F.sum(F.col("w") * F.col("w2")).alias("w"))
    powered = squared.select("src", F.col("to").alias("dst"), F.pow("w", F.lit(float(power))).alias("w"))
    return row_normalize(powered.where(F.abs("w") >= F.lit(float(max_zero))))


def mcl(m: DataFrame, power: float = 2.0, max_zero: float = 0.001, residual: float = 0.001, most_steps: int = 100) -> DataFrame:
    """(id, prediction) from a transition matrix, stepping until every row is concentrated or evenly split.

    Attractors are the nodes that keep weight on themselves; attractors holding each other form one cluster, named by
    its smallest node. A node joins its heaviest attractor; nodes without one stay alone.
    """
    for _ in range(most_steps):
        m = cut_lineage(expand_inflate(m, power, max_zero))
        chaos = m.groupBy("src").agg((F.max("w") - F.sum(F.col("w") * F.col("w"))).alias("r")).agg(F.max("r")).first()[0]
        if chaos is None or chaos <= residual:
            break
    heavy = m.where(F.col("w") > max_zero)
    centres = heavy.where("src = dst").select(F.col("src").alias("id"))
    among = heavy.join(centres.withColumnRenamed("id", "dst"), "dst")
    links = among.join(centres.withColumnRenamed("id", "src"), "src").select("src", "dst")
    names = connected_components(links, centres).withColumnRenamed("id", "dst")
    member = among.groupBy("src").agg(F.min_by("dst", F.struct(-F.col("w"), F.col("dst"))).alias("dst"))
    named = member.join(names, "dst").select("src", F.col("component").alias("prediction"))
    return m.select("src").distinct().join(named, "src", "left").select(
        F.col("src").alias("id"), F.coalesce("prediction", "src").alias("prediction"))
