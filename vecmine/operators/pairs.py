"""Point x point work as block tiles.

Points are packed, partition by partition, into blocks of bounded size; the blocks are written to the
checkpoint folder; blocks then meet in a grid of tiles by an equi-join on (stripe, stripe). A NumPy kernel
reduces one pair of blocks at a time and emits partial results per point (never the pairs), which ordinary
aggregations finish. No task sees more than one pair of blocks at once, whatever the key distribution.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distances import BOUND, block_distance, measure, with_numbers
from ..session import cut_lineage, parallelism

BLOCK_BYTES = 8 * 1024 * 1024
BLOCK_ROWS = 8192
STRIPE_BYTES = 64 * 1024 * 1024
STRIPE_ROWS = 65536
# Cells of a distance buffer: a kernel holds a dozen such buffers, whatever the number of points.
CHUNK_CELLS = 1 << 19
# Distance work (cells x dimensions) that makes a tile worth a task of its own.
TILE_WORK = 4_000_000
# Bytes of block copies that more tasks than the cores need may cost.
COPY_BYTES = 2 * 1024 ** 3


def matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Arrow list column as an (n, d) matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.zeros((0, 0))
    return np.asarray(col.flatten(), dtype=np.float64).reshape(len(col), -1)


class Block:
    """Columns of one packed block: `ids`, `X` and any further numeric columns by name."""

    def __init__(self, payload: bytes, key: int):
        batch = pa.ipc.open_stream(payload).read_all().combine_chunks()
        self.key = key
        self.ids = np.asarray(batch.column("id"))
        self.X = matrix(batch.column("features"))
        self.cols = {n: np.asarray(batch.column(n)) for n in batch.column_names if n not in ("id", "features")}

    def __len__(self) -> int:
        return len(self.ids)

    def sorted_by(self, order: np.ndarray) -> "Block":
        self.ids, self.X = self.ids[order], self.X[order]
        self.cols = {n: c[order] for n, c in self.cols.items()}
        return self


def shape_of(points: DataFrame) -> tuple[int, int]:
    row = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("d")).first()
    return row["n"], row["d"] or 0


@dataclass(frozen=True)
class TilePlan:
    left_rows: int
    right_rows: int
    left_stripes: int
    right_stripes: int


def plan_tiles(spark, d: int, n: int, m: int | None = None, held: bool = False) -> TilePlan:
    """Block and stripe sizes for n x m points (`m=None`: each unordered pair of n points once).

    `held`: tasks hold what they find from one pair of blocks to the next, so a few per core are better than many.

    Stripes are small enough for one task and numerous enough to keep all cores busy; a side is shuffled
    once per stripe of the other side, so large sides get no more stripes than that, whatever the number of
    shuffle partitions.
    """
    row_bytes = 8 * d + 32
    busy = 3 * spark.sparkContext.defaultParallelism
    work = n * (m if m is not None else n / 2) * max(1, d)
    unit = int(spark.conf.get("spark.vecmine.tileWork", str(TILE_WORK)))
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // row_bytes))
    wanted = max(1, min(4 * busy if held else 3 * parallelism(spark), math.ceil(work / unit)))

    def need(count: int) -> int:
        return max(1, math.ceil(count * row_bytes / STRIPE_BYTES), math.ceil(count / STRIPE_ROWS))

    def afford(asked: int, cores: float, copied: int) -> int:
        """The stripes asked for as far as their copies stay in bounds; in any case enough for the cores."""
        return min(asked, max(math.ceil(cores), COPY_BYTES // max(1, copied * row_bytes)))

    def split(count: int, stripes: int) -> tuple[int, int]:
        rows = max(32, min(most, math.ceil(count / stripes)))
        return rows, max(1, min(stripes, math.ceil(count / rows)))

    if m is None:
        rows, stripes = split(n, max(need(n), afford(math.ceil(math.sqrt(2 * wanted)), math.sqrt(2 * busy), n)))
        return TilePlan(rows, rows, stripes, stripes)
    share = min(1.0, m / max(1, n))
    right_rows, right = split(m, max(need(m), afford(math.ceil(math.sqrt(wanted * share)), math.sqrt(busy * share), n)))
    left_rows, left = split(n, max(need(n), afford(math.ceil(wanted / right), busy / right, m)))
    return TilePlan(left_rows, right_rows, left, right)


def _halved(table: pa.Table) -> pa.Table:
    """Features in single precision where that loses nothing, as in vectors that were read as floats: half the bytes to copy."""
    at, col = table.column_names.index("features"), table.column("features").combine_chunks()
    if not pa.types.is_list(col.type) or col.null_count or len(col) == 0:
        return table
    cells = col.flatten()
    if cells.null_count or not pa.types.is_float64(cells.type):
        return table
    exact = np.asarray(cells)
    with np.errstate(over="ignore", under="ignore"):
        half = exact.astype(np.float32)
    if not ((half == exact) | np.isnan(exact)).all():
        return table
    offsets = np.asarray(col.offsets)
    return table.set_column(at, "features", pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(half)))


def pack(points: DataFrame, rows: int, *extra: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(block long, payload binary, *by) with at most `rows` points per block; no shuffle, stable once written.

    With `by` (integer columns) every block holds one combination of their values.
    """
    extra = tuple(dict.fromkeys(extra + by))

    def emit(table: pa.Table, key: int) -> pa.RecordBatch:
        sink, whole = pa.BufferOutputStream(), _halved(table.combine_chunks())
        with pa.ipc.new_stream(sink, whole.schema) as writer:
            writer.write_table(whole)
        cols = {"block": pa.array([key], pa.int64()), "payload": pa.array([sink.getvalue().to_pybytes()], pa.binary())}
        cols.update({c: pa.array([table.column(c)[0].as_py()], pa.int64()) for c in by})
        return pa.RecordBatch.from_pydict(cols)

    def pieces(batch: pa.RecordBatch):
        """Slices of a batch in which all `by` columns are constant."""
        if not by:
            return [(None, batch)]
        vals = [np.asarray(batch.column(c)) for c in by]
        new = np.any([v[1:] != v[:-1] for v in vals], axis=0)
        cuts = np.r_[0, np.nonzero(new)[0] + 1, batch.num_rows]
        return [(tuple(int(v[s]) for v in vals), batch.slice(s, e - s)) for s, e in zip(cuts[:-1], cuts[1:])]

    def run(batches: Iterator[pa.RecordBatch]):
        base, seq, held, count, kind = TaskContext.get().partitionId() << 32, 0, [], 0, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for tag, piece in pieces(batch):
                if count and tag != kind:
                    yield emit(pa.Table.from_batches(held), base + seq)
                    seq, held, count = seq + 1, [], 0
                kind = tag
                held.append(piece)
                count += piece.num_rows
                while count >= rows:
                    whole = pa.Table.from_batches(held)
                    yield emit(whole.slice(0, rows), base + seq)
                    rest = whole.slice(rows)
                    seq, held, count = seq + 1, (rest.to_batches() if rest.num_rows else []), rest.num_rows
        if count:
            yield emit(pa.Table.from_batches(held), base + seq)

    source = points.select("id", "features", *extra)
    if by:
        source = source.sortWithinPartitions(*by)
    schema = "block long, payload binary" + "".join(f", {c} long" for c in by)
    return cut_lineage(source.mapInArrow(run, schema))


def _stripe(stripes: int):
    """Stripe of a block from its partition and its position there."""
    return F.pmod(F.shiftright("block", 32) + F.col("block").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(stripes)).cast("int")


def tile_reduce(
    left: DataFrame,
    right: DataFrame | None,
    kernel: Callable[[Block, Block], Iterator[pa.RecordBatch]],
    schema: str,
    plan: TilePlan,
    want: tuple[str, ...] = (),
    have: str | None = None,
) -> DataFrame:
    """Run `kernel(L, R)` once per pair of blocks. With `right=None` each unordered pair is visited once
    (the kernel then reports for both sides; `L.key == R.key` marks a block met with itself).

    With `want`/`have` a left block only meets right blocks whose column `have` equals one of its `want` columns.
    A kernel with a `finish` function reports the rest of what it holds when a task has seen all its pairs of blocks; every task has its own.
    """
    symmetric = right is None
    right = left if symmetric else right
    gl, gr = plan.left_stripes, plan.right_stripes
    lo = left.select(F.col("block").alias("lb"), F.col("payload").alias("lp"), _stripe(gl).alias("g1"),
                     *([F.explode(F.array_distinct(F.array(*want))).alias("cls")] if have else []))
    hi = right.select(F.col("block").alias("rb"), F.col("payload").alias("rp"), _stripe(gr).alias("g2"),
                      *([F.col(have).alias("cls")] if have else []))
    lo = lo.withColumn("g2", F.explode(F.sequence(F.col("g1") if symmetric else F.lit(0), F.lit(gr - 1))))
    hi = hi.withColumn("g1", F.explode(F.sequence(F.lit(0), F.col("g2") if symmetric else F.lit(gl - 1))))
    tiles = gl * (gl + 1) // 2 if symmetric else gl * gr
    on = ["g1", "g2"] + (["cls"] if have else [])
    # A fixed partition count: tiles are small in bytes but heavy in work, so they must not be merged.
    lo, hi = lo.repartition(tiles, *on), hi.repartition(tiles, *on)
    met = lo.hint("shuffle_hash").join(hi, on)
    if symmetric:
        met = met.where((F.col("g1") < F.col("g2")) | (F.col("lb") <= F.col("rb")))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            lb, rb = batch.column("lb"), batch.column("rb")
            lp, rp = batch.column("lp"), batch.column("rp")
            for i in range(batch.num_rows):
                L = Block(lp[i].as_py(), lb[i].as_py())
                R = Block(rp[i].as_py(), rb[i].as_py())
                yield from kernel(L, R)
        if hasattr(kernel, "finish"):
            yield from kernel.finish()

    return with_parts([(met.select("lb", "lp", "rb", "rp"), run)], schema)


def with_parts(parts: list, schema: str) -> DataFrame:
    """The union of `source.mapInArrow(run, schema)` over `parts`, which it remembers for `map_batches`."""
    out = reduce(DataFrame.union, [source.mapInArrow(run, schema) for source, run in parts])
    out.__dict__["_parts"] = parts
    return out


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`df.mapInArrow(fn, schema)`. On a result of `tile_reduce` or of this function `fn` runs in the kernels' tasks, so that their
    rows, which may be far more than the points, do not pass through the JVM first."""
    def after(run):
        return lambda batches: fn(run(batches))

    parts = df.__dict__.get("_parts")
    return with_parts([(source, after(run)) for source, run in parts] if parts else [(df, fn)], schema)


def chunks(L: Block, R: Block, metric: str, **params):
    """(slice of L, distances to all of R) with a bounded distance buffer."""
    step = max(1, CHUNK_CELLS // max(1, len(R)))
    for s in range(0, len(L), step):
        part = slice(s, min(len(L), s + step))
        yield part, block_distance(metric, L.X[part], R.X, **params)


def batch_of(schema: pa.Schema, *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, type=f.type) for a, f in zip(arrays, schema)], schema=schema)


def bound(points: DataFrame, metric):
    """A measure ready for blocks: one that needs the data set's ranges or covariance gets them from one pass over the points."""
    if not isinstance(metric, str) or metric not in BOUND:
        return metric
    d = shape_of(points)[1]
    if BOUND[metric][0] == "ranges":
        row = points.agg(*[f(F.get("features", i)).alias(f"{n}{i}") for n, f in (("lo", F.min), ("hi", F.max)) for i in range(d)]).first()
        return with_numbers(metric, low=[row[f"lo{i}"] for i in range(d)], high=[row[f"hi{i}"] for i in range(d)])
    return with_numbers(metric, inverse=np.linalg.inv(covariance(points, d)))


def covariance(points: DataFrame, d: int) -> np.ndarray:
    """Sample covariance matrix: every task sends one row of sums, taken about the first of its points."""
    def run(batches):
        n, shift, s, S = 0, None, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                X = matrix(batch.column("features"))
                shift = X[0].copy() if shift is None else shift
                X = X - shift
                n, s, S = n + len(X), s + X.sum(axis=0), S + X.T @ X
        if n:
            yield pa.record_batch([pa.array([n]), pa.array([(s / n + shift).tolist()]), pa.array([(S - np.outer(s, s) / n).ravel().tolist()])], names=["n", "m", "S"])

    total, mean, scatter = 0, np.zeros(d), np.zeros((d, d))
    for r in points.select("features").mapInArrow(run, "n long, m array<double>, S array<double>").toLocalIterator():  # a row per task, one at a time
        gap = np.array(r["m"]) - mean
        both = total + r["n"]
        scatter += np.array(r["S"]).reshape(d, d) + np.outer(gap, gap) * total * r["n"] / both
        mean, total = mean + gap * r["n"] / both, both
    return scatter / max(1, total - 1)


# ---- sums of distances per (point, class) --------------------------------------------------------

_SUMS = "id long, prediction long, run int, other long, total double"
_SUMS_ARROW = pa.schema([("id", pa.int64()), ("prediction", pa.int64()), ("run", pa.int32()),
                         ("other", pa.int64()), ("total", pa.float64())])


def _groups(block: Block):
    run = block.cols.get("run", np.zeros(len(block), dtype=np.int32))
    block.cols["run"] = run
    block.sorted_by(np.lexsort((block.cols["prediction"], run)))
    pred, run = block.cols["prediction"], block.cols["run"]
    new = np.ones(len(block), dtype=bool)
    new[1:] = (pred[1:] != pred[:-1]) | (run[1:] != run[:-1])
    starts = np.nonzero(new)[0]
    return starts, pred[starts], run[starts]


def _sum_rows(block: Block, sums: np.ndarray, others: np.ndarray, runs: np.ndarray) -> pa.RecordBatch:
    n, k = sums.shape
    return batch_of(
        _SUMS_ARROW, np.repeat(block.ids, k), np.repeat(block.cols["prediction"], k),
        np.tile(runs, n), np.tile(others, n), sums.ravel(),
    )


def class_sums(points: DataFrame, metric: str, sample: DataFrame | None = None,
               shape: tuple[int, int] | None = None, **params) -> DataFrame:
    """(id, prediction, run, other, total): total distance of each point to each class `other`.

    With `sample` (columns id, features, prediction, run, weight) the totals are weighted sums over the
    sample; without it every point meets every other point once and both directions are recorded.
    """
    spark = points.sparkSession
    metric = bound(points, metric)
    n, d = shape or shape_of(points)
    if sample is None:
        plan = plan_tiles(spark, d, n)
        blocks = pack(points, plan.left_rows, "prediction")

        def kernel(L: Block, R: Block):
            ls, lc, lr = _groups(L)
            rs, rc, rr = _groups(R)
            left = np.zeros((len(L), len(rs)))
            right = np.zeros((len(ls), len(R)))
            owner = np.searchsorted(ls, np.arange(len(L)), side="right") - 1
            for part, dist in chunks(L, R, metric, **params):
                left[part] = np.add.reduceat(dist, rs, axis=1)
                here, first = np.unique(owner[part], return_index=True)
                right[here] += np.add.reduceat(dist, first, axis=0)
            yield _sum_rows(L, left, rc, rr)
            if L.key != R.key:
                yield _sum_rows(R, right.T, lc, lr)

        parts = tile_reduce(blocks, None, kernel, _SUMS, plan)
    else:
        m, _ = shape_of(sample)
        plan = plan_tiles(spark, d, n, m)
        lblocks = pack(points, plan.left_rows, "prediction")
        rblocks = pack(sample, plan.right_rows, "prediction", "run", "weight")

        def kernel(L: Block, R: Block):
            rs, rc, rr = _groups(R)
            left = np.zeros((len(L), len(rs)))
            for part, dist in chunks(L, R, metric, **params):
                left[part] = np.add.reduceat(dist * R.cols["weight"], rs, axis=1)
            yield _sum_rows(L, left, rc, rr)

        parts = tile_reduce(lblocks, rblocks, kernel, _SUMS, plan)
    return parts.groupBy("id", "prediction", "run", "other").agg(F.sum("total").alias("total"))


# ---- nearest neighbours --------------------------------------------------------------------------

def _near_known(X: np.ndarray, Y: np.ndarray, usable: np.ndarray, k: int) -> np.ndarray:
    """Distances over shared known cells where a pair may be among the k nearest of its row, NaN elsewhere. Matrix products give all squared
    distances up to a proven error; only the pairs that this leaves open are summed cell by cell, as the measure does."""
    known = [~np.isnan(Z) for Z in (X, Y)]
    x, y = (np.where(m, Z, 0.0) for m, Z in zip(known, (X, Y)))
    with np.errstate(over="ignore", invalid="ignore"):
        scale = (x * x) @ known[1].T.astype(np.float64) + known[0].astype(np.float64) @ (y * y).T
        if not scale.size or not np.isfinite(scale.max()):
            return block_distance("nan_euclidean", X, Y)
    d2 = scale - 2.0 * (x @ y.T)
    scale *= 8 * (X.shape[1] + 4) * np.finfo(np.float64).eps
    scale += 1e-300  # squares too small for full precision
    take = min(k, len(Y))
    limit = np.partition(np.where(usable, d2 + scale, np.inf), take - 1, axis=1)[:, take - 1]
    i, j = np.nonzero(usable & (d2 - scale <= limit[:, None]))
    total = np.zeros(len(i))
    for a in range(X.shape[1]):
        gap = X[i, a] - Y[j, a]
        total += np.where(np.isnan(gap), 0.0, gap * gap)
    out = np.full(d2.shape, np.nan)
    out[i, j] = np.sqrt(total)
    return out


# A strip of codes and its sums stay in a core's cache; shorter rows than these columns are slower in NumPy.
STRIP_ROWS, STRIP_COLUMNS = 16, 4096


class _Codes:
    """Vectors of two blocks in steps of one size, small enough that sums of absolute differences fit 16 bits, and what rounding takes from each row."""

    def __init__(self, X: np.ndarray, Y: np.ndarray):
        self.ok = False
        if not len(X) or not len(Y) or not 0 < X.shape[1] <= 500 or X.shape[1] != Y.shape[1]:
            return
        low = np.minimum(X.min(axis=0), Y.min(axis=0))
        with np.errstate(over="ignore", invalid="ignore"):
            span = np.maximum(X.max(axis=0), Y.max(axis=0)) - low
            total = span.sum()
        if not np.isfinite(total) or 0 < total < 1e-290 or not np.abs(low).max() < 1e9 * max(total, 1e-290):
            return
        self.ok, self.step = True, max(total / 65000, span.max() / 32000) or 1.0
        self.x, self.x_lost = self._coded(X - low)
        self.y, self.y_lost = self._coded(Y - low)
        self.y = np.ascontiguousarray(self.y.T)

    def _coded(self, Z: np.ndarray):
        code = np.rint(Z / self.step)
        return code.astype(np.int16), np.abs(Z - code * self.step).sum(axis=1)

    def sums(self, part: slice) -> np.ndarray:
        """Sums of absolute differences of the codes of `part` of the left rows to all right rows."""
        own = np.ascontiguousarray(self.x[part].T)[:, :, None]
        out = np.zeros((own.shape[1], self.y.shape[1]), np.uint16)
        wide = math.ceil(out.shape[1] / max(1, round(out.shape[1] / STRIP_COLUMNS)))
        for c in range(0, out.shape[1], wide):
            other = self.y[:, c:c + wide]
            for r in range(0, out.shape[0], STRIP_ROWS):
                left = own[:, r:r + STRIP_ROWS]
                total = np.zeros((left.shape[1], other.shape[1]), np.uint16)
                gap = np.empty(total.shape, np.int16)
                gaps = gap.view(np.uint16)
                for x, y in zip(left, other):
                    np.subtract(x, y, out=gap)
                    np.abs(gap, out=gap)
                    np.add(total, gaps, out=total)
                out[r:r + STRIP_ROWS, c:c + wide] = total
        return out


class _NearestManhattan:
    """The k nearest other points of every point by sums of absolute differences, from each pair of blocks once.

    Sums of 16-bit codes differ from the distances by no more than what rounding took from both rows. Pairs that this leaves open
    beside the k best of a point so far are summed in full, as the measure does; only these decide. With `by_label` the k best of the
    point's own class (column `cls`) and of other classes are held.
    """

    def __init__(self, k: int, by_label: bool, fallback, schema: pa.Schema):
        self.k, self.kinds, self.fallback, self.schema = k, 2 if by_label else 1, fallback, schema
        self.held: dict[int, tuple] = {}

    def _best(self, B: Block):
        """(ids, distances, neighbours) of a block: k of each kind per point."""
        if B.key not in self.held:
            shape = (len(B), self.kinds, self.k)
            self.held[B.key] = B.ids, np.full(shape, np.inf), np.zeros(shape, np.int64)
        return self.held[B.key]

    def _kinds(self, A: Block, i, B: Block, j):
        """0: own class (or any), 1: other class, 2: the point itself."""
        kind = (A.cols["cls"][i] != B.cols["cls"][j]).astype(np.int8) if self.kinds == 2 else np.zeros(np.broadcast(i, j).shape, np.int8)
        return np.where(A.ids[i] == B.ids[j], 2, kind)

    def _open(self, codes: _Codes, sums: np.ndarray, A: Block, at: np.ndarray, lost: np.ndarray, other_lost: float, B: Block, others: np.ndarray, flip: bool):
        """Pairs (place in A, place in B) that may be among the k nearest of points `at` of A; `sums` has them as columns if `flip`."""
        limit = self._best(A)[1][at, :, -1]
        slack = lost[at] + other_lost
        top = np.minimum(np.floor((limit + slack[:, None]) / codes.step) + 1, 65535)
        known = np.isfinite(limit).all(axis=1)
        code = np.where(known, top.max(axis=1), 0).astype(np.uint16)
        hit = np.flatnonzero(sums <= (code[None, :] if flip else code[:, None]))
        i, j = np.divmod(hit, sums.shape[1])
        i, j = (j, i) if flip else (i, j)
        fine = known[i]
        pairs = [(at[i[fine]], others[j[fine]])]
        # Points without k neighbours of each kind: the k-th of these sums bounds them, kind by kind.
        new = np.flatnonzero(~known)
        for s in range(0, len(new), max(1, CHUNK_CELLS // max(1, len(others)))):
            some = new[s:s + max(1, CHUNK_CELLS // max(1, len(others)))]
            own = sums[:, some].T if flip else sums[some]
            kind = self._kinds(A, at[some][:, None], B, others[None, :])
            may = np.zeros(own.shape, bool)
            for which in range(self.kinds):
                is_kind = kind == which
                take = min(self.k, own.shape[1])
                kth = np.partition(np.where(is_kind, own, 65535).astype(np.uint16), take - 1, axis=1)[:, take - 1]
                bound = np.where(kth < 65535, kth * codes.step + slack[some], np.inf)
                bound = np.minimum(bound, limit[some, which])
                most = np.minimum(np.floor((bound + slack[some]) / codes.step) + 1, 65535).astype(np.uint16)
                may |= is_kind & (own <= most[:, None])
            a, b = np.nonzero(may)
            pairs.append((at[some[a]], others[b]))
        return tuple(np.concatenate(x) for x in zip(*pairs))

    def _offer(self, A: Block, i: np.ndarray, B: Block, j: np.ndarray) -> None:
        _, best, names = self._best(A)
        kind = self._kinds(A, i, B, j)
        i, j, kind = i[kind < 2], j[kind < 2], kind[kind < 2]
        keys, found, who = [], [], []
        for s in range(0, len(i), 1 << 14):
            a, b, which = i[s:s + (1 << 14)], j[s:s + (1 << 14)], kind[s:s + (1 << 14)]
            dist = np.cumsum(np.abs(A.X[a] - B.X[b]), axis=1)[:, -1]  # in the order of the attributes
            use = dist <= best[a, which, -1]
            keys.append(a[use] * self.kinds + which[use])
            found.append(dist[use])
            who.append(B.ids[b[use]])
        if not keys:
            return
        flat, flat_names = best.reshape(-1, self.k), names.reshape(-1, self.k)
        key = np.concatenate(keys)
        some = np.unique(key)
        key = np.r_[key, np.repeat(some, self.k)]
        dist, who = np.r_[np.concatenate(found), flat[some].ravel()], np.r_[np.concatenate(who), flat_names[some].ravel()]
        order = np.lexsort((who, dist, key))
        key, dist, who = key[order], dist[order], who[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        keep = place < self.k
        flat[key[keep], place[keep]] = dist[keep]
        flat_names[key[keep], place[keep]] = who[keep]

    def __call__(self, L: Block, R: Block):
        codes = _Codes(L.X, R.X)
        if not codes.ok:
            yield from self.fallback(L, R)
            if L.key != R.key:
                yield from self.fallback(R, L)
            return
        every, x_most, y_most = np.arange(len(R)), codes.x_lost.max(), codes.y_lost.max()
        step = max(1, CHUNK_CELLS // len(R))
        for s in range(0, len(L), step):
            part = np.arange(s, min(len(L), s + step))
            sums = codes.sums(slice(s, part[-1] + 1))
            i, j = self._open(codes, sums, L, part, codes.x_lost, y_most, R, every, False)
            self._offer(L, i, R, j)
            if L.key != R.key:
                j, i = self._open(codes, sums, R, every, codes.y_lost, x_most, L, part, True)
                self._offer(R, j, L, i)

    def finish(self):
        for ids, best, names in self.held.values():
            i, kind, place = np.nonzero(np.isfinite(best))
            dist = best[i, kind, place]
            yield batch_of(self.schema, ids[i], names[i, kind, place], dist, dist, kind == 0)
        self.held = {}


def nearest(queries: DataFrame, refs: DataFrame, k: int, metric: str = "euclidean", same: bool = False,
            by_label: bool = False, exclude_equal: bool = False, **params) -> DataFrame:
    """(id, neighbour, score, rank[, hit]): the k nearest `refs` of every query, ties by neighbour id.

    `same=True`: queries and refs are the same set, a point is not its own neighbour.
    `by_label=True`: the k nearest of the same class (hit=true) and of other classes, by numeric column `cls`.
    `exclude_equal=True`: rows with identical values are no neighbours.
    """
    from pyspark.sql import Window

    metric = bound(refs, metric)
    m = measure(metric)
    spark = queries.sparkSession
    n, d = shape_of(queries)
    n_refs = n if refs is queries else shape_of(refs)[0]
    extra = ["cls"] if by_label else []
    coded = metric == "manhattan" and same and refs is queries and not exclude_equal and not params and k > 0
    plan = plan_tiles(spark, d, n, held=True) if coded else plan_tiles(spark, d, n, n_refs)
    lblocks = pack(queries, plan.left_rows, *extra)
    rblocks = lblocks if same and refs is queries else pack(refs, plan.right_rows, *extra)
    schema = pa.schema([("id", pa.int64()), ("neighbour", pa.int64()), ("bad", pa.float64()),
                        ("score", pa.float64()), ("hit", pa.bool_())])

    def top(L, R, part, score, allowed, hit):
        bad = np.where(allowed, m.badness_np(score), np.nan)
        take = min(k, bad.shape[1])
        if take < bad.shape[1]:
            # Everything up to the k-th value stays, so ties are settled by id and not by position.
            kth = np.partition(np.where(np.isnan(bad), np.inf, bad), take - 1, axis=1)[:, take - 1]
            keep = bad <= kth[:, None]
        else:
            keep = ~np.isnan(bad)
        i, j = np.nonzero(keep & ~np.isnan(bad))
        order = np.lexsort((R.ids[j], bad[i, j], i))
        i, j = i[order], j[order]
        pos = np.arange(len(i)) - np.searchsorted(i, i, side="left")
        i, j = i[pos < k], j[pos < k]
        return batch_of(schema, L.ids[part][i], R.ids[j], bad[i, j], score[i, j], np.full(len(i), hit))

    screened = metric == "nan_euclidean" and not by_label and not exclude_equal

    def screen(L, R):
        step = max(1, CHUNK_CELLS // max(1, len(R)))
        for s in range(0, len(L), step):
            part = slice(s, min(len(L), s + step))
            usable = L.ids[part][:, None] != R.ids[None, :] if same else np.ones((part.stop - s, len(R)), bool)
            yield part, _near_known(L.X[part], R.X, usable, k)

    def kernel(L: Block, R: Block):
        for part, score in screen(L, R) if screened else chunks(L, R, metric, **params):
            allowed = ~np.isnan(score)
            if same:
                allowed &= L.ids[part][:, None] != R.ids[None, :]
            if exclude_equal:
                allowed &= block_distance("chebyshev", L.X[part], R.X) > 0
            if by_label:
                equal = L.cols["cls"][part][:, None] == R.cols["cls"][None, :]
                yield top(L, R, part, score, allowed & equal, True)
                yield top(L, R, part, score, allowed & ~equal, False)
            else:
                yield top(L, R, part, score, allowed, True)

    ddl = "id long, neighbour long, bad double, score double, hit boolean"
    if coded:
        found = tile_reduce(lblocks, None, _NearestManhattan(k, by_label, kernel, schema), ddl, plan)
    else:
        found = tile_reduce(lblocks, rblocks, kernel, ddl, plan)
    w = Window.partitionBy("id", "hit").orderBy("bad", "neighbour")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("id", "neighbour", "score", "rank", *(["hit"] if by_label else []))
