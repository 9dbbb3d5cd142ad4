"""Near pairs within a reach, without meeting every block with every other.

Points are projected on a few directions along which they spread most. A projection never stretches a distance, so points closer
than `eps` are closer than `eps` on every direction. Points are ordered along a space-filling curve through the projections and cut into
stripes of consecutive points and blocks inside them, and every block carries its bounds on all directions as columns. The bounds meet first:
stripes fall into slabs of the first direction, at least `eps` wide, and a slab meets itself and its two neighbours; what stays apart on
some direction drops out. Payloads move only for stripes with near blocks, and only near blocks reach the kernel.

Equal points share their place on the curve and are dealt on by a hash of their id, so that no stripe grows with a hot spot. The directions come
from a bounded sample; any direction gives the same rows, only with more or fewer blocks to visit.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, parallelism
from .pairs import Block, TilePlan, matrix, plan_tiles, shape_of

SAMPLE = 10_000
DIRECTIONS = 3
BITS = 10
BLOCK_ROWS = 2048
# The norm that a direction must not exceed so that |u (x - y)| is at most the distance of x and y.
DUAL = {"euclidean": 2, "sq_euclidean": 2, "manhattan": np.inf, "chebyshev": 1, "minkowski": 1}


@dataclass
class Frame:
    """Directions as columns of a matrix, and the range in which the curve tells places apart."""

    turn: np.ndarray
    low: np.ndarray
    high: np.ndarray
    reach: float

    def project(self, X: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore", over="ignore"):
            return X @ self.turn

    def place(self, p: np.ndarray) -> np.ndarray:
        """Position on the curve: the bits of all projections interleaved."""
        # One scale for all: a direction of little spread must not scatter what the main one keeps together.
        span = float((self.high - self.low).max()) or 1.0
        cell = np.nan_to_num((p - self.low) / span, nan=0.0, posinf=1.0, neginf=0.0)
        cell = (np.clip(cell, 0.0, 1.0) * ((1 << BITS) - 1)).astype(np.int64)
        out = np.zeros(len(p), np.int64)
        for bit in range(BITS - 1, -1, -1):
            for k in range(p.shape[1]):
                out = out << 1 | cell[:, k] >> bit & 1
        return out


def supported(metric) -> bool:
    return isinstance(metric, str) and metric in DUAL


def frame_of(points: DataFrame, d: int, eps: float, metric: str, directions: int = DIRECTIONS) -> Frame:
    """Main directions of the points with the SAMPLE smallest id hashes."""
    col = points.select("features", F.xxhash64("id").alias("h")).orderBy("h").limit(SAMPLE).select("features").toArrow()["features"]
    X = matrix(col)
    X = X[np.isfinite(X).all(axis=1)] if len(X) else np.zeros((0, max(1, d)))
    scale = np.abs(X).max() if X.size else 1.0
    C = X / (scale or 1.0)
    C = C - C.mean(axis=0) if len(C) else C
    _, vectors = np.linalg.eigh(C.T @ C)
    turn = vectors[:, ::-1][:, :directions]
    turn = turn / np.linalg.norm(turn, ord=DUAL[metric], axis=0) if DUAL[metric] != np.inf else turn / np.abs(turn).max(axis=0)
    p = X @ turn if len(X) else np.zeros((1, turn.shape[1]))
    # Rounding of a projection grows with the length of the points; pairs at exactly eps are left to the kernel.
    slack = 1e-9 * (eps + float(np.abs(p).max()))
    return Frame(turn, p.min(axis=0), p.max(axis=0), (math.sqrt(eps) if metric == "sq_euclidean" else eps) + slack)


def pack_ordered(points: DataFrame, stripes: int, rows: int, frame: Frame, *extra: str) -> DataFrame:
    """(block, stripe, lo array, hi array, payload): blocks of at most `rows` points in the order of the curve."""
    @F.arrow_udf("long")
    def place(v: pa.Array) -> pa.Array:
        return pa.array(frame.place(frame.project(matrix(v)))) if len(v) else pa.array([], pa.int64())

    placed = points.select("id", "features", *extra).withColumn("place", place("features"))
    ranged = placed.repartitionByRange(stripes, "place", F.xxhash64("id")).sortWithinPartitions("place").drop("place")

    def emit(table: pa.Table, stripe: int, seq: int) -> pa.RecordBatch:
        p = frame.project(matrix(table.column("features")))
        lo = np.where(np.isnan(p), np.inf, p).min(axis=0)
        hi = np.where(np.isnan(p), -np.inf, p).max(axis=0)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table.combine_chunks())
        return pa.record_batch([pa.array([stripe << 32 | seq], pa.int64()), pa.array([stripe], pa.int32()), pa.array([lo.tolist()]), pa.array([hi.tolist()]),
                                pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "stripe", "lo", "hi", "payload"])

    def run(batches: Iterator[pa.RecordBatch]):
        stripe, seq, held, count = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, rows - count)
                batch = batch.slice(part.num_rows)
                held.append(part)
                count += part.num_rows
                if count == rows:
                    yield emit(pa.Table.from_batches(held), stripe, seq)
                    seq, held, count = seq + 1, [], 0
        if count:
            yield emit(pa.Table.from_batches(held), stripe, seq)

    return cut_lineage(ranged.mapInArrow(run, "block long, stripe int, lo array<double>, hi array<double>, payload binary"))


def _near(reach: float, directions: int, a: str, b: str):
    """Whether two bounds (columns {a}_lo, {a}_hi and {b}_lo, {b}_hi) may hold points within the reach."""
    out = F.lit(True)
    for k in range(directions):
        out = out & (F.get(f"{a}_lo", k) - F.get(f"{b}_hi", k) < F.lit(reach)) & (F.get(f"{b}_lo", k) - F.get(f"{a}_hi", k) < F.lit(reach))
    return out


def near_blocks(left: DataFrame, right: DataFrame | None, frame: Frame) -> DataFrame:
    """(lb, rb, g1, g2) of blocks that may hold near points; with `right=None` every unordered pair once. Payloads are not read."""
    k = frame.turn.shape[1]
    own = right is None
    bounds = [x.select("block", "stripe", "lo", "hi") for x in (left, left if own else right)]
    stripes = [b.groupBy("stripe").agg(F.array(*[F.min(F.get("lo", i)) for i in range(k)]).alias("lo"),
                                       F.array(*[F.max(F.get("hi", i)) for i in range(k)]).alias("hi")) for b in bounds]
    sizes = stripes[0].agg(F.count(F.lit(1)).alias("n"), F.min(F.get("lo", 0)).alias("lo"), F.max(F.get("hi", 0)).alias("hi")).first()
    if not sizes["n"]:
        low, width, most = 0.0, 1.0, 0
    else:
        low, high = (float(np.nan_to_num(sizes[c], posinf=0.0, neginf=0.0)) for c in ("lo", "hi"))
        most = max(1, round(sizes["n"] ** (1 / 3)))
        width = max(frame.reach, (high - low) / most) or 1.0
    slab = lambda c: F.greatest(F.lit(0), F.least(F.lit(most), F.floor((F.get(c, 0) - F.lit(low)) / F.lit(width)))).cast("int")
    real = F.get("lo", 0) <= F.get("hi", 0)
    a = stripes[0].where(real).select(F.col("stripe").alias("g1"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"),
                                      F.explode(F.sequence(slab("lo"), slab("hi"))).alias("slab"))
    b = stripes[1].where(real).select(F.col("stripe").alias("g2"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"),
                                      F.explode(F.sequence(slab("lo") - 1, slab("hi") + 1)).alias("slab"))
    met = a.join(b, "slab").where(_near(frame.reach, k, "a", "b"))
    if own:
        met = met.where("g1 <= g2")
    met = met.select("g1", "g2").distinct()
    if own:
        # A block always meets itself, whatever it holds.
        met = met.unionByName(stripes[0].select(F.col("stripe").alias("g1"), F.col("stripe").alias("g2"))).distinct()
    lo = bounds[0].select(F.col("block").alias("lb"), F.col("stripe").alias("g1"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    hi = bounds[1].select(F.col("block").alias("rb"), F.col("stripe").alias("g2"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    pairs = met.join(lo, "g1").join(hi, "g2")
    if own:
        pairs = pairs.where("g1 < g2 OR lb <= rb").where(_near(frame.reach, k, "a", "b") | (F.col("lb") == F.col("rb")))
    else:
        pairs = pairs.where(_near(frame.reach, k, "a", "b"))
    return pairs.select("lb", "rb", "g1", "g2")


def near_reduce(left: DataFrame, right: DataFrame | None, kernel: Callable[[Block, Block], Iterator[pa.RecordBatch]], schema: str, eps: float,
                metric: str, left_extra: tuple[str, ...] = (), right_extra: tuple[str, ...] = ()) -> DataFrame:
    """Run `kernel(L, R)` for blocks of points that may be closer than `eps`; with `right=None` once per unordered pair of blocks."""
    n, d = shape_of(left)
    m, e = (None, 0) if right is None else shape_of(right)
    d = max(d, e)
    plan = plan_near(left.sparkSession, d, n, m)
    frame = frame_of(left, d, eps, metric)
    lo = pack_ordered(left, plan.left_stripes, plan.left_rows, frame, *left_extra)
    hi = lo if right is None else pack_ordered(right, plan.right_stripes, plan.right_rows, frame, *right_extra)
    pairs = cut_lineage(near_blocks(lo, None if right is None else hi, frame))
    count = max(1, pairs.select("g1", "g2").distinct().count())
    # A left block travels with the names of those it has to meet; blocks that meet nothing stay where they are.
    wanted = pairs.groupBy("lb", "g1", "g2").agg(F.collect_set("rb").alias("wanted"))
    a = lo.select(F.col("block").alias("lb"), F.col("payload").alias("lp")).join(wanted, "lb")
    b = hi.select(F.col("block").alias("rb"), F.col("payload").alias("rp")).join(pairs.select("rb", "g1", "g2").distinct(), "rb")
    # As in the tile join: tiles are few bytes but much work, so their number is fixed.
    a, b = a.repartition(count, "g1", "g2"), b.repartition(count, "g1", "g2")
    met = a.hint("shuffle_hash").join(b, ["g1", "g2"]).where(F.array_contains("wanted", F.col("rb")))

    def run(batches):
        for batch in batches:
            lb, rb, lp, rp = (batch.column(c) for c in ("lb", "rb", "lp", "rp"))
            for i in range(batch.num_rows):
                yield from kernel(Block(lp[i].as_py(), lb[i].as_py()), Block(rp[i].as_py(), rb[i].as_py()))

    return met.select("lb", "lp", "rb", "rp").mapInArrow(run, schema)


def plan_near(spark, d: int, n: int, m: int | None) -> TilePlan:
    """As for the tile join, with smaller blocks (their bounds are tighter) and at least a stripe per core's worth of points."""
    plan = plan_tiles(spark, max(1, d), max(1, n), m)

    def cut(stripes, rows, count):
        return max(stripes, min(parallelism(spark), math.ceil(count / BLOCK_ROWS))), min(rows, BLOCK_ROWS)

    left, left_rows = cut(plan.left_stripes, plan.left_rows, n)
    right, right_rows = cut(plan.right_stripes, plan.right_rows, n if m is None else m)
    return TilePlan(left_rows, right_rows, left, right)
