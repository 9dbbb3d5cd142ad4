"""Time series: building, normalising, piecewise averages and dynamic time warping over given pairs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, parallelism


def number_rows(df: DataFrame, key: str, order: list[str], out: str = "pos") -> DataFrame:
    """0-based position of every row within its key, in the given order.

    Rows are range-partitioned on key and order together, so a key with very many rows spreads over tasks; the rows of
    a key inside a task are numbered from that task's offset. The offsets are one row per key and task.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order)
    placed = cut_lineage(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    runs = placed.groupBy(key, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    pos = F.col("_at") - F.col("_first") + F.col("_before")
    return placed.join(offsets, [key, "_part"]).withColumn(out, pos).drop("_at", "_part", "_first", "_before")


def build_series(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, pos, value): one row per time point, numbered per key in time order."""
    rows = events.select(F.col(key).alias("key"), *order, F.col(value).cast("double").alias("value"))
    return number_rows(rows, "key", order).select("key", "pos", "value")


def normalize_series(series: DataFrame) -> DataFrame:
    """(x - mean) / mean absolute deviation; all zero when the deviation is zero."""
    means = series.groupBy("key").agg(F.avg("value").alias("_m"))
    centred = series.join(means, "key").withColumn("value", F.col("value") - F.col("_m")).drop("_m")
    spread = centred.groupBy("key").agg(F.avg(F.abs("value")).alias("_d"))
    return centred.join(spread, "key").withColumn(
        "value", F.coalesce(F.try_divide(F.col("value"), F.col("_d")), F.lit(0.0))).drop("_d")


def paa(series: DataFrame, points: int) -> DataFrame:
    """(key, pos, time, value, size): averages of `points` stretches with rounded borders; time is the mean index.

    Series shorter than `points` cannot be shrunk and are left out.
    """
    length = series.groupBy("key").agg(F.count(F.lit(1)).alias("_len"))
    known = series.join(length.where(F.col("_len") >= points), "key")
    step = F.col("_len") / F.lit(float(points))
    # Stretch b covers positions floor(step * b + 0.5) up to, not including, floor(step * (b + 1) + 0.5).
    guess = F.floor((F.col("pos") + 0.5) / step)
    start = lambda b: F.floor(step * b + 0.5)
    stretch = F.when(F.col("pos") < start(guess), guess - 1).when(F.col("pos") >= start(guess + 1), guess + 1).otherwise(guess)
    return known.groupBy("key", stretch.cast("bigint").alias("_b")).agg(
        F.avg(F.col("pos").cast("double")).alias("time"), F.avg("value").alias("value"), F.count(F.lit(1)).alias("size")
    ).withColumnRenamed("_b", "pos")


def series_arrays(series: DataFrame) -> DataFrame:
    """(key, values array<double>) for the warping jobs, which need both whole series of a pair in one place."""
    packed = series.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("s"))
    return packed.select("key", F.col("s.value").alias("values"))


# ---- dynamic time warping ------------------------------------------------------------------------

# From this mean width on, a window is walked by whole anti-diagonals; narrower ones cell by cell.
WIDE = 48
DIAGONAL, UP, LEFT = 0, 1, 2


def _warp(a: np.ndarray, b: np.ndarray, cost, low: np.ndarray, high: np.ndarray):
    """(distance, rows, columns) of the cheapest monotone path through columns low[i]..high[i] of each row; equal ways prefer the
    diagonal, then the step down. Only one byte per cell of the window is kept. An empty series has no path and distance NaN."""
    n, m = len(a), len(b)
    if not n or not m:
        return math.nan, np.zeros(0, int), np.zeros(0, int)
    offsets = np.r_[0, np.cumsum(high - low + 1)]
    moves = np.zeros(offsets[-1], np.uint8)
    total = (_by_diagonals if offsets[-1] >= WIDE * n else _by_cells)(a, b, cost, low, high, offsets, moves)
    return total, *_path(moves, offsets, low, n, m)


def _by_diagonals(a, b, cost, low, high, offsets, moves) -> float:
    """All cells with i + j = s at once, from the two diagonals before. Windows are monotone, so a diagonal's rows are consecutive."""
    n, m = len(a), len(b)
    rows = np.arange(n)
    sums = np.arange(n + m - 1)
    first, last = np.searchsorted(rows + high, sums), np.searchsorted(rows + low, sums, side="right") - 1
    # Costs by row + 1, so that the row before the first one is there and infinite.
    older, old, new = (np.full(n + 1, math.inf) for _ in range(3))
    spans = [(0, 0)] * 3
    for s in sums:
        x, y = int(first[s]), int(last[s]) + 1
        new[spans[0][0]: spans[0][1]] = math.inf
        if x < y:
            i = rows[x:y]
            step, best = cost(a[x:y], b[s - i]), older[x:y].copy()
            if s == 0:
                best[0] = 0.0
            way = np.zeros(y - x, np.uint8)
            for code, other in ((UP, old[x:y]), (LEFT, old[x + 1: y + 1])):
                less = other < best
                best[less], way[less] = other[less], code
            new[x + 1: y + 1] = step + best
            moves[offsets[x:y] + s - i - low[x:y]] = way
        spans = [spans[1], spans[2], (x + 1, y + 1)]
        older, old, new = old, new, older
    return float(old[n])


def _by_cells(a, b, cost, low, high, offsets, moves) -> float:
    inf = math.inf
    above, left_edge = [], 0
    for i in range(len(a)):
        lo, hi = int(low[i]), int(high[i])
        step, row, at = cost(a[i], b[lo: hi + 1]).tolist(), [], int(offsets[i])
        width = len(above)
        before = inf
        for j in range(lo, hi + 1):
            k = j - left_edge
            best, way = (above[k - 1] if 0 < k <= width else inf), DIAGONAL
            if i == 0 and j == 0:
                best = 0.0
            up = above[k] if 0 <= k < width else inf
            if up < best:
                best, way = up, UP
            if before < best:
                best, way = before, LEFT
            before = step[j - lo] + best
            row.append(before)
            moves[at + j - lo] = way
        above, left_edge = row, lo
    return float(above[-1])


def _path(moves, offsets, low, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    i, j = n - 1, m - 1
    rows, columns = [i], [j]
    while i or j:
        way = moves[offsets[i] + j - low[i]]
        i, j = i - (way != LEFT), j - (way != UP)
        rows.append(i)
        columns.append(j)
    return np.array(rows[::-1]), np.array(columns[::-1])


def _full(n: int, m: int):
    return np.zeros(n, dtype=int), np.full(n, m - 1, dtype=int)


def _band(n: int, m: int, radius: int):
    """Columns within `radius` of the length-scaled diagonal, widened until consecutive rows connect."""
    centre = np.arange(n) * (m / n)
    low = np.clip(np.floor(centre).astype(int) - radius, 0, m - 1)
    high = np.clip(np.ceil(centre + m / n).astype(int) - 1 + radius, 0, m - 1)
    high[-1] = m - 1
    return low, np.maximum(high, low)


def _shrink(v: np.ndarray) -> np.ndarray:
    size = len(v) // 2
    edges = np.floor(len(v) / size * np.arange(size + 1) + 0.5).astype(int)
    return np.array([v[s:e].mean() for s, e in zip(edges[:-1], edges[1:])])


def _fast(a: np.ndarray, b: np.ndarray, cost, radius: int):
    """Window for the full resolution from the path at half resolution, widened by `radius`."""
    if min(len(a), len(b)) <= radius + 2 or min(len(a), len(b)) < 4:
        return _full(len(a), len(b))
    sa, sb = _shrink(a), _shrink(b)
    low, high = _fast(sa, sb, cost, radius)
    _, at, to = _warp(sa, sb, cost, low, high)
    n, m = len(a), len(b)
    lo, hi = np.full(n, m - 1), np.zeros(n, dtype=int)
    fa, fb = n / len(sa), m / len(sb)
    for i, j in zip(at.tolist(), to.tolist()):
        rows = slice(max(0, math.floor(i * fa) - radius), min(n, math.ceil((i + 1) * fa) + radius))
        lo[rows] = np.minimum(lo[rows], max(0, math.floor(j * fb) - radius))
        hi[rows] = np.maximum(hi[rows], min(m - 1, math.ceil((j + 1) * fb) - 1 + radius))
    lo[0], hi[-1] = 0, m - 1
    return np.minimum.accumulate(lo[::-1])[::-1], np.maximum.accumulate(hi)


def warp_pairs(pairs: DataFrame, method: str = "full", radius: int = 1) -> DataFrame:
    """(key_a, key_b, distance, path) for rows (key_a, a, key_b, b): `full`, `band`, `fast` or `similarity`.

    Distances add absolute differences along the path. `similarity` adds squared differences, drops NaN, and
    returns 1 - z / (1 + z) with z = sqrt(total) / path length. A pair with an empty or null series has distance NaN and path 0.
    """
    if method not in ("full", "band", "fast", "similarity"):
        raise ValueError(method)

    def run(batches):
        for batch in batches:
            out = {"key_a": batch.column("key_a"), "key_b": batch.column("key_b"), "distance": [], "path": []}
            for x, y in zip(batch.column("a"), batch.column("b")):
                a, b = np.array(x.as_py() or (), dtype=float), np.array(y.as_py() or (), dtype=float)
                absolute = lambda u, v: np.abs(u - v)
                if method == "similarity":
                    a, b = a[~np.isnan(a)], b[~np.isnan(b)]
                    dist, path, _ = _warp(a, b, lambda u, v: (u - v) ** 2, *_full(len(a), len(b)))
                    z = math.sqrt(dist) / len(path) if len(path) else math.nan
                    dist = 1 - z / (1 + z)
                else:
                    if not len(a) or not len(b):
                        out["distance"].append(math.nan)
                        out["path"].append(0)
                        continue
                    window = {"full": lambda: _full(len(a), len(b)), "band": lambda: _band(len(a), len(b), radius),
                              "fast": lambda: _fast(a, b, absolute, radius)}[method]()
                    dist, path, _ = _warp(a, b, absolute, *window)
                out["distance"].append(dist)
                out["path"].append(len(path))
            yield pa.RecordBatch.from_pydict({
                "key_a": out["key_a"], "key_b": out["key_b"], "distance": pa.array(out["distance"], pa.float64()),
                "path": pa.array(out["path"], pa.int32())})

    # A pair costs its two lengths multiplied, so pairs are spread by number and not merged by size.
    spread = pairs.select("key_a", "a", "key_b", "b").repartition(2 * parallelism(pairs.sparkSession), "key_a", "key_b")
    return spread.mapInArrow(run, "key_a long, key_b long, distance double, path int")
