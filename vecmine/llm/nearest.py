"""Approximate nearest neighbours by an adaptive dimension scan.

Vectors are turned by one random rotation and dealt to lists by a coarse quantiser (k-means on a bounded sample; the number of lists
grows with the square root of the rows). A query scans its most promising lists, as many as bring `FOUND` of the neighbours of sampled vectors. It
starts with a limit that the sample proves: its k-th best product there. In a list the columns are read in blocks: turned at random, the first
d of D columns hold on average d / D of the product, so part * D / d estimates it with deviation |q| |x| sqrt((1 + c^2)(1 - d / D) / d), c being
the estimated cosine. A candidate whose estimate plus `Z` deviations stays below the limit is given up, as is one that
cannot reach it even if all that is unread points the query's way. A block of queries is tested against a block of candidates at once, in
single precision; what survives the last columns is scored on the original vectors in double
precision, so scores are exact and equal vectors tie exactly.

Every row is indexed, every query asks. Lists are cut into blocks of bounded size, so that a list with most rows (one common vector)
is many blocks; queries travel to their lists in blocks too. Vectors that are null, zero, or hold null or non-finite components take no
part, nor do rows with a null vec_id or another length than most rows have. Repeated rows are candidates each; a query row that is repeated with the
same vector is asked once, one with another vector is a query of its own under the same id. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage

NEIGHBOURS = 20
SAMPLE = 20_000
# Lists are rows^0.5 / 8 within these bounds.
LISTS_LEAST, LISTS_MOST = 16, 4096
FOUND = 0.96
ASKED = 256
COLUMNS = 16
Z = 2.1
BLOCK_ROWS = 4096
QUERY_ROWS = 1024
# Queries that are gathered in one task before they are dealt to their lists.
QUERY_TASK = 8192


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    good = (F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
            & F.exists(v, lambda x: x != 0))
    rows = vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "n").first()
    return rows.where(F.size("v") == (sizes["n"] if sizes else 0))


def rotation(dims: int, seed: int = 17) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


class Index:
    """Rotation and centres of the coarse lists, and the sample they come from."""

    def __init__(self, turn: np.ndarray, centres: np.ndarray, probes: int, ids: np.ndarray | None = None, rows: np.ndarray | None = None,
                 x: np.ndarray | None = None):
        self.turn, self.centres, self.probes, self.ids, self.rows, self.x = turn, centres, probes, ids, rows, x

    @classmethod
    def fit(cls, rows: DataFrame, lists: int | None = None, probes: int | None = None, sample: int = SAMPLE, rounds: int = 15, k: int = NEIGHBOURS,
            found: float = FOUND) -> Index:
        """From the `sample` distinct vectors with the smallest hash."""
        h = F.xxhash64("v")
        seen = rows.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(h, 0.02).alias("d")).first()
        if not seen["n"]:
            return cls(np.eye(1), np.zeros((1, 1)), 1)
        # Half as much again as the sample in expectation: over the error of the estimate and seven deviations also for small samples.
        share = min(1.0, (1.5 * sample + 10.0 * (1.5 * sample) ** 0.5 + 40.0) / max(1, seen["d"]))
        picked = (rows.select("vec_id", "row", h.alias("h"), "v").where((F.col("h") / F.lit(2.0 ** 64) + F.lit(0.5)) <= share)
                  .groupBy("h").agg(F.min(F.struct("vec_id", "row", "v")).alias("r")).orderBy("h").limit(sample).select("r.*").toArrow())
        x = _matrix(picked["v"].combine_chunks(), len(picked["v"][0]))
        ids = np.asarray(picked["vec_id"])
        turn = rotation(x.shape[1])
        turned = x @ turn
        lists = lists or max(LISTS_LEAST, min(LISTS_MOST, round(math.sqrt(seen["n"]) / 8)))
        centres = turned[:: max(1, len(x) // lists)][:lists].copy()
        for _ in range(rounds):
            own = np.argmin((centres ** 2).sum(1) - 2 * turned @ centres.T, 1)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, turned)
            n = np.bincount(own, minlength=len(centres))
            centres[n > 0] = sums[n > 0] / n[n > 0, None]
        index = cls(turn, centres, len(centres), ids, np.asarray(picked["row"]), x)
        # A handful of vectors, however often repeated, is scanned whole.
        index.probes = min(probes or (len(centres) if len(x) <= 10 * k else index.probes_for(turned, k, found)), len(centres))
        return index

    def probes_for(self, turned: np.ndarray, k: int, found: float) -> int:
        """How many lists hold that share of the k best of sampled vectors among the sample."""
        q = turned[:: max(1, len(turned) // ASKED)][:ASKED]
        order = np.argsort(-(q @ self.centres.T), axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], 1)
        score = q @ turned.T
        top = np.argsort(-score, axis=1, kind="stable")[:, 1: k + 1]
        needed = np.sort(np.take_along_axis(place, self.list_of(turned)[top], 1).ravel())
        return int(needed[min(len(needed) - 1, math.ceil(found * len(needed)) - 1)]) + 1 if len(needed) else 1

    def best(self, ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
        """Positions of a query's k best rows of the sample but its own (all, if fewer; -1 fills up)."""
        out = np.full((len(q), k), -1)
        for s in range(0, len(q), QUERY_ROWS):
            part = slice(s, s + QUERY_ROWS)
            score = q[part] @ self.x.T
            score[ids[part, None] == self.ids[None, :]] = -np.inf
            m = min(k, len(self.ids))
            top = np.argpartition(-score, m - 1, axis=1)[:, :m]
            out[part, :m] = np.where(np.isfinite(np.take_along_axis(score, top, 1)), top, -1)
        return out

    def limits(self, ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
        """The score that a query's k-th best has at least, as the sample proves."""
        top = self.best(ids, q, k)
        low = np.array([(self.x[t] * v).sum(1).min() if (t >= 0).all() else -np.inf for t, v in zip(top, q)])
        # Sums in another order differ in their last bits.
        return low - 1e-9 * (1 + np.abs(np.where(np.isfinite(low), low, 0)))

    def list_of(self, x: np.ndarray) -> np.ndarray:
        return np.argmin((self.centres ** 2).sum(1) - 2 * x @ self.centres.T, 1)

    def lists_for(self, q: np.ndarray) -> np.ndarray:
        """The lists whose centres have the largest product with the query."""
        return np.argsort(-(q @ self.centres.T), axis=1, kind="stable")[:, : self.probes]


def _matrix(column, dims: int) -> np.ndarray:
    return np.asarray(pa.array(column).flatten() if not hasattr(column, "flatten") else column.flatten(), dtype=np.float64).reshape(-1, dims)


def scan(ids: np.ndarray, x: np.ndarray, turned: np.ndarray, qid: np.ndarray, q: np.ndarray, q_turned: np.ndarray, limit: np.ndarray,
         k: int = NEIGHBOURS, columns: int = COLUMNS, z: float = Z):
    """(query, candidate, score) arrays of positions: for each query the k best of a block that reach its limit, and how many products of
    columns were given up early."""
    dims = turned.shape[1]
    cuts = list(range(0, dims, columns)) + [dims]
    blocks = [np.ascontiguousarray(turned[:, a:b], np.float32) for a, b in zip(cuts, cuts[1:])]
    q_blocks = [np.ascontiguousarray(q_turned[:, a:b], np.float32) for a, b in zip(cuts, cuts[1:])]
    # Lengths of what is unread after each block, and of all.
    rest_x, rest_q = ([np.sqrt((v[:, c:] ** 2).sum(1)).astype(np.float32) for c in cuts] for v in (turned, q_turned))
    low = limit.astype(np.float32)

    def hopeful(part, i, j, b):
        """Which partial products after block b may still reach the limit."""
        left, seen = dims - cuts[b + 1], cuts[b + 1]
        both = rest_q[0][i] * rest_x[0][j]
        need = low[i] - 1e-5 * both
        keep = part + rest_q[b + 1][i] * rest_x[b + 1][j] >= need
        if left:
            guess = part * np.float32(dims / seen)
            spread = both * np.sqrt((1 + np.minimum(1, (guess / np.maximum(both, np.float32(1e-30))) ** 2)) * np.float32(left / dims / seen))
            keep &= guess + z * spread >= need
        return keep

    every_q, every_x = np.arange(len(q))[:, None], np.arange(len(x))[None, :]
    part = q_blocks[0] @ blocks[0].T
    i, j = np.nonzero(hopeful(part, every_q, every_x, 0))
    part = part[i, j]
    saved = (len(q) * len(x) - len(i)) * (dims - cuts[1])
    for b in range(1, len(blocks)):
        for s in range(0, len(i), 1 << 18):
            at = slice(s, s + (1 << 18))
            part[at] += np.einsum("ij,ij->i", q_blocks[b][i[at]], blocks[b][j[at]])
        keep = hopeful(part, i, j, b)
        saved += (len(keep) - int(keep.sum())) * (dims - cuts[b + 1])
        i, j, part = i[keep], j[keep], part[keep]
    other = ids[j] != qid[i]
    i, j = i[other], j[other]
    score = np.concatenate([(x[j[s: s + (1 << 17)]] * q[i[s: s + (1 << 17)]]).sum(1) for s in range(0, len(i), 1 << 17)] or [np.zeros(0)])
    reach = score >= limit[i]
    i, j, score = i[reach], j[reach], score[reach]
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k], score[place < k], saved


def _bytes(*arrays) -> list[pa.Array]:
    return [pa.array([a.tobytes()], pa.binary()) for a in arrays]


def search(vectors: DataFrame, is_query, k: int = NEIGHBOURS, lists: int | None = None, probes: int | None = None, columns: int = COLUMNS,
           z: float = Z, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score of the k largest inner products found; `is_query` is a condition on vec_id."""
    spark = vectors.sparkSession
    # Rows are written once, so their running numbers stay the same if a task is repeated.
    rows = cut_lineage(usable(vectors)).withColumn("row", F.monotonically_increasing_id())
    index = Index.fit(rows, lists, probes, sample, k=k)
    dims = len(index.turn)
    shipped = spark.sparkContext.broadcast(index)

    @F.arrow_udf("int")
    def own_list(v: pa.Array) -> pa.Array:
        return pa.array(shipped.value.list_of(_matrix(v, dims) @ shipped.value.turn).astype(np.int32)) if len(v) else pa.array([], pa.int32())

    dealt = rows.withColumn("list", own_list("v"))
    sizes = dealt.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).alias("stripes"))  # a row per list
    salted = dealt.join(F.broadcast(sizes), "list").withColumn("stripe", F.pmod(F.xxhash64("row"), "stripes").cast("int"))

    def pack(batches):
        """Candidates of one list and stripe after the other, as blocks."""
        held, name, made = [], None, 0

        def block():
            parts = [np.concatenate(c) for c in zip(*held)]
            return [pa.record_batch([pa.array([name[0]], pa.int32()), *_bytes(*[v[s: s + 2 * BLOCK_ROWS] for v in parts])], names=["list", "ids", "rows", "x"])
                    for s in range(0, len(parts[0]), 2 * BLOCK_ROWS)]

        for batch in batches:
            if not batch.num_rows:
                continue
            which = np.c_[np.asarray(batch.column("list")), np.asarray(batch.column("stripe"))]
            ids, numbers, x = np.asarray(batch.column("vec_id")), np.asarray(batch.column("row")), _matrix(batch.column("v"), dims)
            cuts = np.r_[0, np.flatnonzero((which[1:] != which[:-1]).any(1)) + 1, len(which)]
            for a, b in zip(cuts, cuts[1:]):
                if held and tuple(which[a]) != name:
                    yield from block()
                    held = []
                name = tuple(which[a].tolist())
                held.append((ids[a:b], numbers[a:b], x[a:b]))
        if held:
            yield from block()

    candidates = (salted.select("list", "stripe", "vec_id", "row", "v").repartition("list", "stripe").sortWithinPartitions("list", "stripe")
                  .mapInArrow(pack, "list int, ids binary, rows binary, x binary").withColumn("block", F.monotonically_increasing_id()))

    def ask(batches):
        """Queries of a task with their first limits, in blocks by list."""
        parts = [(np.asarray(b.column("vec_id")), _matrix(b.column("v"), dims)) for b in batches if b.num_rows]
        if not parts:
            return
        own = shipped.value
        ids, x = (np.concatenate(c) for c in zip(*parts))
        low, asked = own.limits(ids, x, k), own.lists_for(x @ own.turn)
        for name in np.unique(asked):
            at = np.flatnonzero((asked == name).any(1))
            for s in range(0, len(at), QUERY_ROWS):
                some = at[s: s + QUERY_ROWS]
                yield pa.record_batch([pa.array([name], pa.int32()), *_bytes(ids[some], x[some], low[some])], names=["list", "qids", "qx", "low"])

    def ask_sample(batches):
        own = shipped.value
        for batch in batches:
            if batch.num_rows:
                ids, x = np.asarray(batch.column("vec_id")), _matrix(batch.column("v"), dims)
                i, j = np.nonzero((top := own.best(ids, x, k)) >= 0)
                j = top[i, j]
                yield hits(ids[i], tags(x)[i], own.rows[j], own.ids[j], (own.x[j] * x[i]).sum(1))

    asking = cut_lineage(rows.where(is_query).select("vec_id", "v").dropDuplicates(["vec_id", "v"]))
    tasks = max(1, math.ceil(asking.count() / QUERY_TASK))
    queries = asking.repartition(tasks).mapInArrow(ask, "list int, qids binary, qx binary, low binary").withColumn("qblock", F.monotonically_increasing_id())
    # The pairs of blocks are dealt evenly, whatever the size of their list.
    met = candidates.join(queries, "list").repartition(F.col("block"), F.col("qblock"))

    def run(batches):
        turn = shipped.value.turn
        for batch in batches:
            for ids, numbers, x, qids, qx, low in zip(*(batch.column(c).to_pylist() for c in ("ids", "rows", "x", "qids", "qx", "low"))):
                ids, numbers, qids, low = (np.frombuffer(v, t) for v, t in ((ids, np.int64), (numbers, np.int64), (qids, np.int64), (low, np.float64)))
                x, qx = (np.frombuffer(v, np.float64).reshape(-1, dims) for v in (x, qx))
                i, j, score, _ = scan(ids, x, x @ turn, qids, qx, qx @ turn, low, k, columns, z)
                yield hits(qids[i], tags(qx)[i], numbers[j], ids[j], score)

    # The sample's best are known anyway, so no query is left with fewer than k if there are as many vectors.
    found = met.mapInArrow(run, HITS).unionByName(asking.mapInArrow(ask_sample, HITS))
    order = Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id", "row")
    placed = found.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= k).withColumn("twice", F.lag("row").over(order) == F.col("row"))
    return placed.where("twice IS NULL OR NOT twice").select("query_id", F.col("place").cast("int").alias("rank"), "vec_id", "score")


HITS = "query_id long, tag long, row long, vec_id long, score double"


def hits(*columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c) for c in columns], names=["query_id", "tag", "row", "vec_id", "score"])


def tags(q: np.ndarray) -> np.ndarray:
    """Tells queries of one id with different vectors apart."""
    return np.array([xxhash.xxh3_64_intdigest(v.tobytes()) >> 1 for v in q], np.int64)
