"""Hard negatives by lists shared within clusters of anchors (MAXIMUS style), on integer vectors.

Anchors are clustered by direction. For a cluster with centre c, whose members lie within angle t of c, a candidate x has with a member a
a product of at most |a| |x| cos(max(0, angle(x, c) - t)). Candidates are sorted by that bound once per cluster; every member
walks the same list and stops as soon as the bound certifies that nothing further can enter its answer.

Two walks: the first finds an anchor's positives (the best rows of its own label), the second, for each positive, the best rows of
other labels whose score lies between LOW percent of the positive's and the positive's. The first walk starts from limits that a bounded
sample proves; the second from the lower ends of the windows. Both stop only where the bound is strictly below what is held, so ties
by smaller vec_id come out exactly.

Candidates and anchors are cut into blocks of bounded size. The two meet in an equi-join on block numbers: a stated set of anchors
against all rows. A list is shared by a cluster's members within a pair of blocks; blocks report their best few rows, which one
window per anchor merges. Products are exact: in double precision where they stay below 2^53, in 64-bit integers beyond.

Rows with a null vec_id, label or vector, with a null or non-finite component, empty or of another length than most rows have, or with integer
vectors whose squared length exceeds 2^62 take no part. Zero vectors take part. Rows with an equal vec_id are never one another's positive or
negative; repeated rows are candidates each, and an anchor that is repeated with the same vector and label is asked once. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage, parallelism

POSITIVES = 5
NEGATIVES = 5
LOW = 80
SCALE = 256
CLUSTERS = 16
# Rows of the bounded sample that sets the first limits, and that the centres are fitted on.
SAMPLE = 4096
ANCHOR_ROWS = 4096
ROWS_LEAST, ROWS_MOST = 2048, 32_768
STEP = 512
EXACT = 2.0 ** 53


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, x array<long>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "n").first()
    floors = F.transform("v", lambda x: F.floor(x * scale).cast("double"))
    rows = rows.where(F.size("v") == (sizes["n"] if sizes else 0)).withColumn("v", floors)
    short = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) < F.lit(2.0 ** 62)
    return rows.where(short).select("vec_id", "label", F.col("v").cast("array<long>").alias("x"))


class Rows:
    """A block: vec_id, label and vectors as a matrix of doubles (exact below 2^53)."""

    def __init__(self, ids, labels, x):
        self.ids, self.labels, self.x = ids, labels, x
        self.size = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        # Doubles hold every partial sum exactly if the product of lengths does not reach 2^53.
        self.real = x.astype(np.float64)

    @classmethod
    def read(cls, ids: bytes, labels: bytes, x: bytes):
        ids = np.frombuffer(ids, np.int64)
        return cls(ids, np.frombuffer(labels, np.int64), np.frombuffer(x, np.int64).reshape(len(ids), -1))


def products(a: Rows, at: np.ndarray, b: Rows, which: np.ndarray) -> np.ndarray:
    """Integer products of some rows of a with some of b."""
    if a.size.max(initial=0) * b.size.max(initial=0) < EXACT:
        return np.rint(a.real[at] @ b.real[which].T).astype(np.int64)
    return a.x[at] @ b.x[which].T


def bounds(members: Rows, at: np.ndarray, rows: Rows, centre: np.ndarray) -> np.ndarray:
    """For every row at most |x| cos(max(0, angle to the centre - widest member)), as a factor of a member's length; never too small."""
    def angle(r: Rows, which):
        length = np.maximum(r.size[which], 1e-300)
        return np.arccos(np.clip(r.real[which] @ centre / length, -1.0, 1.0))

    widest = angle(members, at[members.size[at] > 0]).max(initial=0.0)
    return rows.size * np.cos(np.maximum(0.0, angle(rows, slice(None)) - widest - 1e-7)) + 1e-6 * rows.size


def walk(members: Rows, at: np.ndarray, rows: Rows, order: np.ndarray, bound: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool,
         step: int = STEP):
    """(slot, row, score) of the k best rows of every slot. A slot is a member `at[s]` with a window low .. high of scores; rows have the
    member's label (`same`) or another one, and never its vec_id. Rows come in `order` of falling bound. Also how many products were made."""
    n = len(at)
    best = np.full((n, k), np.iinfo(np.int64).min)
    who = np.full((n, k), -1)
    alive, made = np.arange(n), 0
    for s in range(0, len(order), step):
        # Nothing further reaches a window's lower end, or the k-th best that a slot holds.
        need = np.maximum(low[alive], best[alive, -1])
        going = np.floor(bound[order[s]] * members.size[at[alive]] * (1 + 1e-9) + 0.5) >= need
        alive, need = alive[going], need[going]
        if not len(alive):
            break
        some = order[s: s + step]
        people, back = np.unique(at[alive], return_inverse=True)
        score = products(members, people, rows, some)
        made += score.size
        score = score[back]
        mine = rows.labels[some][None, :] == members.labels[at[alive]][:, None]
        fits = (mine == same) & (rows.ids[some][None, :] != members.ids[at[alive]][:, None])
        fits &= (score >= need[:, None]) & (score <= high[alive][:, None]) & (score >= low[alive][:, None])
        r, c = np.nonzero(fits)
        if not len(r):
            continue
        changed = np.zeros(n, bool)
        changed[alive[r]] = True
        old, place = np.nonzero((who >= 0) & changed[:, None])
        slot, row = np.r_[old, alive[r]], np.r_[who[old, place], some[c]]
        value = np.r_[best[old, place], score[r, c]]
        by = np.lexsort((rows.ids[row], -value, slot))
        slot, row, value = slot[by], row[by], value[by]
        place = _places(slot)
        top = place < k
        who[slot[top], place[top]], best[slot[top], place[top]] = row[top], value[top]
    slot, place = np.nonzero(who >= 0)
    return slot, who[slot, place], best[slot, place], made


def shared_walks(members: Rows, cluster: np.ndarray, centres: np.ndarray, rows: Rows, owner: np.ndarray, low: np.ndarray, high: np.ndarray, k: int,
                 same: bool):
    """`walk` for slots of members `owner`, cluster by cluster over one sorted list each."""
    out, made = [], 0
    for c in np.unique(cluster[owner]) if len(rows.ids) else []:
        slots = np.flatnonzero(cluster[owner] == c)
        bound = bounds(members, owner[slots], rows, centres[c])
        order = np.argsort(-bound, kind="stable")
        slot, row, score, n = walk(members, owner[slots], rows, order, bound, low[slots], high[slots], k, same)
        made += n
        out.append((slots[slot], row, score))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), made
    return *(np.concatenate(x) for x in zip(*out)), made


def fit_centres(x: np.ndarray, clusters: int = CLUSTERS, rounds: int = 10) -> np.ndarray:
    """Unit centres of directions by spherical k-means."""
    length = np.sqrt((x ** 2).sum(1))
    x = x[length > 0] / length[length > 0, None]
    if not len(x):
        return np.zeros((1, x.shape[1]))
    centres = x[:: max(1, len(x) // clusters)][:clusters].copy()
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, 1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.sqrt((sums ** 2).sum(1))
        centres[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return centres


BLOCK = "ids binary, labels binary, x binary"


def packed(rows: DataFrame, blocks: int, name: str) -> DataFrame:
    """The rows dealt evenly to `blocks` blocks; column `name` numbers them from 0. The blocks are written, so that they stay as they are."""
    def run(batches):
        parts = [[np.asarray(b.column("vec_id")), np.asarray(b.column("label")), np.asarray(b.column("x").flatten())] for b in batches if b.num_rows]
        if parts:
            whole = (np.concatenate(c).tobytes() for c in zip(*parts))
            yield pa.record_batch([pa.array([v], pa.binary()) for v in whole], names=["ids", "labels", "x"])

    return cut_lineage(rows.repartition(blocks).mapInArrow(run, BLOCK).withColumn(name, F.spark_partition_id()))


def mine(vectors: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES, low_percent: int = LOW, scale: int = SCALE,
         clusters: int = CLUSTERS, sample: int = SAMPLE, anchor_rows: int = ANCHOR_ROWS, block_rows: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; `is_anchor` is a condition on vec_id."""
    spark = vectors.sparkSession
    rows = cut_lineage(usable(vectors, scale))
    anchors = cut_lineage(rows.where(is_anchor).distinct())
    n = rows.count()
    some = Rows(*_columns(rows.orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(sample)))
    picked = _columns(anchors.orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(sample))
    centres = fit_centres(picked[2].astype(np.float64), clusters)
    most = block_rows or max(ROWS_LEAST, min(ROWS_MOST, math.ceil(n / (2 * parallelism(spark)))))
    many, few = math.ceil(n / most), math.ceil(anchors.count() / anchor_rows)
    if not few:
        return spark.createDataFrame([], OUT)
    candidates, groups = packed(rows, many, "block"), packed(anchors, few, "group")
    spread = candidates.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(few - 1))))
    far = np.iinfo(np.int64).max

    def cluster_of(a: Rows):
        return np.argmax(a.real @ centres.T, 1)

    def sample_limits(a: Rows):
        """The score that an anchor's positives have at least, as the sample proves."""
        everyone = np.arange(len(a.ids))
        slot, _, score, _ = shared_walks(a, cluster_of(a), centres, some, everyone, np.full(len(everyone), -far), np.full(len(everyone), far), positives, True)
        limit = np.full(len(everyone), -far)
        full = np.flatnonzero(np.bincount(slot, minlength=len(everyone)) == positives)
        least = np.full(len(everyone), far)
        np.minimum.at(least, slot, score)
        limit[full] = least[full]
        return limit

    def add_limits(batches):
        for batch in batches:
            limits = [sample_limits(Rows.read(*row)).tobytes() for row in zip(*(batch.column(c).to_pylist() for c in ("ids", "labels", "x")))]
            yield pa.record_batch([batch.column(c) for c in ("group", "ids", "labels", "x")] + [pa.array(limits, pa.binary())],
                                  names=["group", "ids", "labels", "x", "limits"])

    started = groups.mapInArrow(add_limits, "group int, ids binary, labels binary, x binary, limits binary")

    def meet(held: DataFrame) -> DataFrame:
        """Every block of candidates with every group of anchors, each pair a row of its own key."""
        held = held.select("group", *[F.col(c).alias(f"a_{c}") for c in held.columns if c != "group"])
        copies = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
        parts = min(many * few, 8 * parallelism(spark))
        return spread.repartition(parts, "block", "group").hint("shuffle_hash").join(copies.repartition(parts, "block", "group"), ["block", "group"])

    def first(batches):
        for batch in batches:
            get = lambda c: batch.column(c).to_pylist()
            for g, ids, labels, x, a_ids, a_labels, a_x, limits in zip(*map(get, ("group", "ids", "labels", "x", "a_ids", "a_labels", "a_x", "a_limits"))):
                a, b = Rows.read(a_ids, a_labels, a_x), Rows.read(ids, labels, x)
                slot, row, score, _ = shared_walks(a, cluster_of(a), centres, b, np.arange(len(a.ids)), np.frombuffer(limits, np.int64),
                                                   np.full(len(a.ids), far), positives, True)
                yield _batch(group=np.full(len(slot), g, np.int32), slot=slot.astype(np.int32), vec_id=b.ids[row], score=score)

    best = _ranked(meet(started).mapInArrow(first, "group int, slot int, vec_id long, score long"), ["group", "slot"], positives)
    best = cut_lineage(best)
    # An anchor block's positives, at most `positives` for each of its rows, travel with it.
    named = best.groupBy("group").agg(F.collect_list(F.struct("slot", "rank", "vec_id", "score")).alias("found"))

    def windows(batches):
        for batch in batches:
            for g, ids, labels, x, found in zip(*(batch.column(c).to_pylist() for c in ("group", "ids", "labels", "x", "found"))):
                slot, rank, pid, score = (np.array([f[c] for f in found or ()], np.int64) for c in ("slot", "rank", "vec_id", "score"))
                order = np.lexsort((rank, slot))
                yield pa.record_batch([pa.array([g], pa.int32())] + [pa.array([v if isinstance(v, bytes) else v[order].tobytes()], pa.binary())
                                                                    for v in (ids, labels, x, slot, pid, score)],
                                      names=["group", "ids", "labels", "x", "slot", "pid", "score"])

    asked = groups.join(named, "group").mapInArrow(windows, "group int, ids binary, labels binary, x binary, slot binary, pid binary, score binary")

    def second(batches):
        for batch in batches:
            get = lambda c: batch.column(c).to_pylist()
            for g, ids, labels, x, a_ids, a_labels, a_x, owner, pid, top in zip(
                    *map(get, ("group", "ids", "labels", "x", "a_ids", "a_labels", "a_x", "a_slot", "a_pid", "a_score"))):
                a, b = Rows.read(a_ids, a_labels, a_x), Rows.read(ids, labels, x)
                owner, pid, top = (np.frombuffer(v, np.int64) for v in (owner, pid, top))
                # low_percent * top <= 100 * score, rounded up, without leaving 64 bits.
                low = top // 100 * low_percent - (-(top % 100 * low_percent) // 100)
                slot, row, score, _ = shared_walks(a, cluster_of(a), centres, b, owner, low, top, negatives, False)
                yield _batch(group=np.full(len(slot), g, np.int32), question=slot.astype(np.int32), anchor_id=a.ids[owner[slot]], positive_id=pid[slot],
                             positive_score=top[slot], vec_id=b.ids[row], score=score)

    schema = "group int, question int, anchor_id long, positive_id long, positive_score long, vec_id long, score long"
    found = _ranked(meet(asked).mapInArrow(second, schema), ["group", "question"], negatives)
    return found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _batch(**columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(v) for v in columns.values()], names=list(columns))


def _columns(rows: DataFrame):
    t = rows.toArrow().combine_chunks()
    ids, labels = np.asarray(t["vec_id"]), np.asarray(t["label"])
    x = np.asarray(t["x"].combine_chunks().flatten()) if len(ids) else np.zeros(0, np.int64)
    return ids, labels, x.reshape(len(ids), -1) if len(ids) else np.zeros((0, 1), np.int64)


def _places(owner: np.ndarray) -> np.ndarray:
    """The place of every entry among those of its owner, an owner's entries standing together."""
    at = np.arange(len(owner))
    return at - np.maximum.accumulate(np.where(np.r_[True, owner[1:] != owner[:-1]][: len(owner)], at, 0))


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
