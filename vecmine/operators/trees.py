"""Random trees and forests: every node parts its rows by the nearer of two centres on a few attributes.

A node draws attributes by hash of (seed, tree, node, try), takes the mean of its smallest class and the mean of all other rows there,
and sends a row right if the rest's mean is closer in Manhattan distance. A try that leaves a side empty is repeated with more
attributes (1, 4, 9 ... times as many); if none parts the rows, the node becomes a leaf with a class drawn from those present. A node of one
class is a leaf; at `depth` the most frequent class is.

All trees grow at once, one level per pass. A pass routes the rows through what is grown and sums, for every open node and try, both
sides' rows per class; the sums choose the try and are the next level's class statistics at the same time. Trees differ by the rows'
multiplicities (an array column `w`, one entry per tree, Poisson draws by hash of the id), so bags cost no exchange and no copies.
The grown nodes are shipped to the tasks while they fit the broadcast limit; beyond it rows carry their node and meet the open nodes of
a level in a join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform
from ..session import broadcast_limit, collect_bounded, cut_lineage, one_row, settle_small
from .centroids import dims_of
from .classify import confusion_of, measures
from .pairs import matrix
from .stats import as_row, attribute_stats

# Chances of drawing at most 0, 1, 2, ... copies of a row: a Poisson distribution of mean one.
COPIES = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(12)]
# Rows a task works on at once; its partial sums leave it as one row per node, try, side and class.
CHUNK_ROWS = 100_000
SUMS = "tree int, node long, try int, side int, label string, n long, s array<double>"


def multiplicities(trees: int, seed: int = 1) -> Column:
    """How often every tree takes a row, from the row's id."""
    return F.array(*[sum((hash_uniform(F.col("id"), f"{seed}:bag:{t}") >= F.lit(c)).cast("int") for c in COPIES) for t in range(trees)])


def bagged(points: DataFrame, trees: int, seed: int = 1) -> DataFrame:
    """Points with `w`, written once so that the draws are not repeated on every pass."""
    return cut_lineage(points.select("id", "features", "label").withColumn("w", multiplicities(trees, seed)))


def try_sizes(dims: int, attributes: int) -> list[int]:
    """Attributes of the first, second, ... try of a node."""
    sizes = [min(dims, attributes)]
    while sizes[-1] < dims:
        sizes.append(min(dims, attributes * (len(sizes) + 1) ** 2))
    return sizes


def _chunks(batches, most: int = CHUNK_ROWS):
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _right(columns: np.ndarray, zero: np.ndarray, rest: np.ndarray, masks: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether the rest's mean is closer in Manhattan distance on the attributes of the mask, summed in the order of the attributes. Rows are
    columns of the first matrix, nodes those of the next three; row i asks node k[i]."""
    left, right = np.zeros(columns.shape[1]), np.zeros(columns.shape[1])
    for a, x in enumerate(columns):
        mask = masks[a].take(k)
        for total, centre in ((left, zero), (right, rest)):
            gap = x - centre[a].take(k)
            np.abs(gap, out=gap)
            gap *= mask
            total += gap
    return left > right


def _columns(X: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(X.T)


class Local:
    """Nodes of all trees as arrays for the tasks."""

    def __init__(self, rows, dims: int, open_nodes=()):
        self.trees, self.leaves = {}, {}
        for r in [*rows, *open_nodes]:
            self.trees.setdefault(r["tree"], []).append(r)
        for t, nodes in self.trees.items():
            nodes.sort(key=lambda r: r["node"])
            k = len(nodes)
            zero, rest = np.zeros((k, dims)), np.zeros((k, dims))
            inner, masks = np.zeros(k, bool), np.zeros((k, dims))
            for i, r in enumerate(nodes):
                if r["zero"] is not None:
                    zero[i], rest[i] = r["zero"], r["rest"]
                if r["attrs"] is not None:
                    masks[i, r["attrs"]], inner[i] = 1.0, True
            ids = np.array([r["node"] for r in nodes], np.int64)
            # Position of an inner node's left child; the right one follows it.
            below = np.searchsorted(ids, 2 * ids)
            self.trees[t] = (ids, inner, _columns(masks), _columns(zero), _columns(rest), below, [r["tries"] for r in nodes])
            self.leaves[t] = [r["leaf"] for r in nodes]
        self.classes = sorted({c for leaves in self.leaves.values() for c in leaves if c is not None})
        code = {c: i for i, c in enumerate(self.classes)}
        self.codes = {t: np.array([code.get(c, -1) for c in leaves], np.int32) for t, leaves in self.leaves.items()}

    def place(self, t: int, columns: np.ndarray) -> np.ndarray:
        """Position, among the nodes of tree t, of the node every row (a column of the matrix) stops at."""
        _, inner, masks, zero, rest, below, _ = self.trees[t]
        at = np.zeros(columns.shape[1], np.int64)
        going = np.arange(len(at)) if len(inner) and inner[0] else at[:0]
        while len(going):
            k = at[going]
            k = below[k] + _right(columns if len(going) == len(at) else columns.take(going, axis=1), zero, rest, masks, k)
            at[going] = k
            going = going[inner[k]]
        return at

    def vote(self, t: int, columns: np.ndarray) -> np.ndarray:
        """Number in `classes` of the class that tree t gives every row; -1 for none."""
        return self.codes[t][self.place(t, columns)]


@dataclass
class Forest:
    """Grown trees. `table` has one row per node: inner nodes have `attrs` and two centres, leaves have `leaf`."""

    table: DataFrame
    rows: list | None
    trees: int
    depth: int
    dims: int

    def votes(self, points: DataFrame) -> DataFrame:
        """Points with `votes`, one class per tree."""
        if self.rows is not None:
            shared = points.sparkSession.sparkContext.broadcast(Local(self.rows, self.dims))
            trees = self.trees

            @F.arrow_udf("array<string>")
            def ask(v: pa.Array) -> pa.Array:
                X, model = _columns(matrix(v)), shared.value
                said = np.full((len(v), trees), -1, np.int32)
                for t in range(trees):
                    if t in model.trees:
                        said[:, t] = model.vote(t, X)
                flat = said.ravel()
                names = pa.array(model.classes, pa.string()).take(pa.array(flat, mask=flat < 0))
                return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * trees, pa.int32()), names)

            return points.withColumn("votes", ask("features"))
        state = points.select("id", "features", F.explode(F.sequence(F.lit(0), F.lit(self.trees - 1))).alias("tree"), F.lit(1).cast("long").alias("node"))
        nodes, ended = self.table.drop("tries"), None
        for _ in range(self.depth + 1):
            met = cut_lineage(state.join(nodes, ["tree", "node"]))
            done = met.where("attrs IS NULL").select("id", "tree", "leaf")
            ended = done if ended is None else ended.unionByName(done)
            state = met.where("attrs IS NOT NULL").select("id", "features", "tree", (2 * F.col("node") + _side(F.col("attrs"))).alias("node"))
        said = ended.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("tree", "leaf"))), lambda x: x["leaf"]).alias("votes"))
        return points.join(said, "id", "left")

    def transform(self, points: DataFrame) -> DataFrame:
        """Points with `predicted` (most votes, ties to the smaller class) and `distribution` (class -> share of votes)."""
        return with_majority(self.votes(points.drop("votes", "predicted", "distribution"))).drop("votes")


def _side(attrs: Column) -> Column:
    """1 where the rest's mean is closer, from columns features, zero and rest."""
    def apart(centre):
        terms = F.transform(attrs, lambda a: F.abs(F.get("features", a) - F.get(F.col(centre), a)))
        return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)

    return (apart("zero") > apart("rest")).cast("int")


def with_majority(voted: DataFrame, votes: Column | None = None) -> DataFrame:
    """Adds `predicted` and `distribution` from an array of votes; no vote gives null and an empty map."""
    votes = F.col("votes") if votes is None else votes

    def once(c: Column, fn) -> Column:
        """`fn` of a value that is worked out once, however often `fn` names it."""
        return F.get(F.transform(F.array(c), fn), 0)

    def tally(said: Column) -> Column:
        return F.transform(F.array_distinct(said), lambda c: F.struct((-F.size(F.filter(said, lambda v: v == c))).alias("less"), c.alias("label")))

    said = F.filter(votes, lambda v: v.isNotNull())
    both = once(said, lambda v: once(tally(v), lambda x: F.struct(
        F.array_min(x)["label"].alias("predicted"),
        F.map_from_entries(F.transform(x, lambda y: F.struct(y["label"], -y["less"] / F.size(v).cast("double")))).alias("distribution"))))
    return voted.withColumn("__said", both).withColumns({"predicted": F.col("__said.predicted"), "distribution": F.col("__said.distribution")}).drop("__said")


def _decided(stats: DataFrame, sizes: list[int], dims: int, seed: int, last: bool) -> DataFrame:
    """Nodes of a level from (tree, node, label, n, s, try): their centres, or the class of a leaf, the attributes of
    every try, and the try that parted their parent."""
    vec = array_to_vector("s")
    # Centres: the smallest class and all others.
    info = stats.groupBy("tree", "node").agg(
        F.first("try").alias("try"), F.count(F.lit(1)).alias("classes"), F.sum("n").alias("all"), vector_to_array(Summarizer.sum(vec)).alias("total"),
        F.min_by("n", "label").alias("n0"), F.min_by("s", "label").alias("s0"), F.min("label").alias("first"),
        F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("most"),
        F.min_by("label", F.struct(hash_uniform(F.col("label"), F.concat_ws(":", F.lit(seed), "tree", "node", F.lit("leaf"))), F.col("label"))).alias("drawn"))
    rest = F.zip_with("total", "s0", lambda t, z: (t - z) / (F.col("all") - F.col("n0")))
    tries = []
    for k, size in enumerate(sizes):
        tag = F.concat_ws(":", F.lit(seed), "tree", "node", F.lit(k))
        drawn = F.array_sort(F.array(*[F.struct(hash_uniform(F.lit(a), tag).alias("u"), F.lit(a).alias("a")) for a in range(dims)]))
        tries.append(F.array_sort(F.transform(F.slice(drawn, 1, size), lambda x: x["a"])))
    closed = (F.col("classes") == 1) | F.lit(last)
    return info.select(
        "tree", "node", F.when(F.col("classes") == 1, F.col("first")).when(F.lit(last), F.col("most")).alias("leaf"), "drawn",
        F.when(~closed, F.transform("s0", lambda x: x / F.col("n0"))).alias("zero"), F.when(~closed, rest).alias("rest"),
        F.when(~closed, F.array(*tries)).alias("tries"), "try")


def _shipped_sums(points: DataFrame, local: Local | None, trees: int, dims: int) -> DataFrame:
    """Sums of one pass by arrays; without nodes, those of the roots."""
    shared = points.sparkSession.sparkContext.broadcast(local)

    def run(batches):
        model = shared.value
        for table in _chunks(batches):
            X, names = _columns(matrix(table.column("features"))), table.column("label").combine_chunks().dictionary_encode()
            code, names = np.asarray(names.indices), names.dictionary.to_pylist()
            W = matrix(table.column("w"))
            for t in range(trees):
                if model is None:
                    here = np.flatnonzero(W[:, t] > 0)
                    yield from parts(t, np.ones(1, np.int64), np.zeros(len(here), np.int64), np.zeros(len(here), bool), 0, X[:, here], code[here], names, W[here, t])
                    continue
                ids, _, _, zero, rest, _, tries = model.trees.get(t, ((),) * 7)
                if not any(x is not None for x in tries):
                    continue
                here = np.flatnonzero(W[:, t] > 0)
                at = model.place(t, X.take(here, axis=1))
                asking = np.array([x is not None for x in tries])[at]
                here, at = here[asking], at[asking]
                mine, w, label = X.take(here, axis=1), W[here, t], code[here]
                for k in range(max(len(x) for x in tries if x is not None)):
                    masks = np.zeros((dims, len(tries)))
                    for i, x in enumerate(tries):
                        if x is not None:
                            masks[x[k], i] = 1.0
                    yield from parts(t, ids, at, _right(mine, zero, rest, masks, at), k, mine, label, names, w)

    def parts(t, ids, at, side, k, X, code, names, w):
        """Sums per node (its place in ids), side and class, all of them numbered as one."""
        if not len(at):
            return
        kinds = len(names)
        key, bins = (at * 2 + side) * kinds + code, 2 * len(ids) * kinds
        if bins > 4 * len(key):
            found, key = np.unique(key, return_inverse=True)
        else:
            found = np.flatnonzero(np.bincount(key, minlength=bins))
            place = np.zeros(bins, np.int64)
            place[found] = np.arange(len(found))
            key = place[key]
        size = len(found)
        sums = np.stack([np.bincount(key, weights=x * w, minlength=size) for x in X], axis=1)
        node, side, code = found // (2 * kinds), found // kinds % 2, found % kinds
        yield pa.record_batch([
            pa.array(np.full(size, t, np.int32)), pa.array(ids[node]), pa.array(np.full(size, k, np.int32)), pa.array(side.astype(np.int32)),
            pa.array([names[c] for c in code], pa.string()), pa.array(np.bincount(key, weights=w, minlength=size).astype(np.int64)),
            pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * dims, pa.int32()), pa.array(sums.ravel()))],
            names=["tree", "node", "try", "side", "label", "n", "s"])

    return points.select("features", "label", "w").mapInArrow(run, SUMS)


def _summed(parts: DataFrame, *by: str) -> DataFrame:
    total = parts.groupBy(*by).agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))
    return total.select(*by, "n", "s")


def grow(points: DataFrame, trees: int, attributes: int | None = None, depth: int = 8, seed: int = 1) -> Forest:
    """Trees over (id, features, label, w); `attributes` is the size of a node's first draw (the root of their number by default). Rows
    without a label teach nothing. `depth` bounds a tree at 2^depth leaves, whatever the number of rows."""
    spark = points.sparkSession
    dims = dims_of(points)
    if not dims:
        return Forest(_node_table(spark, []), [], trees, depth, 0)
    sizes = try_sizes(dims, attributes or max(1, int(math.sqrt(dims))))
    known = points.where("label IS NOT NULL")
    row_bytes = 16 * dims + 8 * len(sizes) * dims + 96
    most = max(1, broadcast_limit(spark) // row_bytes)
    nodes: list[dict] = []
    edge: list[dict] = []  # the level whose tries are being chosen
    stats = _summed(_shipped_sums(known, None, trees, dims).drop("try"), "tree", "node", "label").withColumn("try", F.lit(0))
    for level in range(depth + 2):
        info = _decided(stats, sizes, dims, seed, level == depth)
        rows = collect_bounded(info, row_bytes)
        if rows is None or len(nodes) + len(edge) + len(rows) > most:
            return _grow_as_table(known, nodes, edge, cut_lineage(info), level, trees, sizes, dims, depth, seed)
        nodes += _settled(edge, rows)
        edge = [r.asDict() | {"attrs": None} for r in rows]
        if all(r["leaf"] is not None for r in edge):
            break
        sums, _ = settle_small(_summed(_shipped_sums(known, Local(nodes, dims, edge), trees, dims), "tree", "node", "try", "side", "label"), row_bytes)
        stats = _children(sums, _chosen(sums))
    nodes += _settled(edge, [])
    return Forest(_node_table(spark, nodes), nodes, trees, depth, dims)


def _settled(edge: list[dict], below: list) -> list[dict]:
    """Nodes of a level once the nodes below it are known: those have the try that parted their parent."""
    taken = {(r["tree"], r["node"] >> 1): r["try"] for r in below}
    out = []
    for r in edge:
        k = taken.get((r["tree"], r["node"]))
        out.append(r | {"attrs": None if k is None else r["tries"][k], "tries": None,
                        "leaf": r["drawn"] if k is None and r["leaf"] is None else r["leaf"]})
    return out


def _chosen(sums: DataFrame) -> DataFrame:
    """(tree, node, try): the first try that leaves no side empty."""
    both = sums.groupBy("tree", "node", "try").agg(F.min("side").alias("lo"), F.max("side").alias("hi")).where("lo < hi")
    return both.groupBy("tree", "node").agg(F.min("try").alias("try"))


def _children(sums: DataFrame, chosen: DataFrame) -> DataFrame:
    return sums.join(chosen, ["tree", "node", "try"]).select("tree", (2 * F.col("node") + F.col("side")).alias("node"), "label", "n", "s", "try")


def _grow_as_table(known: DataFrame, nodes: list[dict], edge: list[dict], info: DataFrame, level: int, trees: int, sizes: list[int], dims: int,
                   depth: int, seed: int) -> Forest:
    """Growth from `level` on, `info` being its nodes: rows carry their node and meet a level's open nodes in a join."""
    spark = known.sparkSession
    # No more rows than the shipped level above has nodes.
    parents = info.select("tree", F.shiftright("node", 1).cast("long").alias("node"), "try").distinct().where("node > 0").collect()
    nodes = nodes + _settled(edge, [{"tree": r["tree"], "node": r["node"] << 1, "try": r["try"]} for r in parents])
    grown, state = _node_table(spark, nodes), _carried(known, nodes)
    for level in range(level, depth + 1):
        open_ = info.where("leaf IS NULL")
        if open_.isEmpty():
            grown = grown.unionByName(_closed(info, None))
            break
        met = cut_lineage(state.join(open_.drop("try"), ["tree", "node"]))
        vec = F.transform("features", lambda x: x * F.col("w"))
        parts = met.select("tree", "node", F.posexplode(F.transform("tries", _side)).alias("try", "side"), "label", F.col("w").cast("long").alias("n"), vec.alias("s"))
        sums = cut_lineage(_summed(parts, "tree", "node", "try", "side", "label"))
        chosen = cut_lineage(_chosen(sums))
        grown = cut_lineage(grown.unionByName(_closed(info, chosen)))
        if chosen.isEmpty():
            break
        side = F.get(F.transform("tries", _side), F.col("try"))
        state = met.join(chosen, ["tree", "node"]).select("tree", (2 * F.col("node") + side).alias("node"), "features", "label", "w")
        info = cut_lineage(_decided(_children(sums, chosen), sizes, dims, seed, level + 1 == depth))
    return Forest(grown, None, trees, depth, dims)


NODES = "tree int, node long, leaf string, attrs array<int>, zero array<double>, rest array<double>"


def _node_table(spark, nodes: list) -> DataFrame:
    return spark.createDataFrame([(r["tree"], r["node"], r["leaf"], r["attrs"], r["zero"], r["rest"]) for r in nodes], NODES)


def _closed(info: DataFrame, chosen: DataFrame | None) -> DataFrame:
    """Node rows of a level once its tries are chosen."""
    if chosen is None:
        return info.select("tree", "node", "leaf", F.lit(None).cast("array<int>").alias("attrs"), "zero", "rest")
    met = info.drop("try").join(chosen, ["tree", "node"], "left")
    leaf = F.when(F.col("leaf").isNotNull(), F.col("leaf")).when(F.col("try").isNull(), F.col("drawn"))
    return met.select("tree", "node", leaf.alias("leaf"), F.get("tries", F.col("try")).alias("attrs"), "zero", "rest")


def _carried(points: DataFrame, nodes: list) -> DataFrame:
    """(tree, node, features, label, w): every row once for each tree that takes it, at the node where the shipped nodes leave it."""
    every = points.select("features", "label", F.posexplode("w").alias("tree", "w")).where("w > 0")
    state = every.withColumn("node", F.lit(1).cast("long"))
    table = _node_table(points.sparkSession, nodes).where("attrs IS NOT NULL")
    levels = max((int(r["node"]).bit_length() for r in nodes), default=0)
    for _ in range(levels):
        met = state.join(table, ["tree", "node"], "left")
        step = F.when(F.col("attrs").isNull(), F.col("node")).otherwise(2 * F.col("node") + _side(F.col("attrs")))
        state = met.select("tree", step.alias("node"), "features", "label", "w")
    return state


# ---- trees and forests as classifiers ------------------------------------------------------------

def random_tree(train: DataFrame, attributes: int | None = None, depth: int = 8, seed: int = 1) -> Forest:
    """One tree over every row once."""
    return grow(train.select("id", "features", "label").withColumn("w", F.array(F.lit(1))), 1, attributes, depth, seed)


def random_forest(train: DataFrame, trees: int = 10, attributes: int | None = None, depth: int = 8, seed: int = 1) -> tuple[Forest, DataFrame]:
    """The forest and its training rows with their multiplicities."""
    rows = bagged(train, trees, seed)
    return grow(rows, trees, attributes, depth, seed), rows


def out_of_bag(forest: Forest, rows: DataFrame) -> DataFrame:
    """Rows with `predicted` and `distribution` from the trees that did not take them; null where every tree did."""
    held_out = F.filter(F.zip_with("votes", "w", lambda v, w: F.when(w == 0, v)), lambda v: v.isNotNull())
    return with_majority(forest.votes(rows), held_out).drop("votes")


def out_of_bag_error(forest: Forest, rows: DataFrame) -> DataFrame:
    """(tested, error): labelled rows that some tree did not take, and the share of them that such trees get wrong."""
    said = out_of_bag(forest, rows).where("predicted IS NOT NULL AND label IS NOT NULL")
    return said.agg(F.count(F.lit(1)).alias("tested"), F.avg((F.col("predicted") != F.col("label")).cast("double")).alias("error"))


VOTED = "attr int, label string, predicted string, n long"


def _majority(votes: np.ndarray, kinds: int) -> np.ndarray:
    """Most frequent class number of every row, ties to the smaller one; -1 (no vote) counts for nothing."""
    n = np.zeros(votes.shape, np.int64)
    for t in range(votes.shape[1]):
        n += votes == votes[:, t, None]
    best = np.where(votes < 0, -1, n * (kinds + 1) + (kinds - votes)).max(axis=1)
    return np.where(best < 0, -1, kinds - best % (kinds + 1))


def _permuted_counts(forest: Forest, rows: DataFrame) -> DataFrame:
    """(attr, label, predicted, n): out-of-bag votes on rows (features, label, w), untouched (attr -1) and with every attribute in turn taken
    from `other`. A task votes on its rows in place, so neither changed rows nor votes leave it."""
    shared, trees = rows.sparkSession.sparkContext.broadcast(Local(forest.rows, forest.dims)), forest.trees

    def run(batches):
        model = shared.value
        kinds = len(model.classes)
        for table in _chunks(batches):
            X, Z, W = _columns(matrix(table.column("features"))), _columns(matrix(table.column("other"))), matrix(table.column("w"))
            names = table.column("label").combine_chunks().dictionary_encode()
            label, names = np.asarray(names.indices), names.dictionary.to_pylist()
            out = [(t, np.flatnonzero(W[:, t] == 0)) for t in range(trees) if t in model.trees]
            plain = np.full((W.shape[0], trees), -1, np.int32)
            for a in range(-1, len(X)):
                votes = plain if a < 0 else plain.copy()
                whole = a < 0 or not (np.isnan(X[a]).any() or np.isnan(Z[a]).any())
                for t, here in out:
                    # A tree that never asks for the attribute stays with its vote; a missing value speaks in every sum.
                    if a >= 0 and whole and not model.trees[t][2][a].any():
                        continue
                    mine = X.take(here, axis=1)
                    if a >= 0:
                        mine[a] = Z[a].take(here)
                    votes[here, t] = model.vote(t, mine)
                said = _majority(votes, kinds)
                heard = np.flatnonzero(said >= 0)
                pair, n = np.unique(label[heard].astype(np.int64) * kinds + said[heard], return_counts=True)
                yield pa.record_batch([pa.array(np.full(len(n), a, np.int32)), pa.array([names[p // kinds] for p in pair], pa.string()),
                                       pa.array([model.classes[p % kinds] for p in pair], pa.string()), pa.array(n.astype(np.int64))],
                                      names=["attr", "label", "predicted", "n"])

    parts = rows.select("features", "other", "label", "w").mapInArrow(run, VOTED)
    return parts.groupBy("attr", "label", "predicted").agg(F.sum("n").alias("n"))


def permutation_scores(forest: Forest, rows: DataFrame, seed: int = 1) -> DataFrame:
    """(attr, score): how far the out-of-bag sum of the classes' F-measures falls when an attribute is replaced by uniform values of its
    range, scaled to 0..1. The untouched rows and every changed attribute are voted on in one pass."""
    box = one_row(as_row(attribute_stats(rows).select("attr", "min", "max")))
    known = rows.where("label IS NOT NULL").withColumn("box", box)

    def random(a: Column) -> Column:
        lo, hi = F.get("box.min", a), F.get("box.max", a)
        return lo + hash_uniform(F.concat_ws("|", "id", a), f"{seed}:noise") * (hi - lo)

    if forest.rows:
        pairs = _permuted_counts(forest, known.withColumn("other", F.array(*[random(F.lit(a)) for a in range(forest.dims)])))
    else:
        every = known.withColumn("attr", F.explode(F.sequence(F.lit(-1), F.size("features") - 1)))
        changed = F.transform("features", lambda x, i: F.when(i == F.col("attr"), random(F.col("attr"))).otherwise(x))
        every = every.withColumn("features", changed).drop("box")
        # Votes meet rows again by id, so a changed row needs one of its own.
        said = out_of_bag(forest, every.withColumn("id", F.concat_ws("|", "id", "attr"))).where("predicted IS NOT NULL")
        pairs = said.groupBy("attr", "label", "predicted").agg(F.count(F.lit(1)).alias("n"))
    per = measures(confusion_of(cut_lineage(pairs), "attr")).groupBy("attr").agg(F.sum("f_measure").alias("f"))
    per = cut_lineage(per)
    drop = per.where("attr >= 0").withColumn("drop", per.where("attr = -1").select("f").scalar() - F.col("f"))
    span = one_row(drop.agg(F.min("drop").alias("lo"), F.max("drop").alias("hi")))
    share = F.try_divide(F.col("drop") - F.col("s.lo"), F.col("s.hi") - F.col("s.lo"))
    return drop.withColumn("s", span).select("attr", F.coalesce(share, F.lit(0.0)).alias("score"))
