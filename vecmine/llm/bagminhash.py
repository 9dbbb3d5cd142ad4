"""Near duplicates by BagMinHash: signatures of multisets of word shingles, banding, exact check, components.

The weight of a shingle is how often it occurs. The weight axis is cut into the dyadic blocks [0,1), [1,2), [2,4), ...; every
(shingle, block) owns a Poisson process whose rate is the block's length and whose points carry a register and a place in
the block. A text sees the points below its weights; register i keeps the earliest point that falls to it. Two texts have
the same point there with the probability of their weighted Jaccard similarity, sum of minima over sum of maxima. Points
come in order of time, so an element is done when its next point is later than all registers. Times are summed strictly from left
to right, so that a text has the same signature to the last bit whatever else its task works on.

Texts with the same words are one node. Nodes that share a band meet at the band's most connected node; the pair is checked on
the shingles themselves. Where a band then still holds several components, everything outside the largest one meets everything
in other components, in the first band whose key both have; so every pair that shares a band is either connected or checked.
Similar pairs share no band with a probability of less than 1e-5 at the limit. The class of a document is the smallest
doc_id of its component.

Texts of one to four words are one shingle. Null, empty and wordless texts are classes of their own (class_id = doc_id).
Rows with a null doc_id belong to the class of their text, but do not name it. Repeated rows get the same class. An empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import cut_lineage, release_unused
from .base import GOLD, WordHashes, aside, flat, mix, shingles, text_slices, texts_of, words_of

SHINGLE = 5
LIMIT = 0.8
BANDS, ROWS = 32, 5
BLOCK_NODES = 512
BLOCK_TEXTS = 3000
# Shingles that a pair of blocks holds at once for its exact checks, or those of one text.
BLOCK_SHINGLES = 400_000
_U = 1.0 / (1 << 53)


def multisets(h: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, shingle, count), sorted by owner and shingle."""
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])]) if len(h) else np.zeros(0, np.int64)
    return own[first], h[first], np.diff(np.r_[first, len(h)])


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * _U


def signatures(own: np.ndarray, item: np.ndarray, count: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """Earliest time per text and register; infinite for texts without items."""
    sig = np.full((texts, registers), np.inf)
    if not len(own):
        return sig
    # Blocks of the weight axis: number 0 is [0, 1), number k is [2^(k-1), 2^k).
    blocks = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 2))).astype(np.int64) + 1, 1)
    at = np.repeat(np.arange(len(own)), blocks)
    k = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low = np.where(k > 0, 2.0 ** (k - 1), 0.0)
    rate = np.where(k > 0, low, 1.0)
    doc, weight = own[at], count[at].astype(float)
    seed = mix(item[at] + GOLD * (k + 1).astype(np.uint64))
    time, number = np.zeros(len(at)), 0
    latest = np.full(texts, np.inf)
    flat_sig = sig.reshape(-1)
    while len(doc):
        many = int(np.clip(40_000 // len(doc), 1, 64))
        step = (np.arange(number, number + many, dtype=np.uint64) + np.uint64(1)) * GOLD
        x = mix(seed[:, None] + step[None, :])
        # The carried time is the first summand: the rounding does not depend on where chunks begin.
        when = np.cumsum(np.concatenate([time[:, None], -np.log(_uniform(x)) / rate[:, None]], axis=1), axis=1)[:, 1:]
        place = mix(x ^ np.uint64(0x94D049BB133111EB))
        register = ((place >> np.uint64(40)) % np.uint64(registers)).astype(np.int64)
        inside = low[:, None] + np.floor((place & np.uint64(0xFFFFFFFF)).astype(np.float64) / 4294967296.0 * rate[:, None]) < weight[:, None]
        inside &= when < latest[doc][:, None]
        np.minimum.at(flat_sig, (doc[:, None] * registers + register)[inside], when[inside])
        number += many
        live = np.unique(doc) if len(doc) < 64 else np.flatnonzero(np.bincount(doc, minlength=texts))
        latest[live] = sig[live].max(1)
        time = when[:, -1]
        keep = time < latest[doc]
        doc, seed, rate, low, weight, time = doc[keep], seed[keep], rate[keep], low[keep], weight[keep], time[keep]
    return sig


def _sketch(lists: list[list[bytes]], memo: WordHashes, bands: int, rows: int) -> np.ndarray:
    """Band keys [texts x bands] of texts with words."""
    words, offsets = flat(memo, lists)
    own, item, count = multisets(*shingles(words, offsets, SHINGLE))
    sig = signatures(own, item, count, len(lists), bands * rows)
    bits = mix(sig.view(np.uint64))
    key = np.zeros((len(lists), bands), np.uint64)
    cells = bits.reshape(len(lists), bands, rows)
    for r in range(rows):
        key = mix(key * GOLD + cells[:, :, r])
    return mix(key + np.arange(1, bands + 1, dtype=np.uint64)[None, :])


NODE = "doc_id long, tkey long, node binary, lo long, bands array<long>"


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, hash of the text, node (128-bit name of the words, null without words), its lower half, band keys."""
    def run(batches):
        memo = WordHashes()
        for part in text_slices(batches):
            ids = part.column("doc_id").cast(pa.int64())
            lists = words_of(texts_of(part))
            for a in range(0, len(lists), BLOCK_TEXTS):
                some = lists[a: a + BLOCK_TEXTS]
                key = _sketch(some, memo, bands, rows)
                names = [xxhash.xxh3_128_digest(b" ".join(x)) if x else None for x in some]
                lo = np.array([int.from_bytes(n[8:], "big", signed=True) if n else 0 for n in names], np.int64)
                yield pa.record_batch(
                    [ids.slice(a, len(some)), part.column("tkey").slice(a, len(some)), pa.array(names, pa.binary()), pa.array(lo),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, bands), pa.int32()), pa.array(key.view(np.int64).reshape(-1)))],
                    names=["doc_id", "tkey", "node", "lo", "bands"])

    return docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text").mapInArrow(run, NODE)


def _packed(docs: DataFrame) -> DataFrame:
    """(node, lo, z) per row with words: its words squeezed."""
    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for part in text_slices(batches):
            data = [b" ".join(x) for x in words_of(texts_of(part)) if x]
            names = [xxhash.xxh3_128_digest(d) for d in data]
            yield pa.record_batch([pa.array(names, pa.binary()), pa.array([int.from_bytes(n[8:], "big", signed=True) for n in names], pa.int64()),
                                   pa.array([press.compress(d) for d in data], pa.binary())], names=["node", "lo", "z"])

    return docs.select("text").mapInArrow(run, "node binary, lo long, z binary")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two (shingle ascending, count) multisets."""
    both, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][ia], b[1][ib]).sum())
    total = int(a[1].sum() + b[1].sum()) - least
    return least / total if total else 1.0


def _texts(docs: DataFrame, reps: DataFrame, los: DataFrame) -> DataFrame:
    """(node, lo, z) of the nodes whose `lo` is listed; of copies only the smallest doc_id's text travels."""
    wanted = reps.select("doc_id", "lo").join(los.distinct(), "lo", "left_semi")
    ids = wanted.select(F.col("doc_id").alias("_id")).distinct()
    some = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return cut_lineage(_packed(some).dropDuplicates(["node"]))


def _bag(z: bytes, press, memo: WordHashes):
    words = memo.of(press.decompress(z).split())
    return multisets(*shingles(words, np.array([0, len(words)]), SHINGLE))[1:]


def checked(docs: DataFrame, reps: DataFrame, pairs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(src, dst) nodes of those (a, b) pairs of `lo` values whose texts are similar enough."""
    texts = _texts(docs, reps, pairs.select(F.explode(F.array("a", "b")).alias("lo")))
    left = texts.select(F.col("lo").alias("a"), F.col("node").alias("src"), F.col("z").alias("za"))
    right = texts.select(F.col("lo").alias("b"), F.col("node").alias("dst"), F.col("z").alias("zb"))
    joined = pairs.join(right, "b").join(left, "a").select("src", "dst", "za", "zb")

    def run(batches):
        press, memo = zstandard.ZstdDecompressor(), WordHashes()
        last: tuple = (None, None)

        for batch in batches:
            keep = []
            for src, za, zb in zip(*(batch.column(c).to_pylist() for c in ("src", "za", "zb"))):
                if last[0] != src:
                    last = (src, _bag(za, press, memo))
                keep.append(similarity(last[1], _bag(zb, press, memo)) >= limit)
            yield batch.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "src binary, dst binary")


def _blocks(rows: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Rows (band, pos, lo, r) of a band gathered into blocks of about BLOCK_NODES, with what is known of the nodes."""
    sizes = rows.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_NODES)).alias("k"))
    dealt = rows.join(sizes, "band").select("band", "pos", "lo", "r", F.pmod(F.xxhash64("lo"), F.col("k")).alias("c"))
    return dealt.join(known, "lo").groupBy("band", "pos", "c").agg(F.collect_list(F.struct("node", "r", "bands", "z")).alias(name)).drop("c")


def block_links(pos: int, xs: list[dict], ys: list[dict], bag, limit: float) -> list[tuple[bytes, bytes]]:
    """Links between the components of two blocks (node, r, bands, z) of a band: every pair of different components that has no
    earlier band in common is checked exactly, unless links found before have joined the two."""
    kx, ky = (np.array([v["bands"] for v in vs], np.int64) for vs in (xs, ys))
    _, comp = np.unique([v["r"] for v in xs] + [v["r"] for v in ys], return_inverse=True)
    cx, cy = comp[: len(xs)].copy(), comp[len(xs):].copy()
    here = np.stack([(kx[:, : pos + 1] == k[: pos + 1]).argmax(1) == pos for k in ky])
    bags: dict = {}
    links = []

    def held(v):
        if v["node"] not in bags:
            if sum(len(b[0]) for b in bags.values()) > BLOCK_SHINGLES:
                bags.clear()
            bags[v["node"]] = bag(v)
        return bags[v["node"]]

    def against(some: list[int], parts: list):
        """All ys against the xs `some`, whose bags are `parts`: sums of minima through one list of all their shingles."""
        by_size = np.argsort([p[1].sum() for p in parts], kind="stable")
        has, parts = np.array(some)[by_size], [parts[a] for a in by_size]
        names, slot = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        times, sizes = np.concatenate([p[1] for p in parts]), np.array([p[1].sum() for p in parts])
        starts, count = np.cumsum([0] + [len(p[0]) for p in parts]), np.zeros(len(names), np.int64)
        for i, y in enumerate(ys):
            if not (here[i, has] & (cx[has] != cy[i])).any():
                continue
            item, n = held(y)
            total = int(n.sum())
            # Similarity is at most the smaller size over the larger one, so the others need no check.
            a, b = np.searchsorted(sizes, total * limit * (1 - 1e-9)), np.searchsorted(sizes, total / limit * (1 + 1e-9), side="right")
            at = a + np.flatnonzero(here[i, has[a:b]] & (cx[has[a:b]] != cy[i]))
            if not len(at):
                continue
            own = np.minimum(np.searchsorted(names, item), len(names) - 1)
            known = names[own] == item
            own = own[known]
            count[own] = n[known]
            part = slice(starts[a], starts[b])
            least = np.add.reduceat(np.minimum(times[part], count[slot[part]]), starts[a:b] - starts[a])[at - a]
            count[own] = 0
            for j in has[at[least / (sizes[at] + total - least) >= limit]].tolist():
                if cx[j] != cy[i]:
                    old, new = cx[j], cy[i]
                    cx[cx == old] = new
                    cy[cy == old] = new
                    links.append((xs[j]["node"], y["node"]))

    some, parts, held_now = [], [], 0
    for j in np.flatnonzero((here & (cx[None, :] != cy[:, None])).any(0)).tolist():
        b = bag(xs[j])
        if some and held_now + len(b[0]) > BLOCK_SHINGLES:
            against(some, parts)
            some, parts, held_now = [], [], 0
        some.append(j)
        parts.append(b)
        held_now += len(b[0])
    if some:
        against(some, parts)
    return links


def _second_links(docs: DataFrame, shared: DataFrame, reps: DataFrame, roots: DataFrame, bands: int, rows: int, limit: float) -> DataFrame:
    """(src, dst): links between components that share a band, found by meeting whatever is outside a band's largest component
    with everything in the band, block by block inside tasks. A pair is looked at in the first band that it shares."""
    root_of = reps.select("node", "lo").join(roots, "node").select("lo", F.xxhash64("root").alias("r"))
    placed = shared.select("band", "pos", "lo").join(root_of, "lo")
    open_bands = placed.groupBy("band").agg(F.min("r").alias("r0"), F.max("r").alias("r1")).where("r0 <> r1").select("band")
    rest = cut_lineage(placed.join(open_bands, "band", "left_semi").select("band", "pos", "lo", "r"))
    if rest.isEmpty():
        return roots.select(F.col("node").alias("src"), F.col("root").alias("dst")).where("false")
    largest = (rest.groupBy("band", "r").agg(F.count(F.lit(1)).alias("n")).groupBy("band")
               .agg(F.max(F.struct("n", "r")).alias("top")).select("band", F.col("top.r").alias("top")))
    texts = _texts(docs, reps, rest.select("lo"))
    known = texts.join(reps.select("node", "bands"), "node").select("lo", "node", "bands", "z")
    outside = rest.join(largest, "band").where("r <> top").select(rest.columns)
    met = _blocks(rest, known, "x").join(_blocks(outside, known, "y").drop("pos"), "band").select("pos", "x", "y")

    def link(batches):
        press, memo = zstandard.ZstdDecompressor(), WordHashes()
        for batch in batches:
            for pos, xs, ys in zip(*(batch.column(c).to_pylist() for c in ("pos", "x", "y"))):
                found = block_links(pos, xs, ys, lambda v: _bag(v["z"], press, memo), limit)
                if found:
                    src, dst = zip(*found)
                    yield pa.record_batch([pa.array(src, pa.binary()), pa.array(dst, pa.binary())], names=["src", "dst"])

    return met.mapInArrow(link, "src binary, dst binary")


def classes(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, limit: float = LIMIT) -> DataFrame:
    """(doc_id, class_id, n_copies, tkey, root) per row of (doc_id, text); n_copies counts the rows with the same words."""
    all_rows = cut_lineage(sketches(docs, bands, rows))
    reps = cut_lineage(all_rows.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies"), F.first("lo").alias("lo"), F.first("bands").alias("bands")))
    listed = reps.select("lo", F.posexplode("bands").alias("pos", "band"))
    sizes = listed.groupBy("band").agg(F.min("lo").alias("least"), F.max("lo").alias("most"), F.count(F.lit(1)).alias("n"))
    shared = cut_lineage(listed.join(sizes.where("least < most").select("band", "n"), "band").select("band", "pos", "lo", "n"))
    # The pivot of a band is the node that meets most others over all its bands: the text that copies were made from, if it is there.
    degree = shared.groupBy("lo").agg(F.sum("n").alias("d"))
    ranked = shared.join(degree, "lo").select("band", "lo", "d")
    pivots = ranked.groupBy("band").agg(F.max(F.struct("d", "lo")).alias("p")).select("band", F.col("p.lo").alias("a"))
    pairs = cut_lineage(shared.select("band", "lo").join(pivots, "band").where("lo <> a").select("a", F.col("lo").alias("b")).distinct())
    del listed, sizes, degree, ranked, pivots
    release_unused(docs.sparkSession)
    first = cut_lineage(checked(docs, reps, pairs, limit))
    release_unused(docs.sparkSession)
    ids = reps.select(F.col("node").alias("id"))
    roots = connected_components(first, ids).select(F.col("id").alias("node"), F.col("component").alias("root"))
    # Both the search for further links and its stages read the components, so these are worked out once.
    roots = cut_lineage(roots)
    release_unused(docs.sparkSession)
    second = cut_lineage(_second_links(docs, shared, reps, roots, bands, rows, limit))
    release_unused(docs.sparkSession)
    if not second.isEmpty():
        # The links found join whole components, so only these are nodes now.
        of = {c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("src", "dst")}
        between = second.join(of["src"], "src").join(of["dst"], "dst").select(F.col("src_root").alias("src"), F.col("dst_root").alias("dst"))
        merged = connected_components(between, roots.select(F.col("root").alias("id")).distinct())
        roots = roots.join(merged.withColumnRenamed("id", "root"), "root").select("node", F.col("component").alias("root"))
    named = reps.select("node", "doc_id", "n_copies").join(roots, "node")
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    by_node = named.select("node", "root", "n_copies").join(smallest, "root")
    return all_rows.select("doc_id", "tkey", "node").join(by_node, "node", "left").select(
        "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"), "tkey", "root")


def one_of_each(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, limit: float = LIMIT) -> DataFrame:
    """One row of docs per class, that of the smallest doc_id (rows without one come last); wordless texts all stay. Of rows that agree in
    doc_id and text one stays, which of them is not defined. Columns may have any names."""
    docs, named = aside(docs, "doc_id", "text")
    found = cut_lineage(classes(docs, bands, rows, limit))
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "tkey")
    chosen = found.where("root IS NOT NULL").groupBy("root").agg(F.min(order).alias("o")).select("o.doc_id", "o.tkey")
    stay = chosen.unionByName(found.where("root IS NULL").select("doc_id", "tkey").distinct())
    again = cut_lineage(found.where("root IS NOT NULL").groupBy("doc_id", "tkey").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
    keyed = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_tkey": F.xxhash64("text")})

    def among(keys):
        keys = keys.select(F.col("doc_id").alias("_k"), F.col("tkey").alias("_t"))
        return keyed.join(keys, F.col("_id").eqNullSafe(F.col("_k")) & (F.col("_tkey") == F.col("_t")), "left_semi").drop("_id", "_tkey")

    if again.isEmpty():
        return named(among(stay))
    # Rows that repeat both doc_id and text: few, and only these are compared as whole rows.
    both = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("doc_id", "tkey")]
    twice = stay.alias("x").join(again.alias("y"), both[0] & both[1], "left_semi")
    single = stay.alias("x").join(again.alias("y"), both[0] & both[1], "left_anti")
    return named(among(single).unionByName(among(twice).dropDuplicates(["doc_id", "text"])))
