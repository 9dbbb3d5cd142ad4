"""SimHash near-duplicates by an inverted index over byte positions with count filtering.

A fingerprint of 64 bits is eight bytes at eight positions. Two that differ in at most `BITS` = 3 bits differ in at most three bytes, so
they share at least five positional bytes. Pairs are found in an inverted index of positional bytes, tallied, kept from five shared
ones on, and verified by their differing bits. A list for a single byte would hold a 256th of all fingerprints; as five shared
bytes leave three shared in the first or in the second half of the positions, a list is kept for every combination of three
positions of a half and their values (eight entries per fingerprint), and what meets there is tallied over all eight positions.

Fingerprints are made distinct before they are indexed, so copies cost nothing. Long lists (families of templates) are striped:
entries are dealt to stripes and every pair of stripes is a group of its own, of bounded size. A group reports a spanning forest of its links, not
the links; components run on the forests. The answer returns to documents by an equi-join; the few fingerprints that hold more than
a `HOT_SHARE`-th of all documents are answered from a broadcast of at most that many rows.

Null text and text without words have fingerprint zero and are linked like any other. Repeated rows are answered each. A row with a
null doc_id has a fingerprint but neither links anything nor has a component. Columns other than doc_id and text are not carried. An empty
table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import cut_lineage
from .base import text_slices, texts_of

WORDS = 3
SEED = 42
BITS = 3
# Positional bytes that a list's entries share, three of one half.
KEYS = [c for half in (range(0, 4), range(4, 8)) for c in itertools.combinations(half, 3)]
# Entries of a list or stripe that meet in one group.
STRIPE = 2048
HOT_SHARE = 256
LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)
HIGH = np.uint64(0x8080808080808080)


def shingle_hashes(words: list[bytes], size: int = WORDS) -> list[int]:
    """Hashes of the shingles of a document, repeats included."""
    if not words:
        return []
    if len(words) < size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    return [xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(words[k:] for k in range(size)))]


def majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per document the bits that over half of its hashes have."""
    out = np.zeros(len(starts) - 1, np.uint64)
    sizes = np.diff(starts)
    some = np.flatnonzero(sizes)
    if len(some):
        for bit in range(64):
            ones = np.add.reduceat((hashes >> np.uint64(bit)).astype(np.uint8) & 1, starts[some], dtype=np.int64)
            out[some] |= (2 * ones > sizes[some]).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """(doc_id, print long) of every row."""
    def run(batches):
        for batch in text_slices(batches):
            # bytes.lower() changes A-Z only, bytes.split() knows exactly the six separators.
            lists = [shingle_hashes(t.encode().lower().split(), size) for t in texts_of(batch)]
            starts = np.r_[0, np.cumsum([len(x) for x in lists], dtype=np.int64)]
            hashes = np.fromiter(itertools.chain.from_iterable(lists), np.uint64, starts[-1])
            yield pa.record_batch([batch.column("doc_id"), pa.array(majority(hashes, starts).view(np.int64))], names=["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, print long")


def linked(x: np.ndarray, y: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Which pairs share enough positional bytes and differ in few enough bits."""
    differ = x ^ y
    # The high bit of every byte that is not zero.
    apart = ((differ & LOW7) + LOW7 | differ) & HIGH
    tally = 8 - np.bitwise_count(apart)
    near = tally >= 8 - bits
    near[near] = np.bitwise_count(differ[near]) <= bits
    return near


def roots(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels after uniting the ends of the links: the smallest label that each reaches."""
    while True:
        low = np.minimum(label[a], label[b])
        old = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        if (label == old).all():
            return label


def forest(left: np.ndarray, right: np.ndarray | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, root) of the components among `left`, or among the pairs of `left` and `right`; only what hangs below a root."""
    every = left if right is None else np.concatenate([left, right])
    label = np.arange(len(every))
    other = left if right is None else right
    shift = 0 if right is None else len(left)
    step = max(1, (1 << 19) // max(1, len(other)))
    for s in range(0, len(left), step):
        x, start = left[s: s + step], s if right is None else 0
        grid = linked(np.repeat(x, len(other) - start), np.tile(other[start:], len(x)), bits).reshape(len(x), -1)
        i, j = np.nonzero(grid)
        i, j = i + s, j + start + shift
        open_ = label[i] != label[j]
        if open_.any():
            label = roots(i[open_], j[open_], label)
    below = np.flatnonzero(label != np.arange(len(every)))
    return every[below], every[label[below]]


def short_lists(key: np.ndarray, value: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between entries of equal key, entries sorted by key: each is held against those at growing distance in its list."""
    left, right = [], []
    at, apart = np.arange(len(key)), 0
    while len(at):
        apart += 1
        at = at[at + apart < len(key)]
        at = at[key[at] == key[at + apart]]
        hit = at[linked(value[at], value[at + apart], bits)]
        left.append(value[hit])
        right.append(value[hit + apart])
    return np.concatenate(left or [value[:0]]), np.concatenate(right or [value[:0]])


# Lists up to this many entries are handled together, longer ones each as a matrix.
SHORT = 48


def group_links(key: np.ndarray, half: np.ndarray, value: np.ndarray, bits: int = BITS):
    """Links of whole groups, sorted by key. In a group of two stripes `half` says which one an entry is of (else it is 0)."""
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    sizes = np.diff(cuts)
    two = np.maximum.reduceat(half, cuts[:-1]) != 0
    brief = np.repeat((sizes <= SHORT) & ~two, sizes)
    yield short_lists(key[brief], value[brief], bits)
    for k in np.flatnonzero((sizes > SHORT) | two):
        part, side = value[cuts[k]: cuts[k + 1]], half[cuts[k]: cuts[k + 1]]
        if two[k]:
            yield forest(part[side == 0], part[side == 1], bits)
        else:
            yield forest(part, None, bits)


def links(prints: DataFrame, bits: int = BITS, stripe: int = STRIPE) -> DataFrame:
    """(src, dst) that connect what links connect, from distinct fingerprints (print long). Not every link is a row of its own."""
    def byte(k):
        return F.shiftright("print", 8 * k).bitwiseAND(F.lit(255))

    # The values of three positions and, above them, which three.
    keys = [F.lit(k << 24) + F.shiftleft(byte(a), 16) + F.shiftleft(byte(b), 8) + byte(c) for k, (a, b, c) in enumerate(KEYS)]
    entries = prints.select("print", F.explode(F.array(*keys)).alias("list"))
    sizes = entries.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "list", "n", F.ceil(F.col("n") / F.lit(stripe)).cast("int").alias("stripes"))
    # A list with over a HOT_SHARE-th of the fingerprints would burden one task of an exchange; fewer than 8 * HOT_SHARE can have as many.
    hot = F.col("n") * HOT_SHARE > prints.count()
    often = F.broadcast(sizes.where(hot).select("list", "stripes"))
    rest = entries.join(often, "list", "left_anti").join(sizes.where(~hot).select("list", "stripes"), "list")
    dealt = entries.join(often, "list").select("print", "list", "stripes").unionByName(rest.select("print", "list", "stripes"))
    own = F.pmod(F.xxhash64("print"), F.col("stripes")).cast("int")
    # A stripe meets itself and every other: group (low, high), in which `half` marks entries of the higher one.
    met = (dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)))
           .select("print", "list", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                   (F.col("own") > F.col("other")).cast("int").alias("half")))

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            name = [np.asarray(table.column(c)) for c in ("list", "low", "high")]
            new = np.flatnonzero(np.any([v[1:] != v[:-1] for v in name], axis=0)) + 1
            # The last group may go on in the next batch.
            whole = int(new[-1]) if len(new) else 0
            if whole:
                yield from answer(table.slice(0, whole))
            held = table.slice(whole)
        if held is not None:
            yield from answer(held)

    def answer(table):
        name = [np.asarray(table.column(c)) for c in ("list", "low", "high")]
        key = np.r_[0, np.cumsum(np.any([v[1:] != v[:-1] for v in name], axis=0))]
        for a, b in group_links(key, np.asarray(table.column("half")), np.asarray(table.column("print")).view(np.uint64), bits):
            if len(a):
                yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["src", "dst"])

    # Groups are whole in a task and in order.
    grouped = met.repartition("list", "low", "high").sortWithinPartitions("list", "low", "high")
    return grouped.mapInArrow(run, "src long, dst long")


def components(docs: DataFrame, size: int = WORDS, bits: int = BITS, stripe: int = STRIPE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links, a document's own included."""
    rows = cut_lineage(fingerprints(docs, size))
    prints = cut_lineage(rows.where("doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    edges = cut_lineage(links(prints.select("print"), bits, stripe).distinct())
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    named = connected_components(edges, nodes).select(F.col("id").alias("print"), "component")
    held = prints.join(named, "print", "left").select("print", "least", "n", F.coalesce("component", "print").alias("component"))
    low = held.groupBy("component").agg(F.min("least").alias("component_id"))
    found = cut_lineage(held.join(low, "component").select("print", "n", "component_id"))
    # Fewer than HOT_SHARE fingerprints can each hold more than that share of the documents.
    total = found.agg(F.sum("n")).first()[0] or 0
    hot = found.where(F.col("n") * HOT_SHARE > total).select("print", "component_id")
    often = [r.print for r in hot.collect()]
    is_hot = F.col("print").isin(often) if often else F.lit(False)
    some = rows.where(is_hot).join(F.broadcast(hot), "print")
    rest = rows.where(~is_hot).join(found.where(~is_hot).select("print", "component_id"), "print", "left")
    out = some.unionByName(rest.select(*some.columns))
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), component.alias("component_id"))
