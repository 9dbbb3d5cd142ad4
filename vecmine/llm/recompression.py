"""Substring dedup by recompression: words of long passages that an earlier document already holds are removed.

Each text's words are rewritten in `ROUNDS` rounds. A round first names runs of one symbol, then pairs of a symbol of the
left half of the alphabet followed by one of the right half. Names are 64-bit hashes of what they stand for, so they are
the same in every task without any exchange, and halves are bits of the name. A round may only touch symbols of at most
its cap of words (1, 2, 2); a run longer than that gets one name whatever its length and is left alone afterwards. What
happens to a symbol depends on its direct neighbours only, so a round can spoil at most one symbol of a run and one of a
pair at each end of a shared passage: `MARGIN` = 2 * (1 + 2 + 2) words. All symbols further inside are the same wherever
the passage stands.

A window of `WINDOW` words takes as its anchor the symbol of least mixed name among those that start in its middle part
(MARGIN words from its start, MARGIN + 4 from its end). Windows of equal words therefore have equal anchors at equal
places. Consecutive windows with one anchor form a stretch; a stretch is named by its words, its anchor by the words
that all its windows share. Spark then settles

1. anchors: those of one document only drop out;
2. stretches: the smallest doc_id with each name. Windows of the same stretch in a later document are repeats;
3. anchors that several different stretches share (edges of passages): the document that holds each such stretch first
   lists its windows, and the smallest doc_id of every window's words decides.

Both names (anchor and stretch or window) must agree, 128 bits together. Nothing is listed per window unless an anchor is
shared by different stretches, and a stretch is listed once however many documents hold it.

Windows are judged on the input. Windows repeated only inside one doc_id stay. Rows with a null doc_id neither lose words
nor make others lose any; null and empty texts have no words; rows with the same doc_id get the same treatment each (none
is the other's earlier document). An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .base import WordHashes, aside, mix, owners, pair_name, sha256, text_slices, texts_of, words_of

WINDOW = 50
CAPS = (1, 2, 2)
MARGIN = 2 * sum(CAPS)
LONGEST = 2 * max(CAPS)
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_RUN, _LONG = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def recompress(words: np.ndarray, own: np.ndarray, caps=CAPS) -> tuple[np.ndarray, np.ndarray]:
    """(names, first word of each symbol) after the rounds. Symbols never cross texts."""
    name, at = words, np.arange(len(words))
    still = np.zeros(len(words), bool)  # long runs, left alone
    for number, cap in enumerate(caps):
        if not len(name):
            break
        size = np.diff(np.r_[at, len(words)])
        active = (size <= cap) & ~still
        # Runs.
        same = np.r_[False, (name[1:] == name[:-1]) & (own[at[1:]] == own[at[:-1]]) & active[1:] & active[:-1]]
        first = np.flatnonzero(~same)
        count = np.diff(np.r_[first, len(name)])
        run = count > 1
        length = count * size[first]
        long = run & (length > cap)
        new, new_still = name[first].copy(), still[first] | long
        short = run & ~long
        new[short] = pair_name(new[short] ^ _RUN, count[short].astype(np.uint64))
        new[long] = mix(new[long] ^ _LONG)
        name, still, at = new, new_still, at[first]
        # Pairs.
        size = np.diff(np.r_[at, len(words)])
        active = (size <= cap) & ~still
        right = ((mix(name + np.uint64(number + 1)) >> np.uint64(17)) & np.uint64(1)).astype(bool)
        joined = np.zeros(len(name), bool)
        if len(name) > 1:
            joined[1:] = active[:-1] & active[1:] & ~right[:-1] & right[1:] & (own[at[1:]] == own[at[:-1]])
        head = np.flatnonzero(np.r_[joined[1:], False])
        name = name.copy()
        name[head] = pair_name(name[head], name[head + 1])
        keep = ~joined
        name, still, at = name[keep], still[keep], at[keep]
    return name, at


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Prefix:
    """Names of word runs from sums of word hash times a power of the place, modulo 2^64."""

    def __init__(self, words: np.ndarray):
        up, self.down = _powers(len(words) + 1)
        self.sums = np.r_[np.uint64(0), np.cumsum(words * up[:-1], dtype=np.uint64)]

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.down[a]

    def name(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(self.of(a, b))


class Windows:
    """Anchors and stretches of the windows of several texts laid end to end."""

    def __init__(self, words: np.ndarray, offsets: np.ndarray, window: int = WINDOW):
        n, own = len(words), owners(offsets)
        prefix = Prefix(words)
        self.starts = np.flatnonzero(own[: n - window + 1] == own[window - 1:]) if n >= window else np.zeros(0, np.int64)
        self.first = self.anchor = self.key = self.name = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        if not len(self.starts):
            return
        name, at = recompress(words, own)
        order = mix(name ^ np.uint64(0x2545F4914F6CDD1D))
        # Least mixed name among symbols starting in [s + MARGIN, s + window - MARGIN - LONGEST], leftmost of equals.
        span = window - 2 * MARGIN - LONGEST + 1
        value = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
        value[at] = order
        best, place = value, np.arange(n)
        width = 1
        while width < span:  # doubling: the least of [i, i + width)
            step = min(width, span - width)
            m = len(best) - step
            less = best[step:] < best[:m]
            best, place = np.where(less, best[step:], best[:m]), np.where(less, place[step:], place[:m])
            width += step
        middle = self.starts + MARGIN
        anchor, least = place[middle], best[middle]
        # No symbol starts there: the long run that covers the middle.
        none = least == np.uint64(0xFFFFFFFFFFFFFFFF)
        if none.any():
            anchor = anchor.copy()
            anchor[none] = at[np.searchsorted(at, middle[none], side="right") - 1]
        cut = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (np.diff(self.starts) != 1) | (none[1:] != none[:-1])])
        self.first = self.starts[cut]
        self.count = np.diff(np.r_[cut, len(self.starts)])
        # The anchor's key: the words that all windows with this anchor hold around it. For a covering run: its name.
        a, covered = anchor[cut], none[cut]
        key = prefix.of(np.maximum(a - MARGIN, 0), np.minimum(a + window - (span - 1 + MARGIN), n))
        if covered.any():
            key = key.copy()
            key[covered] = mix(name[np.searchsorted(at, a[covered])] ^ _LONG)
        self.key = mix(key ^ _RUN)
        self.name = mix(prefix.of(self.first, self.first + self.count - 1 + window) + self.count.astype(np.uint64))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


# Rows may share a doc_id; `tkey` tells their texts apart.
STRETCH = "doc_id long, tkey int, start long, n long, akey long, skey long"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("tkey"), "text")


def stretches(docs: DataFrame) -> DataFrame:
    """(doc_id, text key, start word, n windows, anchor key, stretch key) of every text of at least WINDOW words."""
    def run(batches):
        memo = WordHashes()
        for part in text_slices(batches):
            lists = words_of(texts_of(part))
            sizes = np.array([len(x) for x in lists], np.int64)
            offsets = np.r_[0, np.cumsum(sizes)]
            w = Windows(memo.of([x for y in lists for x in y]), offsets)
            own = np.searchsorted(offsets, w.first, side="right") - 1
            own = pa.array(own)
            yield pa.record_batch([part.column("doc_id").take(own), part.column("tkey").take(own),
                                   pa.array(w.first - offsets[np.asarray(own)], pa.int64()), pa.array(w.count, pa.int64()),
                                   _signed(w.key), _signed(w.name)], names=["doc_id", "tkey", "start", "n", "akey", "skey"])

    return _keyed(docs.where("doc_id IS NOT NULL")).mapInArrow(run, STRETCH)


def _packed(docs: DataFrame) -> DataFrame:
    """(other columns, z): texts squeezed for the exchange."""
    extra = [c for c in docs.columns if c != "text"]

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for part in text_slices(batches):
            z = [None if t is None else press.compress(t.encode()) for t in part.column("text").to_pylist()]
            yield pa.record_batch([*(part.column(c) for c in extra), pa.array(z, pa.binary())], names=[*extra, "_z"])

    return docs.mapInArrow(run, docs.drop("text").schema.add("_z", "binary"))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, ranges array<struct<a, b>>): starts of repeated windows as half-open ranges, in words."""
    # Most anchors stand in one document only; nothing of theirs goes on.
    found = stretches(docs)
    common = found.groupBy("akey").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("akey")
    found = cut_lineage(found.join(common, "akey", "left_semi").select("doc_id", "tkey", "start", "n", "akey", "skey"))
    names = found.groupBy("akey", "skey").agg(F.min(F.struct("doc_id", "tkey", "start")).alias("f"), F.max("doc_id").alias("most"),
                                              F.max("n").alias("n"))
    names = cut_lineage(names.select("akey", "skey", F.col("f.doc_id").alias("least"), "most", "f.tkey", "f.start", "n"))
    # Anchors with different stretches in different documents: their windows are compared one by one.
    edges = (names.groupBy("akey").agg(F.count(F.lit(1)).alias("k"), F.min("least").alias("lo"), F.max("least").alias("hi"))
             .where("k > 1 AND lo < hi").select("akey"))
    asked = names.join(edges, "akey", "left_semi").select(F.col("least").alias("doc_id"), "tkey", "akey", "skey", "start", "n")
    asked = asked.groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("start", "n", "akey", "skey")).alias("asked"))
    texts = _packed(_keyed(docs.where("doc_id IS NOT NULL"))).join(asked, ["doc_id", "tkey"])

    def list_windows(batches):
        memo, press = WordHashes(), zstandard.ZstdDecompressor()
        for batch in batches:
            for doc, z, rows in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "_z", "asked"))):
                words = memo.of(press.decompress(z).split())
                prefix = Prefix(words)
                n = np.array([r["n"] for r in rows])
                at = np.repeat([r["start"] for r in rows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield pa.record_batch(
                    [pa.array(np.repeat([r["akey"] for r in rows], n)), pa.array(np.repeat([r["skey"] for r in rows], n)),
                     pa.array(at - np.repeat([r["start"] for r in rows], n), pa.int32()), _signed(prefix.name(at, at + WINDOW)),
                     pa.array(np.full(len(at), doc), pa.int64())], names=["akey", "skey", "k", "wkey", "doc_id"])

    windows = cut_lineage(texts.mapInArrow(list_windows, "akey long, skey long, k int, wkey long, doc_id long"))
    earliest = windows.groupBy("akey", "wkey").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    late = (windows.join(earliest, ["akey", "wkey"]).where("doc_id > least").groupBy("akey", "skey")
            .agg(F.sort_array(F.collect_set("k")).alias("ks")))
    verdict = names.join(late, ["akey", "skey"], "left").where("least < most OR ks IS NOT NULL").select("akey", "skey", "least", "ks")
    hits = found.join(verdict, ["akey", "skey"]).where("doc_id > least OR ks IS NOT NULL")
    ranges = F.when(F.col("doc_id") > F.col("least"), F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n")).alias("b")))).otherwise(
        F.transform("ks", lambda k: F.struct((F.col("start") + k).alias("a"), (F.col("start") + k + 1).alias("b"))))
    return hits.select("doc_id", "tkey", F.explode(ranges).alias("r")).groupBy("doc_id", "tkey").agg(
        F.collect_list("r").alias("_ranges"))


def removed_mask(n: int, ranges, window: int = WINDOW) -> np.ndarray:
    """Words covered by the windows that start in the ranges."""
    step = np.zeros(n + window + 1, np.int64)
    if ranges:
        a, b = np.array([r["a"] for r in ranges]), np.array([r["b"] for r in ranges])
        np.add.at(step, a, 1)
        np.add.at(step, np.minimum(b - 1 + window, n), -1)
    return np.cumsum(step[:n]) > 0


def _with_ranges(docs: DataFrame) -> DataFrame:
    """Rows of docs, text packed as _z, beside their ranges."""
    keyed = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_tkey": F.hash("text")})
    ranges = repeated_ranges(docs).withColumnsRenamed({"doc_id": "_id", "tkey": "_tkey"})
    return _packed(keyed).join(ranges, ["_id", "_tkey"], "left")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per row of (doc_id, text)."""
    def run(batches):
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for doc, z, ranges in zip(*(batch.column(c).to_pylist() for c in ("_id", "_z", "_ranges"))):
                words = press.decompress(z).split() if z is not None else []
                gone = removed_mask(len(words), ranges)
                kept = words if not ranges else [w for w, g in zip(words, gone.tolist()) if not g]
                rows.append((doc, len(words), len(words) - len(kept), sha256(b" ".join(kept))))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return _with_ranges(docs.select("doc_id", "text")).mapInArrow(run, SCHEMA)


def remove(docs: DataFrame) -> DataFrame:
    """The same rows, texts that lose words rewritten as their kept words joined by spaces; others unchanged. n_chars follows.
    Columns may have any names."""
    docs, named = aside(docs, "doc_id", "text", "n_chars")
    schema = docs.schema

    def run(batches):
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            texts, lost = [], []
            for z, ranges in zip(batch.column("_z").to_pylist(), batch.column("_ranges").to_pylist()):
                data = None if z is None else press.decompress(z)
                if ranges and data is not None:
                    words = data.split()
                    gone = removed_mask(len(words), ranges)
                    data = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                texts.append(None if data is None else data.decode())
                lost.append(bool(ranges))
            columns = dict(zip(batch.schema.names, batch.columns))
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(t) if x and t is not None and n is not None else n for n, t, x in zip(
                    columns["n_chars"].to_pylist(), texts, lost)], columns["n_chars"].type)
            yield pa.record_batch([columns[f.name] for f in schema], names=schema.names)

    return named(_with_ranges(docs).mapInArrow(run, schema))
