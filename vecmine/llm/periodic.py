"""Periodic runs of words by Kruskal's order over longest common prefixes.

Suffixes of a document that share a prefix form classes; going down from the longest common prefix (LCP) to the shortest unites
them like Kruskal's algorithm unites components. Every class keeps its positions in order. When two classes meet at LCP l, two
positions i < j that become neighbours in the united order have an LCP of exactly l; at a distance d = j - i of at most l the
words i .. j + l - 1 have period d. Neighbours at i - 1 and j - 1 would have met before, at l + 1, if the words there were equal,
so a seed whose words to the left differ is a whole run and every run comes from one seed: with a smaller period q, i + q would
already lie between i and j.

A run of length n and period q <= n / 2 has an LCP of n - q >= n / 2, so prefixes shorter than half the least length need not be
united; documents in which no stretch of that many words comes twice leave before suffixes are sorted. Suffixes are sorted by
prefix doubling over all remaining documents of a slice at once, and LCPs are read off the ranks of the doublings. Work is local to
documents: no shuffle, memory bounded by a slice of texts or one document.

Null text counts as empty, text without words gives no run and an empty collapsed text. Repeated rows and rows with a null doc_id are
answered each on its own. Columns other than doc_id and text are not carried. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import owners, pair_name, shingles, mix, text_slices, texts_of

LEAST = 12
# A plain list of positions up to this size; beyond it a list of lists, so that an insertion moves few entries.
PLAIN = 1024


class Positions:
    """A large ordered set of positions."""

    def __init__(self, ordered: list[int]):
        self.parts = [ordered[k: k + PLAIN // 2] for k in range(0, len(ordered), PLAIN // 2)]
        self.lasts = [p[-1] for p in self.parts]
        self.size = len(ordered)

    def __len__(self):
        return self.size

    def around(self, x: int) -> tuple[int, int]:
        """(greatest position below x, smallest above), -1 where there is none; x is not in the set."""
        k = bisect_left(self.lasts, x)
        if k == len(self.parts):
            return self.lasts[-1], -1
        part = self.parts[k]
        at = bisect_left(part, x)
        return (part[at - 1] if at else self.lasts[k - 1] if k else -1), part[at]

    def add(self, x: int) -> None:
        k = min(bisect_left(self.lasts, x), len(self.parts) - 1)
        part = self.parts[k]
        insort(part, x)
        self.lasts[k] = part[-1]
        self.size += 1
        if len(part) > PLAIN:
            self.parts[k: k + 1] = [part[: PLAIN // 2], part[PLAIN // 2:]]
            self.lasts[k: k + 1] = [part[PLAIN // 2 - 1], part[-1]]

    def __iter__(self):
        for part in self.parts:
            yield from part


def suffix_ranks(words: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Ranks by the first 1, 2, 4, ... words until all suffixes differ. `words` holds documents end to end, `starts` their offsets
    (and the end). Equal ranks mean equal words in the same document; a rank is the number of smaller suffixes."""
    n = len(words)
    own = owners(starts)
    ends = starts[1:][own]
    order = np.lexsort((words, own))
    new = np.ones(n, bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (own[order][1:] != own[order][:-1])
    first = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.r_[first, n]))
    levels, step = [rank.astype(np.int32)], 1
    open_ = order[np.repeat(np.diff(np.r_[first, n]) > 1, np.diff(np.r_[first, n]))]
    while len(open_):
        there = open_ + step
        second = np.where(there < ends[open_], rank[np.minimum(there, n - 1)] + 1, 0)
        head = rank[open_]
        order = np.lexsort((second, head))
        open_, head, second = open_[order], head[order], second[order]
        group = np.ones(len(open_), bool)
        group[1:] = head[1:] != head[:-1]
        new = group.copy()
        new[1:] |= second[1:] != second[:-1]
        at = np.flatnonzero(new)
        sizes = np.diff(np.r_[at, len(open_)])
        # Place inside the old class, counted from its first suffix.
        base = np.maximum.accumulate(np.where(group, np.arange(len(open_)), 0))
        rank[open_] = head + np.repeat(at, sizes) - base
        levels.append(rank.astype(np.int32))
        open_ = open_[np.repeat(sizes > 1, sizes)]
        step *= 2
    return levels


def neighbour_prefixes(levels: list[np.ndarray], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, LCP) of suffixes that are neighbours in the sorted order."""
    n = len(ends)
    order = np.empty(n, np.int64)
    order[levels[-1]] = np.arange(n)
    a, b = order[:-1], order[1:]
    i, j = a.copy(), b.copy()
    for k in range(len(levels) - 2, -1, -1):
        inside = (i < ends[a]) & (j < ends[b])
        same = inside & (levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)])
        i[same] += 1 << k
        j[same] += 1 << k
    return a, b, i - a


def unite(a: np.ndarray, b: np.ndarray, lcp: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Seeds (i, distance, LCP): neighbours made by uniting the ends of the edges, which come by decreasing LCP."""
    parent: dict[int, int] = {}
    sets: dict[int, list[int] | Positions] = {}
    at, apart, level = [], [], []

    def root(x):
        up = parent.get(x, x)
        while up != x:
            above = parent.get(up, up)
            parent[x] = above
            x, up = above, parent.get(above, above)
        return x

    for x, y, l in zip(a.tolist(), b.tolist(), lcp.tolist()):
        x, y = root(x), root(y)
        big, small = sets.pop(x, None) or [x], sets.pop(y, None) or [y]
        if len(big) < len(small):
            x, y, big, small = y, x, small, big
        parent[y] = x
        few = list(small)
        last = len(few) - 1
        plain = isinstance(big, list)
        for k, p in enumerate(few):
            if plain:
                m = bisect_left(big, p)
                low, high = big[m - 1] if m else -1, big[m] if m < len(big) else -1
            else:
                low, high = big.around(p)
            # Neighbours only if no other position of the smaller set lies between.
            if low >= 0 and p - low <= l and (not k or few[k - 1] < low):
                at.append(low)
                apart.append(p - low)
                level.append(l)
            if high >= 0 and high - p <= l and (k == last or few[k + 1] > high):
                at.append(p)
                apart.append(high - p)
                level.append(l)
        if plain and len(big) + len(few) <= PLAIN:
            if last:
                big += few
                big.sort()
            else:
                insort(big, few[0])
        else:
            big = Positions(big) if plain else big
            for p in few:
                big.add(p)
        sets[x] = big
    return at, apart, level


def runs_of(words: np.ndarray, starts: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of every run of at least max(least, 2 * period) words, by document, start and period.
    `words` numbers the words of all documents end to end."""
    none = (np.zeros(0, np.int64),) * 4
    half = max(1, -(-least // 2))
    grams, where = shingles(mix(words.astype(np.uint64)), starts, half)
    sizes = np.diff(starts)
    fits = sizes[where] >= half
    grams, where = pair_name(grams[fits], where[fits].astype(np.uint64)), where[fits]
    order = np.argsort(grams)
    twice = np.flatnonzero(grams[order][1:] == grams[order][:-1])
    docs = np.unique(where[order][twice])
    if not len(docs):
        return none
    pick = np.zeros(len(sizes), bool)
    pick[docs] = True
    some = words[pick[owners(starts)]]
    cuts = np.r_[0, np.cumsum(sizes[docs])]
    own = owners(cuts)
    a, b, lcp = neighbour_prefixes(suffix_ranks(some, cuts), cuts[1:][own])
    keep = np.flatnonzero(lcp >= half)
    keep = keep[np.argsort(-lcp[keep], kind="stable")]
    i, d, l = (np.array(x, np.int64) for x in unite(a[keep], b[keep], lcp[keep]))
    whole = (l + d >= least) & ((i == cuts[own[i]]) | (some[i - 1] != some[i - 1 + d]))
    i, d, l = i[whole], d[whole], l[whole]
    order = np.lexsort((d, i))
    i, d, l = i[order], d[order], l[order]
    return docs[own[i]], i - cuts[own[i]], l + d, d


def kept(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start + period, 1)
    np.add.at(step, start + length, -1)
    return np.cumsum(step[:-1]) == 0


RUNS = "doc_id long, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def find(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, its runs by start and period, and its text with every run cut to one period, words joined by single spaces."""
    def run(batches):
        for batch in text_slices(batches):
            lists = [t.encode().split() for t in texts_of(batch)]
            starts = np.r_[0, np.cumsum([len(x) for x in lists], dtype=np.int64)]
            names: dict[bytes, int] = {}
            words = np.fromiter((names.setdefault(w, len(names)) for x in lists for w in x), np.int64, starts[-1])
            own, start, length, period = runs_of(words, starts, least)
            cuts = np.searchsorted(own, np.arange(len(lists) + 1))
            texts = []
            for k, x in enumerate(lists):
                part = slice(cuts[k], cuts[k + 1])
                if cuts[k] < cuts[k + 1]:
                    x = [x[p] for p in np.flatnonzero(kept(len(x), start[part], length[part], period[part])).tolist()]
                texts.append(b" ".join(x).decode())
            rows = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(starts)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), rows),
                                   pa.array(texts, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RUNS)


def digests(found: DataFrame) -> DataFrame:
    """One row per document of `find`: the number of runs, its longest run, and digests of all runs and of the collapsed text."""
    # Longest first, then the smallest start, then the smallest period.
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"), F.floor(-1000 * F.col("best.less") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
