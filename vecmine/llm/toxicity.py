"""Toxicity by two class-conditional Kneser-Ney models.

Units are word bigrams, words, and the first seven and five letters of longer words. For every unit the labelled texts give
n_c, the number of distinct texts of class c that hold it (a Kneser-Ney continuation count, the contexts being texts, so that
repetition within a text and copies say nothing). With absolute discount 1 and per kind of unit N_c = sum of n_c, T_c = number of units
with n_c > 0,

    P_c(u) = (max(n_c(u) - 1, 0) + T_c * S(u)) / N_c,   S(u) = (n_0(u) + n_1(u) + 1) / (N_0 + N_1 + W)

where S is shared by both classes. A unit that no class holds twice is rare: its word falls back to its seven letters,
these to five, these to equal chances. The log ratio of a word after v is that of the bigram less that of v if the bigram
is not rare, else that of the word. A text's features are the mean log ratio per word and the square root of the mean of that part
above `STRONG`, at most 1 a word.

The models are fitted on at most `SAMPLE_TEXTS` distinct texts and `SAMPLE_CHARS` characters of each class, those with the smallest hash, so
that model, shuffle and broadcast do not grow with the corpus. A logistic curve over the two features is fitted crosswise: the labelled texts are
in two folds, each scored by the counts of the other, weighted back to the classes' shares of all labelled rows. Every text is
then scored whole by the counts of both folds.

Words are lower-case runs between white space without edge punctuation. Null and empty texts have both features 0 and
the score that belongs to them. Rows of `labels` with a null doc_id or label teach nothing; a doc_id labelled twice is
toxic if one row says so. Without labels every score is 0.5. Repeated rows are scored one by one. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .base import MEMO_WORDS, owners, pair_name, text_slices, texts_of

SAMPLE_TEXTS = 4000
SAMPLE_CHARS = 16_000_000
STRONG = 2.0
PUNCTUATION = b".,;:!?()[]{}<>\"'*#$%&|-_=+/\\~`"
PREFIXES = (7, 5)
# Kinds in the two low bits of a unit's key: bigram, word, first seven letters, first five letters.
BIGRAM, WORD = 0, 1
COUNT_SLICE = 8_000_000


def _core(word: bytes) -> bytes:
    core = word.strip(PUNCTUATION) or word
    return core.lower() if core.isascii() else core.decode().lower().encode()


def _kinded(h, kind: int):
    return (h & np.uint64(0xFFFFFFFFFFFFFFFC)) | np.uint64(kind)


def unit_keys(word: bytes) -> tuple[int, ...]:
    """Keys of the word and of its beginnings, longest first."""
    core = _core(word)
    out = [(xxhash.xxh3_64_intdigest(core) & ~3) | WORD]
    if len(core) > PREFIXES[-1]:
        letters = core.decode()
        out += [(xxhash.xxh3_64_intdigest(letters[:n].encode(), seed=n) & ~3) | (WORD + 1 + i) for i, n in enumerate(PREFIXES)
                if len(letters) > n]
    return tuple(out)


class _Words(dict):
    """Raw word -> key of its word unit."""

    def __missing__(self, word):
        self[word] = value = (xxhash.xxh3_64_intdigest(_core(word)) & ~3) | WORD
        return value

    def flat(self, lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > MEMO_WORDS:
            self.clear()
        offsets = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int64)
        return np.fromiter(map(self.__getitem__, (w for x in lists for w in x)), np.uint64, int(offsets[-1])), offsets


def bigram_keys(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bigram key, key of the word before) per word; 0 stands before a first word."""
    before = np.r_[np.uint64(0), h[:-1]] if len(h) else h
    before[offsets[:-1][np.diff(offsets) > 0]] = 0
    return _kinded(pair_name(before, h), BIGRAM), before


COUNTS = [f"n{c}{f}" for f in (0, 1) for c in (0, 1)]


def labelled_sample(docs: DataFrame, labels: DataFrame, texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> tuple[DataFrame, dict[int, float]]:
    """(text, toxic, fold) of the distinct texts that teach, and how many labelled rows of its class each stands for. `labels` is
    (doc_id, toxic, fold 0 or 1); a text in both folds goes to the first. Only hashes and lengths meet the labels; texts are fetched for what is
    picked, by the smallest doc_id that has them."""
    spark = docs.sparkSession
    full = F.coalesce("text", F.lit(""))
    marks = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(full).alias("h"), F.length(full).alias("size"))
    known = marks.join(labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", "fold"), "doc_id")
    distinct = cut_lineage(known.groupBy("h", "toxic").agg(F.min("fold").alias("fold"), F.min("doc_id").alias("doc_id"), F.first("size").alias("size"),
                                                           F.count(F.lit(1)).alias("rows")))
    everything = {r["toxic"]: r["n"] for r in distinct.groupBy("toxic").agg(F.sum("rows").alias("n")).collect()}  # two classes
    picked, share = [], {}
    for c, n in everything.items():
        rows = distinct.where(F.col("toxic") == c).select("doc_id", "h", "toxic", "fold", "size").orderBy("h").limit(texts).collect()
        so_far = np.cumsum([r["size"] for r in rows])
        kept = max(1, int(np.searchsorted(so_far, chars, side="right")))
        picked += [(r["doc_id"], r["h"], r["toxic"], r["fold"]) for r in rows[:kept]]
        share[c] = n / min(kept, len(rows))
    wanted = F.broadcast(spark.createDataFrame(picked, "doc_id long, h string, toxic int, fold int"))  # at most `texts` a class
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), full.alias("text")).join(wanted, "doc_id").where(F.md5("text") == F.col("h"))
    once = found.groupBy("h", "toxic").agg(F.first("text").alias("text"), F.min("fold").alias("fold"))
    return cut_lineage(once.select("text", "toxic", "fold").repartition(spark.sparkContext.defaultParallelism)), share


def unit_counts(sample: DataFrame) -> DataFrame:
    """(key, n<class><fold>...): in how many texts of each class and fold a unit is."""
    def run(batches):
        words, starts = _Words(), {}
        for part in text_slices(batches, COUNT_SLICE):
            lists = [t.encode().split() for t in texts_of(part)]
            h, offsets = words.flat(lists)
            own = owners(offsets)
            pairs = bigram_keys(h, offsets)[0]
            more, more_own = [], []
            for i, x in enumerate(lists):
                for w in set(x):
                    keys = starts.get(w)
                    if keys is None:
                        keys = starts[w] = unit_keys(w)[1:]
                    more.extend(keys)
                    more_own.extend([i] * len(keys))
            if len(starts) > MEMO_WORDS:
                starts.clear()
            key = np.concatenate([h, pairs, np.array(more, np.uint64)])
            own = np.concatenate([own, own, np.array(more_own, np.int64)])
            order = np.lexsort((own, key))
            key, own = key[order], own[order]
            once = np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])] if len(key) else np.zeros(0, bool)
            key, own = key[once], own[once]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            kind = np.asarray(part.column("toxic"), dtype=np.int64) + 2 * np.asarray(part.column("fold"), dtype=np.int64)
            per = [np.add.reduceat((kind[own] == k).astype(np.int32), first) if len(first) else np.zeros(0, np.int32) for k in range(4)]
            yield pa.record_batch([pa.array(key[first].view(np.int64))] + [pa.array(p, pa.int32()) for p in per], names=["key", *COUNTS])

    return (sample.mapInArrow(run, "key long, " + ", ".join(f"{c} int" for c in COUNTS))
            .groupBy("key").agg(*[F.sum(c).alias(c) for c in COUNTS]))


def log_ratios(counts: DataFrame) -> DataFrame:
    """(key, r) of the units that a class holds in two texts or more, from (key, n0, n1)."""
    kinds, kind = range(2 + len(PREFIXES)), F.col("key").bitwiseAND(3)
    sums = []
    for k in kinds:
        for c in (0, 1):
            n = F.when(kind == k, F.col(f"n{c}")).otherwise(0)
            sums += [F.sum(n).cast("double").alias(f"N{c}{k}"), F.sum((n > 0).cast("long")).cast("double").alias(f"T{c}{k}")]
        sums.append(F.sum(((kind == k) & (F.col("n0") + F.col("n1") > 0)).cast("long")).cast("double").alias(f"W{k}"))
    total = counts.agg(*sums).first()

    def of(name):
        out = F.lit(None).cast("double")
        for k in kinds:
            out = F.when(kind == k, F.lit(total[f"{name}{k}"]).cast("double")).otherwise(out)
        return out

    shared = F.try_divide(F.col("n0") + F.col("n1") + 1, of("N0") + of("N1") + of("W"))
    p = [F.try_divide(F.greatest(F.col(f"n{c}") - 1, F.lit(0)) + of(f"T{c}") * shared, of(f"N{c}")) for c in (0, 1)]
    # What a kind's backoff shares say by themselves is no evidence.
    base = F.log(F.try_divide(of("T1"), of("N1"))) - F.log(F.try_divide(of("T0"), of("N0")))
    listed = counts.where(F.greatest("n0", "n1") > 1)
    return listed.select("key", (F.log(p[1]) - F.log(p[0]) - base).alias("r")).where("r IS NOT NULL AND NOT isnan(r)")


def combine(r: np.ndarray, offsets: np.ndarray, strong: float) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(offsets)
    own, n = owners(offsets), np.maximum(sizes, 1)
    return np.bincount(own, r, len(sizes)) / n, np.bincount(own, np.clip(r - strong, 0, 1), len(sizes)) / n


class _Numbers(dict):
    """Raw word -> number. The key and the log ratio of every number stand in arrays."""

    def __init__(self, units: dict[int, float]):
        super().__init__()
        self.units = units
        self.start()

    def start(self):
        self.clear()
        self.key, self.ratio = np.zeros(0, np.uint64), np.zeros(0)
        self.new_keys, self.new_ratios = [], []

    def __missing__(self, word):
        core = _core(word)
        key = (xxhash.xxh3_64_intdigest(core) & ~3) | WORD
        r = self.units.get(key)
        if r is None:
            # Beginnings count letters, which are bytes in plain words.
            letters = core if core.isascii() else core.decode()
            for i, n in enumerate(PREFIXES):
                if len(letters) > n:
                    head = letters[:n] if letters is core else letters[:n].encode()
                    r = self.units.get((xxhash.xxh3_64_intdigest(head, seed=n) & ~3) | (WORD + 1 + i))
                    if r is not None:
                        break
        self[word] = n = len(self)
        self.new_keys.append(key)
        self.new_ratios.append(r or 0.0)
        return n

    def of(self, lists: list[list[bytes]], size: int) -> np.ndarray:
        at = np.fromiter(map(self.__getitem__, (w for x in lists for w in x)), np.int64, size)
        if self.new_keys:
            self.key = np.concatenate([self.key, np.array(self.new_keys, np.uint64)])
            self.ratio = np.concatenate([self.ratio, self.new_ratios])
            self.new_keys, self.new_ratios = [], []
        return at


class Model:
    """Log ratios of the listed units."""

    def __init__(self, rows: pa.Table):
        key = np.asarray(rows["key"]).astype(np.int64).view(np.uint64)
        order = np.argsort(key)
        self.keys, self.values = key[order], np.asarray(rows["r"], dtype=np.float64)[order].astype(np.float32)

    def features(self, batches):
        """(slice, a, b) of slices of texts."""
        pair = (self.keys & np.uint64(3)) == BIGRAM
        numbers = _Numbers(dict(zip(self.keys[~pair].tolist(), self.values[~pair].tolist())))
        pair_keys, pair_values = self.keys[pair], self.values[pair]
        for part in text_slices(batches):
            lists = [t.encode().split() for t in texts_of(part)]
            if len(numbers) > MEMO_WORDS:
                numbers.start()
            offsets = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int64)
            at = numbers.of(lists, int(offsets[-1]))
            r = numbers.ratio[at]
            if len(pair_keys) and len(at):
                # Every bigram of the slice once, in order, so that the search walks the list of units once.
                first = np.zeros(len(at), bool)
                first[offsets[:-1][np.diff(offsets) > 0]] = True
                before = np.where(first, -1, np.r_[-1, at[:-1]])
                pairs, back = np.unique((before + 1) << 32 | at, return_inverse=True)
                v, w = (pairs >> 32) - 1, pairs & 0xFFFFFFFF
                key = _kinded(pair_name(np.where(v < 0, np.uint64(0), numbers.key[np.maximum(v, 0)]), numbers.key[w]), BIGRAM)
                order = np.argsort(key)
                found = np.empty(len(key), np.int64)
                found[order] = np.minimum(np.searchsorted(pair_keys, key[order]), len(pair_keys) - 1)
                own = np.where(v < 0, 0.0, numbers.ratio[np.maximum(v, 0)])
                r = np.where(pair_keys[found] == key, pair_values[found] - own, numbers.ratio[w])[back]
            yield part, *combine(r, offsets, STRONG)


def fit_model(counts: DataFrame, folds: tuple[int, ...]) -> Model:
    """The model from the counts of some folds. Its size is bounded by that of the sample."""
    sums = [sum((F.col(f"n{c}{f}") for f in folds[1:]), F.col(f"n{c}{folds[0]}")).alias(f"n{c}") for c in (0, 1)]
    return Model(log_ratios(counts.select("key", *sums)).toArrow())


def features(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, a, b) per row: both features."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part, a, b in shipped.value.features(batches):
            yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array(a), pa.array(np.sqrt(b))], names=["doc_id", "a", "b"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, a double, b double")


BINS = 400


def calibrate(sample: DataFrame, share: dict[int, float], steps: int = 60) -> np.ndarray:
    """Weights (constant, a, b) of a logistic curve from (a, b, toxic); a row counts for `share` rows of its class. Rows are summed per small
    cell first, at most BINS x BINS cells and two classes."""
    lo = sample.agg(F.min("a"), F.max("a"), F.max("b")).first()
    if lo[0] is None:
        return np.zeros(3)
    step_a, step_b = max((lo[1] - lo[0]) / BINS, 1e-9), max(lo[2] / BINS, 1e-9)
    cells = (sample.groupBy(F.floor((F.col("a") - lo[0]) / step_a).alias("i"), F.floor(F.col("b") / step_b).alias("j"), "toxic")
             .agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("a"), F.avg("b").alias("b")).collect())
    x = np.array([[1.0, c.a, c.b] for c in cells])
    y = np.array([float(c.toxic) for c in cells])
    n = np.array([c.n * share[c.toxic] for c in cells])
    scale = np.r_[1.0, np.maximum(np.sqrt((n[:, None] * x[:, 1:] ** 2).sum(0) / n.sum()), 1e-9)]
    z, w = x / scale, np.zeros(3)
    for _ in range(steps):  # Newton steps with a little shrinkage
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        grad = z.T @ (n * (y - p)) - 1e-2 * w
        hess = (z * (n * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(3)
        move = np.linalg.solve(hess, grad)
        w += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    return w / scale


def score(docs: DataFrame, labels: DataFrame, texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(doc_id, a, b, score) per row of docs. `labels` is (doc_id, toxic, fold 0 or 1)."""
    sample, share = labelled_sample(docs, labels, texts, chars)
    counts = cut_lineage(unit_counts(sample))
    crossed = None
    for own, other in ((0, 1), (1, 0)):
        shipped = docs.sparkSession.sparkContext.broadcast(fit_model(counts, (other,)))

        def run(batches, shipped=shipped):
            for part, a, b in shipped.value.features(batches):
                yield pa.record_batch([part.column("toxic").cast(pa.int32()), pa.array(a), pa.array(np.sqrt(b))], names=["toxic", "a", "b"])

        rows = sample.where(F.col("fold") == own).mapInArrow(run, "toxic int, a double, b double")
        crossed = rows if crossed is None else crossed.unionByName(rows)
    w = calibrate(cut_lineage(crossed), share)
    z = F.lit(float(w[0])) + F.lit(float(w[1])) * F.col("a") + F.lit(float(w[2])) * F.col("b")
    return features(docs, fit_model(counts, (0, 1))).withColumn("score", 1.0 / (1.0 + F.exp(-z)))
