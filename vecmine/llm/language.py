"""Language identification by nearest centroids.

A text becomes a TF-IDF vector of hashed character n-grams (orders 1 to 3 of its lower-case letters, everything else one
boundary mark), logarithmic in the count and of length one. Every language has several centroids (spherical k-means over
at most `SAMPLE` distinct texts of it); a text gets the language of the most similar centroid. It is rejected if it has no
letter, or if that cosine is below `REJECT` times the least that the sample's texts of as many distinct n-grams reach. Document frequencies cover all training texts.
The sample is the smallest hashes of a language's distinct texts, whatever the number of their copies.

Null and empty texts and texts without letters: `und`, score 0, rejected. Rows with a null language teach nothing. If
nothing can be learned (empty table), every text is `und`. Repeated rows are predicted one by one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import mix, text_slices, texts_of

BUCKETS = 8192
ORDERS = (1, 2, 3)
SAMPLE = 1000
CENTROIDS = 3
REJECT = 0.5
SHARPNESS = 30.0
# Distinct n-grams of a text, as steps of the rejection limit.
STEPS = (8, 16, 32, 64, 128, 256, 512, 1024)
UNKNOWN = "und"
BLOCK_TEXTS = 128
_LETTERS = None


def _letters() -> np.ndarray:
    """True for code points that are letters; beyond the table none is."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x32400)), bool, 0x32400)
    return _LETTERS


def _blocks(texts: list[str], most_chars: int = 500_000):
    """Runs of texts that are counted together: few texts, or few characters."""
    a, chars = 0, 0
    for i, t in enumerate(texts):
        if i > a and (i - a >= BLOCK_TEXTS or chars + len(t) > most_chars):
            yield a, i
            a, chars = i, 0
        chars += len(t)
    if a < len(texts):
        yield a, len(texts)


def counts_of(texts: list[str], buckets: int = BUCKETS, orders=ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """(counts [texts x buckets], whether each text has a letter)."""
    n, letters = len(texts), _letters()
    joined = [t.lower() for t in texts]
    sizes = np.array([len(t) + max(orders) for t in joined], np.int64)
    pad = " " * max(orders)
    point = np.frombuffer("".join(t + pad for t in joined).encode("utf-32-le"), np.uint32)
    known = letters[np.minimum(point, len(letters) - 1)] & (point < len(letters))
    own = np.repeat(np.arange(n), sizes)
    has = np.bincount(own[known], minlength=n) > 0
    # Letters and one boundary mark after each run of them.
    keep = known | np.r_[False, known[:-1]]
    code, own = np.where(known, point, 0)[keep].astype(np.uint64), own[keep]
    total = np.zeros(n * buckets, np.float32)
    gram = np.zeros(len(code), np.uint64)
    for k in range(max(orders)):
        m = len(code) - k
        if m <= 0:
            break
        gram = gram[:m] * np.uint64(0x100000001B3) + code[k:] + np.uint64(1)
        if k + 1 in orders:
            same = own[:m] == own[k:]
            # An n-gram may begin or end with a boundary, but not hold one inside; a lone boundary is none.
            inside = np.ones(m, bool)
            for j in range(1, k):
                inside &= code[j: m + j] != 0
            good = same & inside & ((code[:m] != 0) | (k > 0) & (code[min(k, 1): m + min(k, 1)] != 0))
            slot = (mix(gram[good]) % np.uint64(buckets)).astype(np.int64)
            total += np.bincount(own[:m][good] * buckets + slot, minlength=n * buckets).astype(np.float32)
    return total.reshape(n, buckets), has


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first starts; empty clusters vanish."""
    if not len(x):
        return x
    mean = x.mean(0)
    start = [int(np.argmax(x @ mean))]
    while len(start) < min(k, len(x)):
        near = (x @ x[start].T).max(1)
        start.append(int(np.argmin(near)))
    c = x[start]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, 1)
        c = np.stack([x[own == j].sum(0) for j in range(len(c)) if (own == j).any()])
        c /= np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-12)
    return c


class Model:
    def __init__(self, idf, names, centroids, floors):
        self.idf, self.names = idf, names                       # names: language of each centroid
        self.centroids, self.floors = centroids, floors         # floors: least cosine per step
        self.langs = sorted(set(names))
        self.group = np.array([self.langs.index(x) for x in names], np.int64)

    def predict(self, texts: list[str]):
        """(language, score, cosine, rejected) lists."""
        langs, scores, cosines, rejected = [], [], [], []
        for a, b in _blocks(texts):
            counts, has = counts_of(texts[a:b], len(self.idf))
            if not len(self.names):
                has[:] = False
                cos = np.zeros((b - a, 1))
            else:
                cos = vectors(counts, self.idf) @ self.centroids.T
            best = cos.argmax(1)
            top = cos[np.arange(b - a), best]
            step = np.searchsorted(STEPS, (counts > 0).sum(1), side="right")
            for i in range(b - a):
                if not has[i]:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    cosines.append(0.0)
                    rejected.append(True)
                    continue
                each = np.full(len(self.langs), -1.0)
                np.maximum.at(each, self.group, cos[i])
                e = np.exp(SHARPNESS * (each - each.max()))
                langs.append(self.names[best[i]])
                scores.append(float(1.0 / e.sum()))
                cosines.append(float(top[i]))
                rejected.append(bool(top[i] < self.floors[step[i]]))
        return langs, scores, cosines, rejected


def sampled(train: DataFrame, sample: int) -> DataFrame:
    """(lang, text): the `sample` distinct texts of each language with the smallest hashes, all of them where there are fewer."""
    hashed = train.withColumn("u", F.xxhash64("text"))
    distinct = {r.lang: r.n for r in hashed.select("lang", "u").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    # More than twice the sample by a threshold on the hash (over seven deviations above it, also for small samples), then the smallest.
    wanted = 2.0 * sample + 10.0 * np.sqrt(2.0 * sample) + 20.0
    share = F.lit(1.0)
    for lang in sorted(distinct):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, float(wanted / distinct[lang])))).otherwise(share)
    return (hashed.where((F.col("u") / F.lit(2.0 ** 64) + F.lit(0.5)) <= share).dropDuplicates(["lang", "u"])
            .withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("u"))).where(F.col("k") <= sample).select("lang", "text"))


def fit(train: DataFrame, buckets: int = BUCKETS, sample: int = SAMPLE, centroids: int = CENTROIDS, reject: float = REJECT) -> Model:
    """From rows (text, lang). Collects one row per bucket and per centroid."""
    train = train.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")

    def frequencies(batches):
        df, per = np.zeros(buckets, np.int64), {}
        for part in text_slices(batches):
            texts = texts_of(part)
            for lang in part.column("lang").to_pylist():
                per[lang] = per.get(lang, 0) + 1
            for a, b in _blocks(texts):
                df += (counts_of(texts[a:b], buckets)[0] > 0).sum(0)
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array([None] * len(at) + list(per), pa.string()), pa.array(at.tolist() + [-1] * len(per), pa.int32()),
                               pa.array(df[at].tolist() + list(per.values()), pa.int64())], names=["lang", "slot", "n"])

    rows = train.mapInArrow(frequencies, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).collect()
    per = {r.lang: r.n for r in rows if r.slot == -1}
    df = np.zeros(buckets)
    for r in rows:
        if r.slot >= 0:
            df[r.slot] = r.n
    total = sum(per.values())
    idf = (np.log((1.0 + total) / (1.0 + df)) + 1.0).astype(np.float32)
    if not per:
        return Model(idf, [], np.zeros((0, buckets), np.float32), np.zeros(len(STEPS) + 1))

    def to_vectors(batches):
        for part in text_slices(batches):
            texts = texts_of(part)
            lang = part.column("lang").to_pylist()
            for a, b in _blocks(texts):
                counts, has = counts_of(texts[a:b], buckets)
                v = vectors(counts, idf).astype(np.float32)
                yield pa.record_batch([pa.array(lang[a:b], pa.string()), pa.array([x.tobytes() for x in v], pa.binary()),
                                       pa.array((counts > 0).sum(1), pa.int64())], names=["lang", "v", "m"])

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf.m > 0].sort_values("v", kind="stable")
        if not len(pdf):
            return pd.DataFrame({"lang": [], "c": [], "floors": []})
        x = np.stack([np.frombuffer(v, np.float32) for v in pdf.v])
        c = _cluster(x, centroids)
        cos, step = (x @ c.T).max(1), np.searchsorted(STEPS, pdf.m.to_numpy(), side="right")
        low = np.full(len(STEPS) + 1, np.nan)
        for s in np.unique(step):
            low[s] = cos[step == s].min()
        return pd.DataFrame({"lang": pdf.lang.iloc[0], "c": [r.astype(np.float32).tobytes() for r in c], "floors": [low.tolist()] * len(c)})

    learned = (sampled(train, sample).mapInArrow(to_vectors, "lang string, v binary, m long")
               .groupBy("lang").applyInPandas(learn, "lang string, c binary, floors array<double>").collect())
    learned.sort(key=lambda r: (r.lang, bytes(r.c)))
    # The least of all languages; a step without texts takes the next lower one's limit, the lowest none at all.
    low = np.array([[np.inf if f is None or np.isnan(f) else f for f in r.floors] for r in learned]).reshape(-1, len(STEPS) + 1)
    floors = low.min(0) if len(low) else np.full(len(STEPS) + 1, np.inf)
    for s in range(len(floors)):
        floors[s] = (floors[s - 1] if s else 0.0) if np.isinf(floors[s]) else floors[s]
    return Model(idf, [r.lang for r in learned], np.array([np.frombuffer(r.c, np.float32) for r in learned]).reshape(-1, buckets),
                 reject * floors)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, cosine, rejected per row of (doc_id, text)."""
    def run(batches):
        for part in text_slices(batches):
            lang, score, cos, out = model.predict(texts_of(part))
            yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                                   pa.array(cos, pa.float64()), pa.array(out, pa.bool_())],
                                  names=["doc_id", "lang_pred", "score", "cosine", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, cosine double, rejected boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are not rejected, unchanged."""
    def run(batches):
        for part in text_slices(batches):
            keep = [not r for r in model.predict(texts_of(part))[3]]
            yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
