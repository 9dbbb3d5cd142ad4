"""Shared pieces: slices of Arrow batches, word hashing, flat numpy layouts."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# UTF-8 bytes of text that a task works on at once; a longer single text is one slice of its own.
SLICE_BYTES = 2_000_000
# A process forgets its words beyond this many.
MEMO_WORDS = 400_000

GOLD = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def text_slices(batches, most: int = SLICE_BYTES, column: str = "text"):
    """Record batches cut so that each holds at most `most` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64()))
        ends = np.cumsum(sizes)
        a = 0
        while a < batch.num_rows:
            before = ends[a] - sizes[a]
            b = max(a + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(a, b - a)
            a = b


def texts_of(batch, column: str = "text") -> list[str]:
    return pc.fill_null(batch.column(column), "").to_pylist()


class WordHashes(dict):
    """bytes -> stable 64-bit hash, remembered; `of` maps a list of words at once."""

    def __missing__(self, word):
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words) -> np.ndarray:
        if len(self) > MEMO_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(texts: list[str]) -> list[list[bytes]]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8; bytes.split() knows exactly these six separators."""
    return [t.encode().split() for t in texts]


def flat(memo: WordHashes, lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of every list end to end, offsets of the lists)."""
    offsets = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    return memo.of([w for x in lists for w in x]), offsets


def owners(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pair_name(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-dependent name of two symbols."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + mix(b + GOLD))


def shingles(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of `size` words inside a list, its list). A list of 1 to size - 1 words gives one shingle."""
    n = len(words)
    own = owners(offsets)
    if n >= size:
        h = mix(words[: n - size + 1])
        for k in range(1, size):
            h = pair_name(h, words[k: n - size + 1 + k])
        inside = own[: n - size + 1] == own[size - 1:]
        h, where = h[inside], own[: n - size + 1][inside]
    else:
        h, where = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sizes = np.diff(offsets)
    short = np.flatnonzero((sizes > 0) & (sizes < size))
    if len(short):
        extra = np.array([xxhash.xxh3_64_intdigest(words[offsets[i]: offsets[i + 1]].tobytes()) for i in short], np.uint64)
        h, where = np.concatenate([h, extra]), np.concatenate([where, short])
    return h, where


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def crc_fold(column, mod: int):
    return F.crc32(column.cast("string").cast("binary")) % F.lit(mod)


def aside(docs: DataFrame, *keep: str):
    """(docs whose columns but `keep` have neutral names, a function that gives results their names back). An operator's own helper columns
    then cannot meet a column of the input."""
    names = {c: c if c in keep else f"column{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return plain, lambda out: out.select(*[F.col(n).alias(c) for c, n in names.items()])
