"""Compression bands: zstandard ratios of whole texts and of fixed chunks, against limits by length.

ratio = compressed bytes / UTF-8 bytes. Below the lower limit of its length band a piece is repetitive, above the upper
limit incompressible. A text is rejected if its whole ratio is outside its band, or if chunks outside theirs hold more
than `most_bad` of its bytes. Pieces shorter than the first band are not judged by their ratio.

Base figures (words are `[^\\x20\\x09-\\x0D]+`): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. Null and empty
texts have no words, so they fail the base rule. Repeated rows are judged one by one. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .base import WordHashes, owners, text_slices, texts_of

# (bytes from, lowest ratio, highest ratio); prose, lists and code of every language lie well inside.
BANDS = ((128, 0.40, 1.05), (256, 0.35, 0.98), (512, 0.30, 0.90), (1024, 0.28, 0.85), (2048, 0.25, 0.80), (8192, 0.22, 0.78))
CHUNK = 4096
MOST_BAD = 0.3
LEVEL = 3
SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "kept boolean, ratio double, bad_chunk_share double")
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def verdict(data: bytes, press, bands=BANDS, chunk: int = CHUNK, most_bad: float = MOST_BAD) -> tuple[bool, float, float]:
    """(inside the bands, whole ratio, share of bytes in chunks outside)."""
    starts = [b[0] for b in bands]

    def outside(size: int, ratio: float) -> bool:
        k = int(np.searchsorted(starts, size, side="right")) - 1
        return k >= 0 and not bands[k][1] <= ratio <= bands[k][2]

    size = len(data)
    if not size:
        return True, 0.0, 0.0
    whole = len(press.compress(data)) / size
    if size <= chunk:
        bad = outside(size, whole)
        return not bad, whole, float(bad)
    view, bad_bytes = memoryview(data), 0
    for a in range(0, size, chunk):
        part = view[a: a + chunk]
        if outside(len(part), len(press.compress(part)) / len(part)):
            bad_bytes += len(part)
    share = bad_bytes / size
    return not outside(size, whole) and share <= most_bad, whole, share


def repeated_words(ids: np.ndarray, offsets: np.ndarray, window: int = 5) -> np.ndarray:
    """Per list: words inside windows of `window` words that occur twice or more in that list."""
    n, lists = len(ids), len(offsets) - 1
    if n < window:
        return np.zeros(lists, np.int64)
    own = owners(offsets)
    start = np.flatnonzero(own[: n - window + 1] == own[window - 1:])
    key = own[start].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(window):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + ids[start + k].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    a, b = start[order[:-1]], start[order[1:]]
    same = (key[order[:-1]] == key[order[1:]]) & (own[a] == own[b])
    for k in range(window):  # the words themselves decide
        same &= ids[a + k] == ids[b + k]
    twice = np.zeros(n + 1, np.int64)
    hit = np.zeros(len(start), bool)
    hit[order[:-1][same]] = True
    hit[order[1:][same]] = True
    np.add.at(twice, start[hit], 1)
    np.add.at(twice, start[hit] + window, -1)
    covered = np.r_[0, np.cumsum(np.cumsum(twice[:-1]) > 0)]
    return covered[offsets[1:]] - covered[offsets[:-1]]


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def quality(docs: DataFrame, bands=BANDS, chunk: int = CHUNK, most_bad: float = MOST_BAD, level: int = LEVEL) -> DataFrame:
    """One row per row of (doc_id, text) with the base figures and the verdict."""
    def run(batches):
        press = zstandard.ZstdCompressor(level=level)
        for part in text_slices(batches):
            texts = texts_of(part)
            data = [t.encode() for t in texts]
            words = [d.split() for d in data]
            offsets = np.r_[0, np.cumsum([len(w) for w in words])].astype(np.int64)
            ids = np.fromiter(map(_Numbers().__getitem__, (w for x in words for w in x)), np.int64, int(offsets[-1]))
            counts = np.diff(offsets)
            repeats = repeated_words(ids, offsets)
            chars, symbols, dup = [], [], []
            for t, d in zip(texts, data):
                blank = len(d) - len(d.translate(None, b" \t\n\v\f\r"))
                chars.append(len(t) - blank)
                symbols.append(len(d) - len(d.translate(None, b"#*$%&|<>")))
                lines = [x for x in d.split(b"\n") if x.strip(b" \t\v\f\r")]
                dup.append(len(lines) - len(set(lines)))
            failed = (counts < 10) | (100 * repeats > 20 * counts)
            verdicts = [verdict(d, press, bands, chunk, most_bad) for d in data]
            kept = ~failed & np.array([v[0] for v in verdicts], bool)
            yield pa.record_batch(
                [part.column("doc_id").cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (counts, chars, symbols, dup, repeats)),
                 pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_()), pa.array([v[1] for v in verdicts], pa.float64()),
                 pa.array([v[2] for v in verdicts], pa.float64())], names=NAMES)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
