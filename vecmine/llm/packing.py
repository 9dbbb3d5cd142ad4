"""Hierarchical multi-length packing into power-of-two windows.

Documents are routed to the smallest tier that holds them (the longest tier takes all that are longer). A tier is packed
in turn, longest first: whole windows are cut off its documents, what is left of each opens a window, and the window's
gap is filled with whole documents of shorter tiers (largest that fits, again and again) and closed with the first part
of one more. What a task has left at its end is laid end to end and cut into powers of two. So every sequence is exactly
as long as its tier, or another power of two: nothing is padded. Sequences of a tier form step groups of equally many
tokens.

A task packs its own rows, one slice of text after another; only unfinished pieces of less than one longest window pass
from slice to slice. Null and empty texts are one token, the closing id. Rows with equal or null doc_id are packed as
rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .base import text_slices, texts_of
from .bytebpe import ByteBpe

TIERS = (1024, 512, 256, 128)
STEP_TOKENS = 16 * 1024
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "tier int, step_group long")
# A task's sequences are numbered below this.
PER_TASK = 1 << 40


class Packer:
    """Sequences of one task. A piece is [doc_id, ids, start, doc_tokens]."""

    def __init__(self, task: int, tiers=TIERS, step_tokens: int = STEP_TOKENS):
        if any(t & (t - 1) for t in tiers) or sorted(tiers, reverse=True) != list(tiers):
            raise ValueError("tiers are powers of two, longest first")
        self.task, self.tiers, self.step = task, tiers, step_tokens
        self.made, self.in_tier = 0, {}
        self.rest: list = []
        self.rows: list[tuple] = []

    def _emit(self, pieces: list, size: int) -> None:
        at, seq = 0, self.task * PER_TASK + self.made
        k = self.in_tier.get(size, 0)
        group = k // max(1, self.step // size)
        for doc, ids, start, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()), total, seq, at, size,
                              group))
            at += len(ids)
        self.made += 1
        self.in_tier[size] = k + 1

    @staticmethod
    def _cut(piece: list, n: int) -> tuple[list, list]:
        doc, ids, start, total = piece
        return [doc, ids[:n], start, total], [doc, ids[n:], start + n, total]

    def add(self, docs: list) -> None:
        """Pack (doc_id, ids) pairs together with what earlier calls left."""
        pieces = self.rest + [[d, ids, 0, len(ids)] for d, ids in docs]
        self.rest = []
        longest = self.tiers[0]
        shelf: dict[int, deque] = {}
        for piece in pieces:
            while len(piece[1]) >= longest:
                full, piece = self._cut(piece, longest)
                self._emit([full], longest)
            if len(piece[1]):
                shelf.setdefault(len(piece[1]), deque()).append(piece)
        sizes = sorted(shelf)

        def pull(most: int):
            k = bisect_right(sizes, most)
            if not k:
                return None
            n = sizes[k - 1]
            piece = shelf[n].popleft()
            if not shelf[n]:
                del shelf[n]
                sizes.pop(k - 1)
            return piece

        def put(piece: list) -> None:
            n = len(piece[1])
            if n not in shelf:
                shelf[n] = deque()
                insort(sizes, n)
            shelf[n].append(piece)

        for i, tier in enumerate(self.tiers):
            below = self.tiers[i + 1] if i + 1 < len(self.tiers) else 0
            while sizes and sizes[-1] > below:
                piece = pull(tier)
                while len(piece[1]) >= tier:
                    full, piece = self._cut(piece, tier)
                    self._emit([full], tier)
                if not len(piece[1]):
                    continue
                window, gap = [piece], tier - len(piece[1])
                while gap:
                    more = pull(min(gap, below) if below and gap > below else gap)
                    if more is None:
                        more = pull(longest)
                        if more is None:
                            break
                        more, back = self._cut(more, gap)
                        if len(back[1]):
                            put(back)
                    window.append(more)
                    gap -= len(more[1])
                if gap:
                    self.rest.extend(window)
                else:
                    self._emit(window, tier)

    def finish(self) -> None:
        """Lay what is left end to end, cut into powers of two."""
        left, self.rest = self.rest, []
        total = sum(len(p[1]) for p in left)
        pieces = deque(left)
        size = self.tiers[0]
        while total:
            while size > total:
                size //= 2
            window, gap = [], size
            while gap:
                piece = pieces.popleft()
                if len(piece[1]) > gap:
                    piece, back = self._cut(piece, gap)
                    pieces.appendleft(back)
                window.append(piece)
                gap -= len(piece[1])
            self._emit(window, size)
            total -= size

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, closing_id: int = 0, tiers=TIERS,
         step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece of (doc_id, text): where its ids lie in the document and in which sequence."""
    def batch(rows):
        columns = list(zip(*rows)) or [()] * 9
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def run(batches):
        bpe = ByteBpe(json_path, ranks_path, pattern)
        packer = Packer(TaskContext.get().partitionId(), tiers, step_tokens)
        close = np.array([closing_id], np.uint32)
        for part in text_slices(batches):
            ids = part.column("doc_id").to_pylist()
            packer.add([(d, np.concatenate([bpe.encode(t), close])) for d, t in zip(ids, texts_of(part))])
            yield batch(packer.take())
        packer.finish()
        yield batch(packer.take())

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
