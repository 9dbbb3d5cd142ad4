"""SentencePiece BPE by vectorised merge rounds, and its decoding.

All distinct words of a slice lie end to end in flat arrays. A round finds, in every word that still has one, the best
ranked pair (segmented minimum, leftmost of equals), merges it and compacts. Occurrences of that pair further right are
merged in the same round as long as no merge before them has made a pair that ranks as well or better, so a round does
exactly what the one-at-a-time order would do. Words cannot interact: no piece has a space mark after another character.

Null and empty texts give no tokens and decode to the empty text. Texts without spaces are one word; the words are cut
first wherever no piece contains the two characters around the cut, which changes nothing.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import sha256, text_slices, texts_of

MARK = "▁"
NONE = np.int64(1 << 40)
CACHE = 300_000
_ODD = re.compile(r"^ |  | $")
_RUNS = re.compile(r" *[^ ]+| +")


class Pieces:
    """Tables made from a SentencePiece BPE model file (byte fallback, identity normalisation)."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as spec

        model = spec.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or model.normalizer_spec.precompiled_charsmap \
                or model.normalizer_spec.remove_extra_whitespaces or not model.normalizer_spec.add_dummy_prefix:
            raise ValueError("a BPE model with byte fallback, dummy prefix and identity normalisation is needed")
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (1, 4, 5)}
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("pieces with inner spaces are not supported")
        self.normal = normal
        # Symbols: piece ids, then characters that are no piece of their own.
        self.symbol = {p: i for p, i in normal.items() if len(p) == 1}
        self.first_char = len(model.pieces)
        self.chars: list[str] = []
        scores = {p: model.pieces[i].score for p, i in normal.items()}
        rank = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs, self.inner = {}, set()
        for p, i in normal.items():
            for k in range(1, len(p)):
                self.inner.add(p[k - 1: k + 1])
                a, b = self._id(p[:k]), self._id(p[k:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = (rank[scores[p]], i)
        keys = np.array(sorted(pairs), np.int64)
        self.keys = keys
        self.rank = np.array([pairs[k][0] for k in keys.tolist()] + [NONE], np.int64)
        self.merged = np.array([pairs[k][1] for k in keys.tolist()] + [-1], np.int64)
        self.byte = np.zeros(256, np.int64)
        shown = []
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                value = int(p.piece[3:5], 16)
                self.byte[value] = i
                shown.append(bytes([value]))
            elif p.type == 2:
                shown.append((model.trainer_spec.unk_surface or " ⁇ ").encode())
            elif p.type == 3:
                shown.append(b"")
            else:
                shown.append(p.piece.replace(MARK, " ").encode())
        self.shown_len = np.array([len(x) for x in shown], np.int64)
        self.shown_at = np.concatenate([[0], np.cumsum(self.shown_len)[:-1]])
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.memo: dict[str, int] = {}
        self._reset()

    def _id(self, text: str):
        if text in self.normal:
            return self.normal[text]
        if len(text) != 1:
            return None
        return self._char(text)

    def _char(self, c: str) -> int:
        i = self.symbol.get(c)
        if i is None:
            i = self.symbol[c] = self.first_char + len(self.chars)
            self.chars.append(c)
        return i

    def _reset(self) -> None:
        self.memo.clear()
        self.flat = [np.zeros(0, np.int64)]
        self.lengths: list[int] = []
        self.joined: list[str] = []

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Row of each pair in the merge table; the last row stands for none."""
        key = (left << 32) | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at, len(self.keys)) if len(self.keys) else np.zeros(len(key), np.int64)

    def merge_rounds(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and their (ascending) words, merged until no word has a pair of the table."""
        n = int(word[-1]) + 1 if len(word) else 0
        done_sym, done_word = [], []
        row = np.full(len(sym), len(self.keys), np.int64)
        if len(sym) > 1:
            row[:-1] = np.where(word[1:] == word[:-1], self.lookup(sym[:-1], sym[1:]), len(self.keys))
        rank = self.rank[row]
        while len(sym):
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[start, len(sym)])
            best = np.minimum.reduceat(rank, start)
            alive = best < NONE
            if not alive.all():
                keep = np.repeat(alive, size)
                done_sym.append(sym[~keep])
                done_word.append(word[~keep])
                sym, word, row, rank, best, size = sym[keep], word[keep], row[keep], rank[keep], best[alive], size[alive]
                if not len(sym):
                    break
                start = np.cumsum(size) - size
            best_each = np.repeat(best, size)
            hit = rank == best_each
            at = np.flatnonzero(hit)
            # Of overlapping hits (they follow each other directly) every second one goes.
            head = np.r_[True, np.diff(at) != 1]
            step = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            at = at[step % 2 == 0]
            made = self.merged[row[at]]
            # What the merge at `at` makes beside it, when those to its left in this round are done.
            last = len(sym) - 1
            left_ok = (at > 0) & (word[np.maximum(at - 1, 0)] == word[at])
            left = sym[np.maximum(at - 1, 0)].copy()
            prev = np.r_[False, at[1:] - at[:-1] == 2]
            left[prev] = made[np.flatnonzero(prev) - 1]
            right_at = np.minimum(at + 2, last)
            right_ok = (at + 2 <= last) & (word[right_at] == word[at])
            new_left = np.where(left_ok, self.rank[self.lookup(left, made)], NONE)
            new_right = np.where(right_ok, self.rank[self.lookup(made, sym[right_at])], NONE)
            unsafe = np.minimum(new_left, new_right) <= best_each[at]
            # A word goes on to the first merge that makes such a pair, that one included.
            w = word[at]
            first = np.r_[True, w[1:] != w[:-1]]
            before = np.cumsum(unsafe) - unsafe
            take = before == np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(w)]))
            at, made = at[take], made[take]
            sym = sym.copy()
            sym[at] = made
            gone = np.zeros(len(sym), bool)
            gone[at + 1] = True
            stale = np.zeros(len(sym), bool)
            stale[at] = True
            stale[np.maximum(at - 1, 0)] = True
            # A merged neighbour two to the left has its right edge at the removed symbol's place.
            two = at[(at > 1)] - 2
            stale[two[gone[two + 1]]] = True
            keep = ~gone
            sym, word, row, rank, stale = sym[keep], word[keep], row[keep], rank[keep], stale[keep]
            fix = np.flatnonzero(stale)
            nxt = np.minimum(fix + 1, len(sym) - 1)
            inside = (fix + 1 < len(sym)) & (word[nxt] == word[fix])
            row[fix] = np.where(inside, self.lookup(sym[fix], sym[nxt]), len(self.keys))
            rank[fix] = self.rank[row[fix]]
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def _learn(self, words: list[str]) -> None:
        """Encode words that are new to this process and remember them."""
        text = "".join(words)
        point = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        seen = np.flatnonzero(np.bincount(point, minlength=1)) if point.max() < 1 << 21 else np.unique(point)
        table = np.zeros(int(seen[-1]) + 1, np.int64)
        table[seen] = [self._char(chr(c)) for c in seen.tolist()]
        sym = table[point]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), sizes)
        part = word
        if sizes.max() > 64:
            # Long words fall apart wherever no piece holds the two characters.
            a, b = point[:-1].astype(np.int64), point[1:].astype(np.int64)
            inner = np.array(sorted((ord(x[0]) << 21) | ord(x[1]) for x in self.inner), np.int64)
            key = (a << 21) | b
            at = np.minimum(np.searchsorted(inner, key), len(inner) - 1)
            part = np.r_[0, np.cumsum((inner[at] != key) | (word[1:] != word[:-1]))]
        sym, part_of = self.merge_rounds(sym, part)
        word_of = word[np.r_[0, np.flatnonzero(np.diff(part)) + 1]][part_of]
        odd = np.flatnonzero(sym >= self.first_char)
        if len(odd):
            spelled = [self.chars[i - self.first_char].encode() for i in sym[odd].tolist()]
            count = np.ones(len(sym), np.int64)
            count[odd] = [len(x) for x in spelled]
            at = np.cumsum(count) - count
            ids = np.repeat(sym, count)
            inside = np.repeat(at[odd], count[odd]) + np.concatenate([np.arange(c) for c in count[odd].tolist()])
            ids[inside] = self.byte[np.frombuffer(b"".join(spelled), np.uint8)]
            word_of = np.repeat(word_of, count)
        else:
            ids = sym
        lengths = np.bincount(word_of, minlength=len(words)).tolist()
        base = len(self.lengths)
        self.memo.update((w, base + i) for i, w in enumerate(words))
        self.flat.append(ids)
        self.lengths.extend(lengths)
        text, a = list(map(str, ids.tolist())), 0
        for size in lengths:
            self.joined.append(",".join(text[a: a + size]))
            a += size

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(ids of all texts end to end, offsets, ids of each text in decimal joined by commas)."""
        if len(self.memo) > CACHE:
            self._reset()
        cut = []
        for t in texts:
            t = t.replace(MARK, " ")
            if not t:
                cut.append([])
            elif _ODD.search(t):
                cut.append([x.replace(" ", MARK) for x in _RUNS.findall(" " + t)])
            else:
                cut.append([MARK + x for x in t.split(" ")])
        words = [w for x in cut for w in x]
        fresh = [w for w in dict.fromkeys(words) if w not in self.memo]
        if fresh:
            self._learn(fresh)
        index = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        if len(self.flat) > 1:
            self.flat = [np.concatenate(self.flat)]
        lengths = np.array(self.lengths, np.int64)
        starts = np.cumsum(lengths) - lengths
        size = lengths[index] if len(index) else np.zeros(0, np.int64)
        ends = np.cumsum(size)
        where = np.repeat(starts[index] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0) if len(index) else np.zeros(0, np.int64)
        ids = self.flat[0][where]
        counts = np.r_[0, np.cumsum([len(x) for x in cut])]
        offsets = np.r_[0, ends][counts]
        joined, a, picked = [], 0, index.tolist()
        for x in cut:
            joined.append(",".join([self.joined[i] for i in picked[a: a + len(x)]]))
            a += len(x)
        return ids, offsets, joined

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of id runs: pieces' bytes end to end, one leading space of each run dropped, bad UTF-8 replaced."""
        size = self.shown_len[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        data = self.shown[np.repeat(self.shown_at[ids] - (ends - size), size) + np.arange(total)].tobytes() if total else b""
        cuts = np.r_[0, ends][offsets]
        out = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            piece = data[a:b]
            out.append((piece[1:] if piece[:1] == b" " else piece).decode("utf-8", "replace"))
        return out


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_texts(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids array<int>, text) for (doc_id, text): encoded, then decoded again."""
    def run(batches):
        pieces = Pieces(model)
        for part in text_slices(batches):
            ids, offsets, _ = pieces.encode(texts_of(part))
            yield pa.record_batch([part.column("doc_id").cast(pa.int64()),
                                   pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())),
                                   pa.array(pieces.decode(ids, offsets), pa.string())], names=["doc_id", "ids", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, text string")


def encoding_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row of (doc_id, text)."""
    def run(batches):
        pieces = Pieces(model)
        for part in text_slices(batches):
            ids, offsets, joined = pieces.encode(texts_of(part))
            decoded = pieces.decode(ids, offsets)
            yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array(np.diff(offsets), pa.int64()),
                                   pa.array([sha256(x.encode()) for x in joined], pa.string()),
                                   pa.array([sha256(x.encode()) for x in decoded], pa.string())],
                                  names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
