"""Personal data by patterns and a skip-chain conditional random field.

Base spans come from four patterns with checks (`base_spans`). The field then looks at the tokens that hold a digit or
an @ sign (all other tokens are certain to be no entity, so they need no node). Labels are `none` and the four kinds.
Neighbouring tokens share chain potentials; occurrences of the same or a similar token anywhere in the document (same
core, same last seven digits, same local part) share skip potentials, each with the one before it. Loopy sum-product
message passing makes labels agree over the whole document; tokens that come out as an entity with enough certainty and
touch no base span are added. Weights are fitted by pseudo-likelihood to the base spans of all documents, from counts of
(shape, label, neighbour labels, skip labels), a table that does not grow with the text; its `MOST_COMBINATIONS` most
frequent rows are used.

Null and empty texts have no spans. Repeated rows are treated one by one. An empty table gives no rows. Offsets are code
points, ends exclusive.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import sha256, text_slices, texts_of

KINDS = ("email", "ip", "card", "phone")
MOST_COMBINATIONS = 50_000
CERTAIN = 0.9
ROUNDS = 12
# Added to the fitted skip weight of equal labels: repeats of a token that a pattern has found once follow it.
AGREEMENT = 8.0
SCHEMA = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]

_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*")
_EDGE = " \t.,;:!?()[]{}<>\"'|"


def _emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > free and text[a - 1] in _LOCAL_SET:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((a, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in (2 * int(c) for c in digits[-2::-2]))
    return total % 10 == 0


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of the four kinds, each leftmost and non-overlapping; matches that fail their check are dropped."""
    email = _emails(text) if "@" in text else []
    ip, card, phone = [], [], []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) < 3 or len(p) == 3 and p <= "255" for p in parts):
                ip.append(m.span())
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    card.append(m.span())
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    phone.append(m.span())
    return [email, ip, card, phone]


# ---- tokens ----------------------------------------------------------------------------------------

SIZES = (7, 3, 4, 2, 2, 2, 2)
_STEPS = (3, 6, 9, 12, 19)


def shape(token: str) -> int:
    """Number of the token's shape: digits, @ sign, dots, plus sign, bracket, hyphen, letters."""
    digits = sum(c in "0123456789" for c in token)
    at = token.find("@")
    dots = token.rstrip(".,;:!?").count(".")
    values = (
        0 if not digits else 1 + sum(digits > s for s in _STEPS),
        0 if at < 0 else 2 if "." in token[at:].rstrip(".,;:!?") else 1,
        0 if not dots else 1 if dots < 3 else 2 if dots == 3 else 3,
        int(token.startswith("+")), int("(" in token or ")" in token), int("-" in token), int(any(c.isalpha() for c in token)))
    n = 0
    for v, s in zip(values, SIZES):
        n = n * s + v
    return n


def _design() -> np.ndarray:
    """Indicator row of every shape: one column per value, a constant last."""
    n = int(np.prod(SIZES))
    index, columns = np.arange(n), []
    for s in reversed(SIZES):
        columns.insert(0, np.eye(s)[index % s])
        index = index // s
    return np.hstack([*columns, np.ones((n, 1))])


def keys_of(token: str) -> list[str]:
    """What makes two tokens the same or similar."""
    core = token.strip(_EDGE).lower()
    keys = ["t" + core] if len(core) >= 4 else []
    digits = "".join(c for c in core if c in "0123456789")
    if len(digits) >= 7:
        keys.append("d" + digits[-7:])
    at = core.find("@")
    if at >= 3:
        keys.append("l" + core[:at])
    return keys


class Graph:
    """Nodes and edges of the tokens of several texts."""

    def __init__(self):
        self.doc, self.start, self.end, self.shape, self.label = [], [], [], [], []
        self.chain, self.skip = [], []

    def add(self, doc: int, text: str, base: list[list[tuple[int, int]]]) -> None:
        last, before = None, {}
        marks = sorted((a, b, k + 1) for k, spans in enumerate(base) for a, b in spans)
        reach, i = [], 0
        for m in _TOKEN.finditer(text):
            a, b, n = m.start(), m.end(), len(self.doc)
            while i < len(marks) and marks[i][0] < b:
                reach.append(marks[i])
                i += 1
            reach = [x for x in reach if x[1] > a]
            token = m[0]
            self.doc.append(doc)
            self.start.append(a)
            self.end.append(b)
            self.shape.append(shape(token))
            self.label.append(min((x[2] for x in reach), default=0))
            if last is not None and a - last[1] <= 2 and "\n" not in text[last[1]: a]:
                self.chain.append((last[0], n))
            last = (n, b)
            linked = set()
            for key in keys_of(token):
                old = before.get(key)
                if old is not None and old not in linked:
                    self.skip.append((old, n))
                    linked.add(old)
                before[key] = n


def _first_neighbour(n: int, edges: list, labels: np.ndarray, forward: bool) -> np.ndarray:
    """Label of one neighbour per node along edges, len(KINDS) + 1 where there is none."""
    out = np.full(n, len(KINDS) + 1, np.int64)
    if edges:
        a, b = np.array(edges, np.int64).T
        if forward:
            out[a] = labels[b]
        else:
            out[b] = labels[a]
    return out


COMBINATION = "shape int, y int, l int, r int, p int, q int"


def combinations(docs: DataFrame) -> DataFrame:
    """(shape, label, left, right, previous and next skip label, n): all that the fit needs of the texts."""
    def run(batches):
        for part in text_slices(batches):
            g = Graph()
            for i, t in enumerate(texts_of(part)):
                if "@" in t or _DIGIT.search(t):
                    g.add(i, t, base_spans(t))
            n, y = len(g.doc), np.array(g.label, np.int64)
            rows = np.stack([np.array(g.shape, np.int64), y, _first_neighbour(n, g.chain, y, False),
                             _first_neighbour(n, g.chain, y, True), _first_neighbour(n, g.skip, y, False),
                             _first_neighbour(n, g.skip, y, True)]) if n else np.zeros((6, 0), np.int64)
            yield pa.record_batch([pa.array(c, pa.int32()) for c in rows], names=list("syLRpq"))

    names = [c.split()[0] for c in COMBINATION.split(", ")]
    rows = docs.select("text").mapInArrow(lambda it: (b.rename_columns(names) for b in run(it)), COMBINATION)
    return rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


class Field:
    """Weights: unary (shape x label), chain (left label x right label), skip (symmetric), and label weights of a node
    without a left, a right, an earlier or later similar neighbour."""

    def __init__(self, unary, chain, skip, alone):
        self.unary, self.chain, self.skip, self.alone = unary, chain, skip, alone

    @classmethod
    def fit(cls, rows: np.ndarray, agreement: float = AGREEMENT, steps: int = 1500, rate: float = 0.5,
            decay: float = 1e-4) -> Field:
        """Pseudo-likelihood by gradient steps over (shape, y, l, r, p, q, n) rows."""
        labels = len(KINDS) + 1
        design = _design()
        W, C, S, A = np.zeros((design.shape[1], labels)), np.zeros((labels, labels)), np.zeros((labels, labels)), np.zeros((4, labels))
        if len(rows):
            s, y, *around, n = rows.T
            weight = n / n.sum()
            X, Y = design[s], np.eye(labels)[y]
            left, right, p, q = (np.eye(labels + 1)[c][:, :labels] for c in around)
            lone = np.stack([c == labels for c in around], 1).astype(float)
            momentum = [np.zeros_like(a) for a in (W, C, S, A)]
            for _ in range(steps):
                gap = (Y - _softmax(X @ W + left @ C + right @ C.T + (p + q) @ S + lone @ A)) * weight[:, None]
                pair = (p + q).T @ gap
                for k, (a, g) in enumerate(((W, X.T @ gap), (C, left.T @ gap + gap.T @ right), (S, (pair + pair.T) / 2), (A, lone.T @ gap))):
                    momentum[k] = 0.9 * momentum[k] + g - decay * a
                    a += rate * momentum[k]
        return cls(design @ W, C, S + agreement * np.eye(labels), A)

    def marginals(self, shapes, chain, skip, known=None, rounds: int = ROUNDS, damping: float = 0.3) -> np.ndarray:
        """Label probabilities per node by loopy sum-product; nodes with a known label above 0 keep it."""
        n = len(shapes)
        unary = self.unary[np.asarray(shapes, np.int64)]
        if not n:
            return unary
        chain, skip = np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2)
        for k, ends in enumerate((chain[:, 1], chain[:, 0], skip[:, 1], skip[:, 0])):
            alone = np.ones(n, bool)
            alone[ends] = False
            unary[alone] += self.alone[k]
        if known is not None:
            fixed = np.flatnonzero(known)
            unary[fixed] = -50.0
            unary[fixed, np.asarray(known)[fixed]] = 0.0
        edges = np.concatenate([chain, skip])
        if not len(edges):
            return _softmax(unary)
        potential = np.concatenate([np.broadcast_to(self.chain, (len(chain), *self.chain.shape)),
                                    np.broadcast_to(self.skip, (len(skip), *self.skip.shape))])
        src = np.r_[edges[:, 0], edges[:, 1]]
        dst = np.r_[edges[:, 1], edges[:, 0]]
        both = np.concatenate([potential, potential.transpose(0, 2, 1)])
        back = np.r_[np.arange(len(edges)) + len(edges), np.arange(len(edges))]
        message = np.zeros((len(src), unary.shape[1]))
        for _ in range(rounds):
            belief = unary.copy()
            np.add.at(belief, dst, message)
            into = (belief[src] - message[back])[:, :, None] + both
            top = into.max(1)
            new = top + np.log(np.exp(into - top[:, None, :]).sum(1))
            new -= new.max(1, keepdims=True)
            message = damping * message + (1 - damping) * new
        belief = unary.copy()
        np.add.at(belief, dst, message)
        return _softmax(belief)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_field(docs: DataFrame) -> Field:
    names = [c.split()[0] for c in COMBINATION.split(", ")]
    found = combinations(docs).orderBy(F.desc("n"), *names).limit(MOST_COMBINATIONS).collect()
    return Field.fit(np.array([tuple(r) for r in found], np.int64).reshape(-1, 7))


def document_spans(texts: list[str], field: Field, certain: float = CERTAIN) -> list[tuple[list, list]]:
    """Per text: base spans of the four kinds, added spans of the four kinds."""
    g, out = Graph(), []
    for i, t in enumerate(texts):
        if "@" in t or _DIGIT.search(t):
            base = base_spans(t)
            g.add(i, t, base)
        else:
            base = [[], [], [], []]
        out.append((base, [[], [], [], []]))
    if not g.doc:
        return out
    marginal = field.marginals(g.shape, g.chain, g.skip, np.array(g.label, np.int64))
    best, label = marginal.max(1), marginal.argmax(1)
    joined = {b for _, b in g.chain}
    for n in np.flatnonzero((label > 0) & (best >= certain)).tolist():
        if g.label[n]:
            continue
        text, spans = texts[g.doc[n]], out[g.doc[n]][1][label[n] - 1]
        token = text[g.start[n]: g.end[n]]
        a = g.start[n] + len(token) - len(token.lstrip(_EDGE))
        b = g.end[n] - (len(token) - len(token.rstrip(_EDGE)))
        if a >= b:
            continue
        if spans and n in joined and text[spans[-1][1]: a].strip(_EDGE) == "" and a - spans[-1][1] <= 4:
            spans[-1] = (spans[-1][0], b)
        else:
            spans.append((a, b))
    return out


def _listed(kinds: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, spans in enumerate(kinds) for a, b in spans)


def find(docs: DataFrame, field: Field, certain: float = CERTAIN) -> DataFrame:
    """Counts and spans per row of (doc_id, text)."""
    def run(batches):
        for part in text_slices(batches):
            found = document_spans(texts_of(part), field, certain)
            both = [[sorted(a + b) for a, b in zip(base, more)] for base, more in found]
            yield pa.record_batch(
                [part.column("doc_id").cast(pa.int64()), *(pa.array([len(f[0][k]) for f in found], pa.int64()) for k in range(4)),
                 pa.array([sha256(_listed(f[0]).encode()) for f in found], pa.string()), pa.array(map(_listed, both), pa.string()),
                 pa.array([sum(map(len, f[1])) for f in found], pa.int64())], names=NAMES)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, field: Field, certain: float = CERTAIN) -> DataFrame:
    """The same rows with every span replaced by its kind in angle brackets; n_chars follows the text. A null text stays."""
    schema = docs.schema

    def run(batches):
        for part in text_slices(batches):
            texts = part.column("text").to_pylist()
            clean = []
            for t, (base, more) in zip(texts, document_spans([t or "" for t in texts], field, certain)):
                at, out = 0, []
                for a, b, k in sorted((a, b, k) for spans in (base, more) for k, s in enumerate(spans) for a, b in s):
                    if b <= at:
                        continue
                    if a >= at:
                        out += [t[at:a], f"<{KINDS[k].upper()}>"]
                    at = b
                clean.append(t if not out else "".join(out) + t[at:])
            columns = dict(zip(part.schema.names, part.columns))
            columns["text"] = pa.array(clean, part.schema.field("text").type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([n if c == t or c is None else len(c) for n, c, t in zip(
                    columns["n_chars"].to_pylist(), clean, texts)], part.schema.field("n_chars").type)
            yield pa.record_batch(list(columns.values()), names=list(columns))

    return docs.mapInArrow(run, schema)
