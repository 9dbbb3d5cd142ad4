"""Runs of words against a direct search for every period."""

import bisect
import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from vecmine.llm import periodic
from vecmine.llm.queries import looped_tail, with_looped_tails


def plain_runs(w, least=12):
    n, out = len(w), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            length = i + p - start
            if length >= max(least, 2 * p) and not any(w[start: start + length - q] == w[start + q: start + length] for q in range(1, p)):
                out.append((start, length, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_direct_search():
    r = random.Random(3)
    for _ in range(300):
        docs = []
        for _ in range(r.randint(1, 6)):
            d = [r.randrange(r.choice([1, 2, 2, 3, 5])) for _ in range(r.randint(0, 60))]
            if r.random() < 0.5 and d:
                d = d + (d[: r.randint(1, 8)] * 8)[: r.randint(0, 50)] + d[: r.randint(0, len(d))]
            docs.append(d)
        least = r.choice([2, 3, 5, 12])
        starts = np.r_[0, np.cumsum([len(d) for d in docs])]
        found = list(zip(*(x.tolist() for x in periodic.runs_of(np.array([x for d in docs for x in d], np.int64), starts, least))))
        assert found == [(k, *run) for k, d in enumerate(docs) for run in plain_runs(d, least)]


def test_long_periodic_words():
    for w, want in (([0] * 50_000, [(0, 50_000, 1)]), (list(range(7)) * 5000, [(0, 35_000, 7)]),
                    ([0, 1] * 20_000 + [0] * 20_000, [(0, 40_001, 2), (40_000, 20_000, 1)])):
        own, start, length, period = periodic.runs_of(np.array(w), np.array([0, len(w)]))
        assert list(zip(start.tolist(), length.tolist(), period.tolist())) == want


def test_ordered_positions():
    r = random.Random(1)
    numbers = r.sample(range(20_000), 6000)
    held, ordered = periodic.Positions(sorted(numbers[:1500])), sorted(numbers[:1500])
    for x in numbers[1500:]:
        at = bisect.bisect_left(ordered, x)
        assert held.around(x) == (ordered[at - 1] if at else -1, ordered[at] if at < len(ordered) else -1)
        ordered.insert(at, x)
        held.add(x)
    assert list(held) == ordered == sorted(numbers) and len(held) == 6000
    assert held.around(-5)[0] == -1 and held.around(10 ** 6)[1] == -1


def expected(rows):
    out = []
    for d, t in rows:
        w = looped_tail((t or "").encode().split(), d)
        runs = plain_runs(w)
        gone = {p for s, n, q in runs for p in range(s + q, s + n)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else None
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        text = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((d, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                    hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
    return sorted(out, key=str)


def test_rows_equal_direct_search(spark):
    r = random.Random(9)
    rows = [(1, None), (2, ""), (3, " \n\t"), (3, " \n\t"), (None, "a b " * 20), (None, None), (4, "x" * 100_000), (5, "a\x1cb " * 15), (6, "é " * 11), (7, "é " * 12)]
    rows += [(k, " ".join(r.choice("ab cd e".split()) for _ in range(r.randint(0, 90))) + r.choice(["", " tail one two" * 9])) for k in range(100, 220)]
    assert any(zlib.crc32(str(k).encode()) % 10 == 0 for k in range(100, 220))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit(1), "start": F.lit("s"), "collapsed": F.lit(None).cast("int")})
    got = periodic.digests(periodic.find(with_looped_tails(docs.repartition(4))))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(x) for x in got.collect()), key=str) == expected(rows)
    assert periodic.digests(periodic.find(docs.limit(0))).count() == 0


def test_collapsed_text_is_a_real_output(spark):
    docs = spark.createDataFrame([(1, "intro " + "buy now cheap " * 10 + "end")], "doc_id long, text string")
    row = periodic.find(docs).first()
    assert row.collapsed == "intro buy now cheap end" and [tuple(x) for x in row.runs] == [(1, 30, 3)]


def test_looped_tail_follows_the_contract():
    d = next(k for k in range(1000) if zlib.crc32(str(k).encode()) % 10 == 0)
    words = [str(k).encode() for k in range(50)]
    g = zlib.crc32(str(d).encode()) // 10
    a = g % 50
    p = 1 + int((50 - a) / (3 + g % 8))
    assert looped_tail(words, d) == [words[i] if i < a else words[a + (i - a) % p] for i in range(50)]
    assert re.fullmatch(r"[0-9]+", words[0].decode())
