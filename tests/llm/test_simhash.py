"""SimHash components against all pairs of fingerprints computed the plain way."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vecmine.llm import simhash


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [words] if 0 < len(words) < 3 else [words[k: k + 3] for k in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = [plain_print(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    live = [k for k, (d, _) in enumerate(rows) if d is not None]
    for i in live:
        for j in live:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for k in live:
        least[root(k)] = min(rows[k][0], least.get(root(k), rows[k][0]))
    return sorted(((d, f"{p:016x}", least[root(k)] if d is not None else None) for k, ((d, _), p) in enumerate(zip(rows, prints))), key=str)


def answered(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    names = ["alpha", "Beta", "gämma", "delta", "ÄPSILON", "zeta", "eta", "theta", "iota", "kappa"]
    out = [(1, None), (2, ""), (3, " \n\t "), (4, "ab"), (5, "AB"), (6, "one two"), (7, "One  TWO"), (None, "one two"), (8, "x\x1cy z w"), (9, "q " * 9000),
           (9, "q " * 9000)]
    base = [[r.choice(names) + str(r.randrange(40)) for _ in range(r.choice([5, 60, 300]))] for _ in range(12)]
    for k in range(200):
        words = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            words[r.randrange(len(words))] = r.choice(names)
        out.append((1000 - k, " ".join(words)))
    return out


@pytest.mark.parametrize("stripe", [2048, 4])
def test_components_equal_all_pairs(spark, rows, stripe):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"print": F.lit("p"), "list": F.lit(1), "n": F.lit(None).cast("int")})
    got = simhash.components(docs.repartition(5), stripe=stripe)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert answered(got) == plain_components(rows)


def test_dense_families_in_stripes(spark):
    r = random.Random(8)
    seeds = [r.getrandbits(64) for _ in range(4)]
    prints = {s ^ sum(1 << b for b in r.sample(range(64), r.randrange(0, 5))) for s in seeds for _ in range(120)} | {r.getrandbits(64) for _ in range(200)}
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    frame = spark.createDataFrame(signed, "print long")
    wanted = {}
    up = {p: p for p in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, p in enumerate(prints):
        for q in prints[:i]:
            if bin(p ^ q).count("1") <= 3:
                wanted[p, q] = 1
                up[root(p)] = root(q)
    for stripe in (2048, 16):
        forest = simhash.links(frame, stripe=stripe).distinct().collect()
        held = {p: p for p in prints}

        def top(x):
            while held[x] != x:
                x = held[x]
            return x

        for e in forest:
            held[top(e.src & (1 << 64) - 1)] = top(e.dst & (1 << 64) - 1)
        for p in prints:
            for q in (root(p),):
                assert top(p) == top(q)
        assert len({top(p) for p in prints}) == len({root(p) for p in prints})


def test_count_filter_never_loses_a_pair():
    r = np.random.default_rng(4)
    x = r.integers(0, 1 << 63, 20_000).astype(np.uint64)
    y = x.copy()
    for _ in range(3):
        y ^= np.uint64(1) << r.integers(0, 64, len(x)).astype(np.uint64)
    assert simhash.linked(x, y).all()
    assert not simhash.linked(x, x ^ np.uint64(0x0101010100000000)).any()
    shared = np.zeros(len(x), bool)
    for key in simhash.KEYS:
        shared |= np.all([(x >> np.uint64(8 * k)) & np.uint64(255) == (y >> np.uint64(8 * k)) & np.uint64(255) for k in key], axis=0)
    assert shared.all()


def test_empty_table(spark):
    assert simhash.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only_null = spark.createDataFrame([(None, "a b c d")], "doc_id long, text string")
    assert [(r.doc_id, r.component_id) for r in simhash.components(only_null).collect()] == [(None, None)]
