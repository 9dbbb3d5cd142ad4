"""Operators against brute force, library results or exact round trips, with nulls, empty and very long texts, copies and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecmine.llm import bagminhash, compression, language, nearest, packing, piece, pii, recompression, separators, toxicity
from vecmine.llm.bytebpe import ByteBpe
from vecmine.llm.queries import bpe_files, tokenizer_path

DOC = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \n "), (3, " \n "), (None, "a b c"), (4, "x" * 200_000), (5, "same text here"), (5, "same text here")]


def frame(spark, rows):
    """Rows of (doc_id, text) with columns whose names operators use themselves."""
    return spark.createDataFrame(rows, DOC).withColumns({"score": F.lit(1), "start": F.lit("q"), "node": F.lit(None).cast("string")}).repartition(3)


def test_piece_equals_library():
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    own, library, r = piece.Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path), random.Random(1)
    texts = ["", " ", "  a  b ", "▁a▁▁b", "a" * 30, "the<s></s><0x0A>\n\t", "日本語 執벨", "\x00é 🙂🙂", "ab" * 3000]
    texts += ["".join(r.choice("abcdet  \n▁éñ执.,") for _ in range(r.randint(1, 60))) for _ in range(300)]
    ids, offsets, joined = own.encode(texts)
    want = library.encode(texts, num_threads=1)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want
    assert joined == [",".join(map(str, w)) for w in want]
    assert own.decode(ids, offsets) == [library.decode(w) for w in want]


def test_piece_rows(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    got = piece.encoding_digests(frame(spark, ODD), path).collect()
    assert len(got) == len(ODD) and {r.n_tokens for r in got if r.doc_id in (1, 2)} == {0}
    assert piece.encoding_digests(frame(spark, ODD).limit(0), path).count() == 0


def test_packing_covers_everything_without_padding(spark):
    b = ByteBpe(**bpe_files())
    r = random.Random(2)
    rows = ODD + [(i + 10, " ".join(r.choice(["alpha", "beta", "<|endoftext|>", "Ωmega", "12½"]) for _ in range(r.choice([1, 30, 400, 900])))) for i in range(60)]
    got = packing.pack(frame(spark, rows), **bpe_files()).collect()
    texts = collections.defaultdict(list)
    for d, t in rows:
        texts[d].append(b.slow.encode(t or "", add_special_tokens=False).ids + [0])
    total = 0
    for p in got:
        assert any(p.doc_tokens == len(ids) and zlib.crc32(np.array(ids[p.start: p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for ids in texts[p.doc_id])
        total += p.length
    assert total == sum(len(ids) for v in texts.values() for ids in v)
    sequences = collections.defaultdict(list)
    for p in got:
        sequences[p.sequence_id].append((p.offset, p.length, p.tier))
    for parts in sequences.values():
        parts.sort()
        assert all(a[0] + a[1] == c[0] for a, c in zip(parts, parts[1:])) and parts[0][0] == 0
        size = sum(x[1] for x in parts)
        assert size == parts[0][2] <= 1024 and size & (size - 1) == 0
    assert packing.pack(frame(spark, []), **bpe_files()).count() == 0


def test_repeated_words_brute():
    for seed in range(60):
        r = random.Random(seed)
        lists = [[r.randrange(3) for _ in range(r.randint(0, 30))] for _ in range(5)]
        got = compression.repeated_words(np.array([w for x in lists for w in x], np.int64), np.r_[0, np.cumsum([len(x) for x in lists])])
        for x, g in zip(lists, got):
            c = collections.Counter(tuple(x[i: i + 5]) for i in range(len(x) - 4))
            assert g == len({j for i in range(len(x) - 4) if c[tuple(x[i: i + 5])] > 1 for j in range(i, i + 5)})


def test_compression_verdicts(spark):
    r = random.Random(3)
    prose = " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(400))
    noise = "".join(chr(r.randrange(33, 2000)) for _ in range(3000)) + " " + " ".join(str(i) for i in range(10))
    rows = ODD + [(20, prose), (21, "abc def ghi jkl " * 3 + "lorem " * 900), (22, noise), (23, "one two\nthree\nthree\n # $ x\n\n" + prose)]
    got = {x.doc_id: x for x in compression.quality(frame(spark, rows)).collect()}
    assert got[20].kept and not got[21].kept and not got[22].kept and got[23].n_dup_lines == 1 and got[23].n_symbols == 2
    assert got[1].n_words == 0 and got[1].base_failed and not got[1].kept


def brute_spans(t):
    def luhn(x):
        d = [int(c) for c in x if c.isdigit()]
        s = sum(v if k % 2 == 0 else 2 * v - 9 * (v > 4) for k, v in enumerate(reversed(d)))
        return 13 <= len(d) <= 19 and s % 10 == 0
    return [[m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
            [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))],
            [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if luhn(m[0])],
            [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(x.isdigit() for x in m[0]) <= 15]]


def test_pii_base_and_field(spark):
    r = random.Random(4)
    parts = ["a", "@", ".", "1", "25", "4", "-", " ", "+", "(", "@a.b", "é", "1.2.3.4", "4111 1111 1111 1111", "+1 (017) 555-7713", "_%"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        assert pii.base_spans(t) == brute_spans(t)
    words = ["plain", "words", "in", "2024", "cost", "12.50"]
    rows = [(i, " ".join(r.choice(words) for _ in range(20)) + f" +1 ({r.randrange(100, 999)}) 555-{r.randrange(1000, 9999)} " + " ".join(r.choice(words) for _ in range(5)))
            for i in range(10, 200)]
    text = "Call +1 (017) 555-7713 today, in room 101. Later dial 555-7713 instead."
    docs = frame(spark, rows + ODD + [(500, text)])
    field = pii.fit_field(docs)
    got = {x.doc_id: x for x in pii.find(docs, field).collect()}
    assert got[1].spans == "" and got[500].n_phone == 1
    assert got[500].spans == f"phone:5:22,phone:{text.rindex('555')}:{text.rindex('555') + 8}"
    clean = {x.doc_id: x.text for x in pii.redact(docs, field).collect()}
    assert clean[500] == "Call <PHONE> today, in room 101. Later dial <PHONE> instead." and clean[1] is None


def test_language(spark):
    r = random.Random(5)
    kinds = {"aa": "bakolumi", "bb": "strengphx", "cc": "ñéwyzqua"}
    def text(k):
        return " ".join("".join(r.choice(kinds[k]) for _ in range(r.randint(2, 8))) for _ in range(40))
    train = spark.createDataFrame([(text(k), k) for k in kinds for _ in range(30)] + [(text("aa"), None), (None, "aa"), ("", "bb")], "text string, lang string")
    model = language.fit(train, sample=20)
    rows = [(i, text(k)) for i, k in enumerate(["aa", "bb", "cc"] * 10)]
    got = {x.doc_id: x for x in language.identify(frame(spark, [*rows, (100, None), (101, "12 34"), (102, " ".join("".join(r.choice("съештвюгждлоа") for _ in range(6)) for _ in range(60)))]), model).collect()}
    assert all(got[i].lang_pred == ["aa", "bb", "cc"][i % 3] and not got[i].rejected for i in range(30))
    assert got[100].lang_pred == got[101].lang_pred == "und" and got[102].rejected
    empty = language.fit(train.limit(0))
    assert {x.lang_pred for x in language.identify(frame(spark, ODD), empty).collect()} == {"und"}


def test_language_sample_counts_distinct_texts(spark):
    r = random.Random(15)
    kinds = {"aa": "bakolumi", "bb": "strengphx", "cc": "ñéwyzqua"}
    def text(k):
        return " ".join("".join(r.choice(kinds[k]) for _ in range(r.randint(2, 8))) for _ in range(40))
    distinct = {"aa": [text("aa") for _ in range(6)], "bb": [text("bb") for _ in range(60)], "cc": [text("cc") for _ in range(300)]}
    few = spark.createDataFrame([(t, k) for k in kinds for t in distinct[k]], "text string, lang string")
    train = few.withColumn("n", F.expr("CASE lang WHEN 'aa' THEN 2000 WHEN 'bb' THEN 100 ELSE 1 END"))
    train = train.select("text", "lang", F.explode(F.sequence(F.lit(1), "n"))).select("text", "lang").repartition(4)
    got = collections.defaultdict(set)
    for x in language.sampled(train, 20).collect():
        got[x.lang].add(x.text)
    once = collections.defaultdict(set)
    for x in language.sampled(few, 20).collect():
        once[x.lang].add(x.text)
    assert got == once and {k: len(v) for k, v in got.items()} == {"aa": 6, "bb": 20, "cc": 20}
    model = language.fit(train, sample=20)
    assert model.langs == ["aa", "bb", "cc"]
    assert [model.predict([text(k)])[0] for k in kinds] == [["aa"], ["bb"], ["cc"]]


def toxic_case(spark):
    r = random.Random(6)
    plain = [f"w{i}" for i in range(300)]

    def text(bad):
        return " ".join(r.choice(["vile", "awfulness", "nasty"]) if bad and r.random() < 0.1 else r.choice(plain) for _ in range(60))

    rows = [(i, text(i % 4 == 0)) for i in range(400)]
    docs = frame(spark, rows + ODD)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    fold = F.col("doc_id") % 3
    return rows, docs, labels.where(fold != 1).select("doc_id", "toxic", (fold == 2).cast("int").alias("fold"))


def test_toxicity_finds_held_out_texts(spark):
    rows, docs, known = toxic_case(spark)
    scored = collections.defaultdict(list)
    for x in toxicity.score(docs, known).collect():
        scored[x.doc_id].append(x.score)
    held = [i for i in range(400) if i % 3 == 1]
    assert np.mean([(scored[i][0] >= 0.5) == (i % 4 == 0) for i in held]) > 0.95
    assert sum(map(len, scored.values())) == len(rows) + len(ODD)
    assert {x.score for x in toxicity.score(docs, known.limit(0)).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), known).count() == 0


def test_toxicity_equals_plain_counts(spark):
    """Counts, probabilities and both features, from dictionaries of texts."""
    rows, docs, known = toxic_case(spark)
    texts, taught = {}, docs.join(known, "doc_id").select("text", "toxic", "fold")
    for x in taught.collect():
        texts[x.text, x.toxic] = min(x.fold, texts.get((x.text, x.toxic), 9))
    where = collections.defaultdict(set)
    for t, c in texts:
        w = t.split()
        for u in {("w", x) for x in w} | {("b", *p) for p in zip([None] + w, w)} | {(n, x[:n]) for x in w for n in (7, 5) if len(x) > n}:
            where[u].add((t, c))
    n = {u: [len([1 for _, c in v if c == k]) for k in (0, 1)] for u, v in where.items()}
    kinds = {k: [v for u, v in n.items() if u[0] == k] for k in ("b", "w", 7, 5)}
    big = {k: [sum(x[c] for x in v) for c in (0, 1)] for k, v in kinds.items()}
    types = {k: [sum(x[c] > 0 for x in v) for c in (0, 1)] for k, v in kinds.items()}

    def ratio(u):
        if u not in n or max(n[u]) < 2:
            return None
        k = u[0]
        shared = (sum(n[u]) + 1) / (sum(big[k]) + len(kinds[k]))
        p = [(max(n[u][c] - 1, 0) + types[k][c] * shared) / big[k][c] for c in (0, 1)]
        return np.log(p[1] / p[0]) - np.log(types[k][1] / big[k][1]) + np.log(types[k][0] / big[k][0])

    def word(x):
        for u in [("w", x)] + [(m, x[:m]) for m in (7, 5) if len(x) > m]:
            if ratio(u) is not None:
                return ratio(u)
        return 0.0

    sample, share = toxicity.labelled_sample(docs, known)
    assert sample.count() == len(texts)
    assert share == pytest.approx({c: taught.where(f"toxic = {c}").count() / len([1 for _, k in texts if k == c]) for c in (0, 1)})
    model = toxicity.fit_model(toxicity.unit_counts(sample), (0, 1))
    got = {x.doc_id: (x.a, x.b) for x in toxicity.features(docs, model).collect()}
    for d, t in rows[::7]:
        r = []
        for v, x in zip([None] + t.split(), t.split()):
            both = ratio(("b", v, x))
            r.append(word(x) if both is None else both - (word(v) if v else 0.0))
        assert got[d] == pytest.approx((np.mean(r), np.sqrt(np.mean(np.clip(np.array(r) - toxicity.STRONG, 0, 1)))), abs=1e-5)
    few, share = toxicity.labelled_sample(docs, known, texts=20)
    assert few.count() == 40 and share[0] == pytest.approx(taught.where("toxic = 0").count() / 20)
    assert toxicity.labelled_sample(docs, known, chars=500)[0].groupBy("toxic").count().count() == 2


def brute_dedup(rows):
    first, split = {}, [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - 49 if d is not None else 0):
            k = tuple(w[i: i + 50])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - 49 if d is not None else 0):
            if first[tuple(w[i: i + 50])] < d:
                gone[i: i + 50] = [True] * 50
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_recompression_equals_brute_force(spark, seed):
    r = random.Random(seed)
    pool = [[f"w{r.randrange(v)}" for _ in range(n)] for v, n in [(5000, 400), (2, 300), (1, 500), (3, 200), (50, 51), (50, 50)]]
    pool += [["a", "b"] * 200, ["x"] * 48 + ["y", "z"], ["x"] * 100 + ["y", "z"] + ["q"] * 20, (["x"] * 7 + ["y"] * 3) * 20]
    rows = list(ODD)
    for d in range(120):
        t = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(pool)
            a = r.randrange(len(p))
            t += p[a: a + r.choice([20, 49, 50, 51, 120, 400])] if r.random() < 0.7 else [f"u{r.randrange(10 ** 6)}" for _ in range(r.randint(0, 80))]
        rows.append((d, r.choice([" ", "\n"]).join(t)))
    rows += [(7, rows[20][1]), (9, " ".join(pool[0]))]
    assert sorted([tuple(x) for x in recompression.dedup(frame(spark, rows)).collect()], key=str) == brute_dedup(rows)
    assert recompression.dedup(frame(spark, rows).limit(0)).count() == 0


def test_separator_scan(spark):
    r = random.Random(8)
    files = [(f"f{f}", [7 if r.random() < 0.2 else 1 for _ in range(r.choice([0, 1, 2, 10, 200]))]) for f in range(20)]
    frame_ = spark.createDataFrame([(a, bytearray(np.array(b, "<u2").tobytes())) for a, b in files], "file string, content binary")
    got = sorted((x.file, x.ordinal, x.start, x.n_tokens, x.ended) for x in separators.count_tokens(frame_, 7, block_bytes=8).collect())
    want = []
    for f, ids in files:
        start = n = 0
        for i, t in enumerate(ids):
            if t == 7:
                want.append((f, n, start, i - start, True))
                n, start = n + 1, i + 1
        if start < len(ids):
            want.append((f, n, start, len(ids) - start, False))
    assert got == sorted(want)
    b = ByteBpe(**bpe_files())
    counts = separators.document_counts(frame(spark, ODD), **bpe_files(), eod=50256, block_bytes=64).collect()
    assert sorted((str(x.doc_id), x.n_tokens) for x in counts) == sorted((str(d), len(b.encode(t or ""))) for d, t in ODD)


def test_separator_inside_a_text(spark):
    b = ByteBpe(**bpe_files())
    end = "<|endoftext|>"
    rows = [(1, "first"), (2, f"one {end} two{end}"), (3, "third text here"), (4, end), (5, f"{end}" + " " * 5000 + f"x {end}"), (6, "last of the file")]
    got = {x.doc_id: x for x in separators.document_counts(spark.createDataFrame(rows, DOC).coalesce(1), **bpe_files(), eod=50256, block_bytes=64).collect()}
    assert len({x.file for x in got.values()}) == 1
    start = 0
    for d, t in rows:
        n = len(b.plain.encode(t, add_special_tokens=False).ids)
        assert b.encode_ordinary(t).tolist() == b.plain.encode(t, add_special_tokens=False).ids
        assert (got[d].start, got[d].n_tokens) == (start, n)
        start += n + 1
    with pytest.raises(Exception, match="id of ordinary text"):
        separators.document_counts(spark.createDataFrame([(1, "a!")], DOC), **bpe_files(), eod=0)


def test_signatures_do_not_depend_on_the_slice():
    r = random.Random(25)
    lists = [[b"w%d" % r.randrange(5000 if i % 3 else 8) for _ in range(r.choice([1, 4, 15, 20, 30, 200]))] for i in range(2000)]
    def signed(some):
        words = bagminhash.flat(bagminhash.WordHashes(), some)
        return bagminhash.signatures(*bagminhash.multisets(*bagminhash.shingles(*words, 5)), len(some), 160)
    together = signed(lists)
    assert all((signed([lists[i]])[0] == together[i]).all() for i in range(60))
    assert all((signed(lists[i: i + 7]) == together[i: i + 7]).all() for i in range(0, 1000, 100))


def test_bagminhash_unbiased_and_classes(spark):
    r = random.Random(5)
    gaps = []
    for _ in range(30):
        a = [r.randrange(60) for _ in range(r.randint(1, 300))]
        b = [x for x in a if r.random() < 0.8] + [r.randrange(60) for _ in range(20)]
        h = np.array(a + b, np.uint64)
        own, item, count = bagminhash.multisets(h, np.r_[np.zeros(len(a), np.int64), np.ones(len(b), np.int64)])
        s = bagminhash.signatures(own, bagminhash.mix(item + np.uint64(9)), count, 2, 400)
        x, y = collections.Counter(a), collections.Counter(b)
        gaps.append((s[0] == s[1]).mean() - sum((x & y).values()) / sum((x | y).values()))
    assert abs(np.mean(gaps)) < 0.015 and np.std(gaps) < 0.04
    rows, n = list(ODD), 10
    for _ in range(30):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([1, 5, 40, 120]))]
        for _ in range(r.choice([1, 2, 8])):
            t = list(base)
            for _ in range(int(r.choice([0, 0.01, 0.03]) * len(t) + 0.5)):
                t[r.randrange(len(t))] = f"e{r.randrange(10 ** 6)}"
            rows.append((n, " ".join(t)))
            n += 1
    bags = [None if not (t or "").split() else collections.Counter(tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))) for _, t in rows for w in [(t or "").split()]]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values()):
                group = [group[j] if g == group[i] else g for g in group]
    want = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        want.append((d, d if bags[i] is None else min(ids, default=None)))
    got = [(x.doc_id, x.class_id) for x in bagminhash.classes(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("signs", [([7] * 6, [7] * 6), ([1, 2, 3, 4, 5, 6], [9, 9, 9, 4, 9, 9])])
def test_second_pass_checks_every_pair_of_a_band(spark, signs):
    """Two similar texts meet in their second band only, be it that bytes of their first band's registers collide or that few registers agree."""
    import xxhash
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-2])), (3, " ".join(words[:30]))]
    nodes = [xxhash.xxh3_128_digest(t.encode()) for _, t in rows]
    los = [int.from_bytes(n[8:], "big", signed=True) for n in nodes]
    keys = [[1, 10], [2, 10], [3, 10]]
    sig = [bytes(signs[0]), bytes(signs[1]), bytes(range(20, 26))]
    reps = spark.createDataFrame([(d, n, lo, k, s) for (d, _), n, lo, k, s in zip(rows, nodes, los, keys, sig)],
                                 "doc_id long, node binary, lo long, bands array<long>, sig binary")
    shared = spark.createDataFrame([(10, 1, lo) for lo in los], "band long, pos int, lo long")
    roots = reps.select("node", F.col("node").alias("root"))
    got = bagminhash._second_links(frame(spark, rows), shared, reps, roots, 2, 3, 0.8).collect()
    assert {frozenset((bytes(x.src), bytes(x.dst))) for x in got} == {frozenset(nodes[:2])}


def test_block_links_equal_brute_force(monkeypatch):
    r = random.Random(35)
    monkeypatch.setattr(bagminhash, "BLOCK_SHINGLES", 700)
    bags, nodes = {}, []
    for i in range(90):
        base = random.Random(i // 6).sample(range(400), 40) if i < 60 else r.sample(range(400), r.randint(1, 60))
        c = collections.Counter(base + [base[0]] * r.randint(0, 3) + [r.randrange(400) for _ in range(r.randint(0, 5))])
        item = np.array(sorted(c), np.uint64)
        bags[i] = (item, np.array([c[int(x)] for x in item]))
        nodes.append({"node": i, "r": i // 2, "bands": [r.randrange(3), r.randrange(3), 5]})
    got = bagminhash.block_links(2, nodes, nodes[30:], lambda v: bags[v["node"]], 0.8)
    def joined(links):
        group = {v["node"]: v["r"] for v in nodes}
        for a, b in links:
            group = {k: group[a] if g == group[b] else g for k, g in group.items()}
        return {frozenset(k for k in group if group[k] == g) for g in group.values()}
    want = [(x["node"], y["node"]) for x in nodes for y in nodes[30:] if x["r"] != y["r"] and all(a != b for a, b in zip(x["bands"][:2], y["bands"]))
            and bagminhash.similarity(bags[x["node"]], bags[y["node"]]) >= 0.8]
    assert want and set(got) <= set(want) and joined(got) == joined(want) and len(joined(want)) < 45


def test_nearest_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 32))
    x[100:400] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 32), (2002, [float("nan")] * 32), (2003, [1.0])]
    got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 20 == 0).collect()
    by = collections.defaultdict(list)
    for g in got:
        by[g.query_id].append((g["rank"], g.vec_id, g.score))
    hit = 0
    for q in range(0, 1500, 20):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s))[:20]
        found = sorted(by[q])
        assert [f[0] for f in found] == list(range(1, 21)) and all(f[2] == s[f[1]] for f in found)
        hit += len({f[1] for f in found} & set(best.tolist()))
    assert hit / (75 * 20) >= 0.9


def test_nearest_repeated_query_rows(spark):
    x = np.random.default_rng(8).normal(size=(300, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (20, x[5].tolist()), (7, x[7].tolist())]
    got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, probes=99).collect()
    by = collections.defaultdict(list)
    for g in got:
        by[g.query_id].append((g["rank"], g.vec_id, g.score))
    ids, all_ = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for q, vectors in ((0, [x[0]]), (20, [x[20], x[5]]), (40, [x[40]])):
        want = []
        for v in vectors:
            s = (all_ * v).sum(1)
            s[ids == q] = -np.inf
            want += [(r + 1, int(ids[j]), s[j]) for r, j in enumerate(np.lexsort((ids, -s))[:20])]
        assert sorted(by[q]) == sorted(want)
    assert nearest.search(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_index_of_many_copies(spark):
    few = np.random.default_rng(4).normal(size=(5, 8))
    rows = spark.range(20000).select(F.col("id").alias("vec_id"), F.element_at(F.array(*[F.array(*map(F.lit, v.tolist())) for v in few]), (F.col("id") % 5 + 1).cast("int")).alias("v"), F.col("id").alias("row"))
    assert len(nearest.Index.fit(rows, lists=8, sample=20).centres) == 5
    assert len(nearest.Index.fit(rows.where("vec_id % 5 = 0"), lists=8, sample=1).centres) == 1
