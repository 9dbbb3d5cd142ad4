"""Steps that must not grow with the input: what the driver holds, what a task reads, what numbers hold."""

import io
from contextlib import redirect_stdout

import numpy as np
from pyspark.sql import functions as F

from vecmine.operators import classify as K
from vecmine.operators import clustering as C
from vecmine.operators import graph as G
from vecmine.operators import indices as I
from vecmine.operators import silhouette as S
from vecmine.operators.pairs import Block, _Codes, _NearestManhattan, chunks, nearest, pack, plan_tiles
from vecmine.operators.sampling import bootstrap


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_bootstrap_never_ships_draws(make):
    points = make([[float(i)] for i in range(40)]).drop("prediction")
    bag, oob = bootstrap(points, bags=70)
    for df in (bag, oob):
        # What is generated from a broadcast side's counts stays distributed.
        plan = plan_of(df)
        assert not any("BuildLeft" in x or "BuildRight" in x and "pos" in x for x in plan.splitlines() if "BroadcastHashJoin" in x)
    drawn = {(r["bag"], r["id"]) for r in bag.collect()}
    rest = [(r["bag"], r["id"]) for r in oob.collect()]
    assert len(rest) == len(set(rest)) and set(rest) == {(b, i) for b in range(70) for i in range(40)} - drawn


def test_point_biserial_of_many_pairs(spark, make, monkeypatch):
    """Products of pair counts do not fit 64 bits from some hundred thousand points on."""
    row = (5_000_000_000, 9e9, 2e10, 50_000_000_000, 1.5e11, 5e11)
    stats = spark.createDataFrame([row], "fw long, dw double, dw2 double, fb long, db double, db2 double")
    monkeypatch.setattr(I, "pair_statistics", lambda points, metric: stats)
    score = I.point_biserial(make([[0.0]])).first()["score"]
    fw, dw, dw2, fb, db, db2 = map(float, row)
    nd = fw + fb
    spread = dw2 - dw * dw / fw + db2 - db * db / fb
    assert abs(score - (db / fb - dw / fw) * (fw * fb) ** 0.5 / nd / (spread / nd) ** 0.5) < 1e-12


def test_distance_buffers_stay_small():
    """A kernel holds a dozen buffers and an executor runs several: 4 MB each, however large the blocks."""
    def block(n):
        b = Block.__new__(Block)
        b.ids, b.X, b.cols, b.key = np.arange(n), np.random.default_rng(1).random((n, 2)), {}, 0
        return b

    seen = 0
    for part, dist in chunks(block(1000), block(4096), "euclidean"):
        assert dist.nbytes <= 1 << 22 and dist.shape == (part.stop - part.start, 4096)
        seen += len(dist)
    assert seen == 1000


def test_markov_step_meets_only_entries_that_can_count(spark):
    """A hub's many light entries cannot reach the limit, so they are left out of the product; what is left is exact."""
    rng = np.random.default_rng(3)
    M = np.zeros((90, 90))
    M[:60, :60] = 1.0  # light: 1/60 each
    M[60:, 60:] = np.kron(np.eye(10), rng.random((3, 3)) + 0.2)
    M[10, 70] = M[80, 5] = 30.0  # heavy entries of the light rows and columns
    M /= M.sum(axis=1, keepdims=True)
    i, j = np.nonzero(M)
    m = spark.createDataFrame([(int(a), int(b), float(M[a, b])) for a, b in zip(i, j)], "src long, dst long, w double")
    want = (M @ M) ** 2
    want[want < 0.001] = 0
    want = want / np.maximum(want.sum(axis=1, keepdims=True), 1e-300)
    got = np.zeros_like(M)
    for r in G.expand_inflate(m).collect():
        got[r["src"], r["dst"]] = r["w"]
    assert np.allclose(got, want)
    left, right = G._within_reach(m, 0.001 ** 0.5)
    met = left.select("src", "dst").join(right.select(right.src.alias("dst"), right.dst.alias("to")), "dst").count()
    assert met < 20_000 < 60 ** 3


def test_transition_matrix_is_read_from_its_edges(spark, make, monkeypatch):
    """A large matrix is neither written nor dealt by its entries: they are made again from the points, and only sums by node move."""
    monkeypatch.setattr(G, "KEPT_ENTRIES", 0)
    monkeypatch.setattr(G, "FEW_TERMS", 0)
    rng = np.random.default_rng(8)
    # A group of many light entries, small groups of heavy ones, a lone point.
    X = np.r_[np.eye(12)[:1] + 0.1 * rng.random((60, 12)), np.repeat(np.eye(12)[1:9], 3, axis=0) + 0.1 * rng.random((24, 12)), np.eye(12)[11:]]
    points = make(X)
    edges = C.similarity_edges(points, 0.4)
    small = G.transition_matrix(edges, points)
    m = G.transition_matrix(edges, points, once=True)
    plan = plan_of(m)
    assert "ExistingRDD" in plan and "HashAggregate" not in plan and "hashpartitioning(src" not in plan
    as_dict = lambda df: {(r["src"], r["dst"]): r["w"] for r in df.collect()}
    want, got = as_dict(small), as_dict(m)
    assert m.count() == len(got) == len(want) and all(abs(got[e] - w) < 1e-12 for e, w in want.items())
    M = np.zeros((85, 85))
    for (a, b), w in want.items():
        M[a, b] = w
    square = (M @ M) ** 2
    square[square < 0.001] = 0
    square /= np.maximum(square.sum(axis=1, keepdims=True), 1e-300)
    step = as_dict(G.expand_inflate(m))
    assert {(a, b) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(square)))} == set(step)
    assert all(abs(square[e] - w) < 1e-12 for e, w in step.items()) and not any(a < 60 for a, _ in step)
    left, right = G._within_reach(m, 0.001 ** 0.5)
    assert 0 < left.count() < 120 and 0 < right.count() < 120


def test_repeated_nodes_share_their_entries(spark, make, monkeypatch):
    """Ids that come twice give one entry per pair of ids, whichever way the matrix is made."""
    points = make(np.random.default_rng(4).random((12, 3))).withColumn("id", F.least("id", F.lit(9)))
    edges = C.similarity_edges(points, 0.7)
    want = {(r["src"], r["dst"]): r["w"] for r in G.transition_matrix(edges, points).collect()}
    for kept in (0, 10_000):
        monkeypatch.setattr(G, "KEPT_ENTRIES", kept)
        rows = G.transition_matrix(edges, points, once=True).collect()
        assert len(rows) == len(want) and all(abs(want[r["src"], r["dst"]] - r["w"]) < 1e-12 for r in rows)


def test_copies_of_blocks_do_not_grow_with_shuffle_partitions(spark, make):
    """Vectors read as floats travel as floats, and large sides get the stripes that the cores need."""
    many = plan_tiles(spark, 64, 307_692)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2000")
    try:
        more, both = plan_tiles(spark, 64, 307_692), plan_tiles(spark, 64, 307_692, 307_692)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert many.left_stripes <= more.left_stripes <= 16 and both.left_stripes <= 16 and both.right_stripes <= 16
    X = np.random.default_rng(2).random((50, 64))
    for data, cell in ((X.astype(np.float32).astype(float), 4), (X, 8)):
        blocks = pack(make(data).repartition(1), 64).collect()
        got = Block(bytes(blocks[0]["payload"]), 0)
        assert got.X.dtype == np.float64 and {tuple(x) for x in got.X} == {tuple(x) for x in data}
        assert len(blocks[0]["payload"]) < 50 * (64 * cell + 40) + 2000


def test_manhattan_neighbours_are_settled_by_codes(spark, make):
    """Each pair of blocks is met once, few pairs are summed in full, and the neighbours are the exact ones, ties by id."""
    rng = np.random.default_rng(9)
    X, cls = rng.normal(size=(160, 6)), rng.integers(0, 3, 160)
    X[20:30], X[150] = X[20], X[5]
    cls[159] = 7  # alone in its class
    points = make(X, cls).select("id", "features", F.col("prediction").alias("cls"))
    D = np.zeros((160, 160))
    for a in range(6):
        D += np.abs(X[:, a, None] - X[None, :, a])
    np.fill_diagonal(D, np.nan)
    want = set()
    for i in range(160):
        for hit in (True, False):
            may = [j for j in range(160) if j != i and (cls[j] == cls[i]) == hit]
            want |= {(i, j, D[i, j], r, hit) for r, j in enumerate(sorted(may, key=lambda j: (D[i, j], j))[:2], 1)}
    got = nearest(points.repartition(5), points, 2, "manhattan", same=True, by_label=True)
    assert {(r.id, r.neighbour, r.score, r["rank"], r.hit) for r in got.collect()} == want  # two sets: not coded
    both = points.repartition(5)
    got = nearest(both, both, 2, "manhattan", same=True, by_label=True)
    assert {(r.id, r.neighbour, r.score, r["rank"], r.hit) for r in got.collect()} == want

    def block(at, key):
        b = Block.__new__(Block)
        b.ids, b.X, b.cols, b.key = at, Y[at], {"cls": at % 4}, key
        return b

    Y = rng.random((1200, 64))
    work = _NearestManhattan(2, True, None, None)
    summed = []
    work._offer = lambda A, i, B, j, offer=work._offer: (summed.append(len(i)), offer(A, i, B, j))
    for key in range(2):
        for other in range(key, 2):
            assert not list(work(block(np.arange(600) + 600 * key, key), block(np.arange(600) + 600 * other, other)))
    assert sum(summed) < 0.2 * 1200 * 1200
    codes = _Codes(Y[:600], Y[600:])
    real = np.abs(Y[:50, None] - Y[None, 600:]).sum(axis=2)
    lost = codes.x_lost[:50, None] + codes.y_lost[None]
    assert (np.abs(codes.sums(slice(0, 50)) * codes.step - real) <= lost + 1e-9).all() and lost.max() < 0.1


def test_manhattan_neighbours_without_codes(make):
    """Blocks with cells that are no numbers are met as before."""
    rng = np.random.default_rng(3)
    X = rng.random((40, 3))
    X[7, 1], X[8, 0] = np.nan, np.inf
    points = make(X)
    with np.errstate(invalid="ignore"):
        D = np.abs(X[:, None] - X[None]).sum(axis=2)
    D[np.arange(40), np.arange(40)] = np.nan
    got = {(r.id, r.neighbour) for r in nearest(points, points, 1, "manhattan", same=True).collect()}
    assert got == {(i, int(np.nanargmin(D[i]))) for i in range(40) if not np.isnan(D[i]).all()}


def test_compared_methods_release_their_copies(make, blobs, monkeypatch):
    """Scores that copy points to pairs of blocks are settled one clustering at a time, and their files are let go."""
    X, code = blobs
    points = make(X, code)
    events = []
    monkeypatch.setattr(S, "release_unused", lambda spark: events.append("released"))
    scores = S.frahling_sohler_scores
    monkeypatch.setattr(S, "frahling_sohler_scores", lambda *a: (events.append("pairs"), scores(*a))[1])
    configs = {0: points, 1: points.withColumn("prediction", (F.col("prediction") / 2).cast("bigint"))}
    got = {(r.conf, r.method): r.score for r in S.method_comparison(configs, 8, 2).collect()}
    assert events == ["released", "pairs", "released", "pairs", "released"] and len(got) == 10
    for conf, p in configs.items():
        assert abs(got[conf, "exact"] - S.summarize(S.exact_scores(p)).first().silh) < 1e-9
        assert abs(got[conf, "frahling_sohler"] - S.summarize(scores(p)).first().silh) < 1e-9


def test_bayes_cells_are_not_dealt_by_value(spark, make):
    """Attributes and their values are few: a join dealt by them sends most cells to a few tasks."""
    points = make([[i % 3, i % 2, i % 5] for i in range(60)], labels=["ab"[i % 7 % 2] for i in range(60)]).drop("prediction")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for scores in (K.naive_bayes(points, points), K.dependent_bayes(points, points)):
            assert "SortMergeJoin" not in plan_of(scores) and "ShuffledHashJoin" not in plan_of(scores)
            assert scores.count() == 120
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_kept_points_are_packed(make):
    """A pass of k-means or a map over kept points reads a few binary rows, not every cell."""
    rng = np.random.default_rng(5)
    X, centres = rng.random((300, 3)), rng.random((4, 3))
    packed = C._packed(make(X).repartition(3))
    assert packed.count() <= 3
    n, s = C.cluster_sums(packed, centres, "euclidean")
    own = ((X[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
    assert n.tolist() == np.bincount(own, minlength=4).tolist()
    assert np.allclose(s, [X[own == c].sum(axis=0) for c in range(4)])
