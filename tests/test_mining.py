import numpy as np
import pytest
from pyspark.sql import functions as F

from vecmine.functions import distances as D
from vecmine.operators import classify as K
from vecmine.operators import clustering as C
from vecmine.operators import features as E
from vecmine.operators import graph as G
from vecmine.operators import indices as I
from vecmine.operators import neighbours as N
from vecmine.operators.centroids import Representatives, assign_nearest


def euclid(X, Y=None):
    Y = X if Y is None else Y
    return np.sqrt(((X[:, None, :] - Y[None, :, :]) ** 2).sum(axis=2))


def clusters(df):
    return {r["id"]: r["prediction"] for r in df.select("id", "prediction").collect()}


@pytest.mark.parametrize("name", [n for n, m in D.MEASURES.items() if m.block is not None])
def test_block_and_column_forms_agree(make, name):
    rng = np.random.default_rng(4)
    for d in (5, 20):
        X = rng.normal(size=(12, d)) + 0.5
        if name == "nan_euclidean":
            X[3, 2] = np.nan
        block = D.block_distance(name, X, X)
        points = make(X)
        pairs = points.select(F.col("id"), F.col("features").alias("x")).join(
            points.select((F.col("id") - 1).alias("id"), F.col("features").alias("y")), "id")
        for r in pairs.select("id", D.MEASURES[name].column(F.col("x"), F.col("y")).alias("v")).collect():
            assert abs(r["v"] - block[r["id"], r["id"] + 1]) < 1e-9


def test_angles_and_consistency(spark):
    df = spark.sql("select array(1D, -1D, 0D) as x, array(1D, 1D, 0D) as y, array(1D, 2D, 3D) as p, array(2D, 2.5D, 9D) as q")
    row = df.select(D.angular(F.col("x"), F.col("y")).alias("a"), D.consistency_index(F.col("p"), F.col("q"), 10).alias("c")).first()
    assert abs(row["a"] - np.pi / 2) < 1e-12  # the short way round
    assert abs(row["c"] - (1 * 10 - 9) / (3 * 7)) < 1e-12


def test_copies_have_distance_zero():
    X = np.random.default_rng(0).normal(size=(4, 40)) * 1e3
    assert (np.diag(D.block_distance("euclidean", X, X.copy())) == 0).all()


def test_indices_match_brute_force(make, blobs):
    X, code = blobs
    points, M = make(X, code), euclid(X)
    i, j = np.triu_indices(len(X), 1)
    d, same, low = M[i, j], code[i] == code[j], np.minimum(code[i], code[j])
    w, b = d[same], d[~same]
    nd = len(d)
    top = np.array([d[same & (low == c)].max() for c in range(3)])
    lim = top[low[~same]]
    want = {
        "sse": sum((M[np.ix_(code == c, code == c)] ** 2).sum() / (code == c).sum() for c in range(3)),
        "minmaxcut": sum(M[code == c].sum() / M[np.ix_(code == c, code == c)].sum() for c in range(3)),
        "c_index": (w.sum() - w.min()) / (w.max() - w.min()),
        "gamma": ((b > w.max()).sum() - (b < w.max()).sum()) / ((b > w.max()).sum() + (b < w.max()).sum()),
        "gplus": 2 * (b < w.max()).sum() / (nd * (nd - 1)),
        "tau": ((b > lim).sum() - (b < lim).sum()) / np.sqrt((nd * (nd - 1) / 2 - (len(w) + 2 * len(b))) * (nd * (nd - 1) / 2)),
        "wb": w.mean() / b.mean(),
        "point_biserial": (b.mean() - w.mean()) * np.sqrt(len(w) * len(b) / nd ** 2)
                          / np.sqrt((((w - w.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()) / nd),
    }
    for name, value in want.items():
        assert abs(I.INDICES[name](points).first()[0] - value) < 1e-9, name


def test_neighbours(make, blobs):
    X, _ = blobs
    M = euclid(X)
    np.fill_diagonal(M, np.inf)
    got = {}
    for r in N.knn_join(make(X), 4).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["neighbour"]
    for i in range(len(X)):
        order = sorted(range(len(X)), key=lambda j: (M[i, j], j))[:4]
        assert [got[i][k] for k in range(1, 5)] == order
    apart = N.knn_join(make(X), 1, exclude_equal=True).where("score = 0").count()
    assert apart == 0
    pairs = {(r["id"], r["other"]) for r in N.range_join(make(X), 1.5).collect()}
    assert pairs == {(i, j) for i in range(len(X)) for j in range(i + 1, len(X)) if M[i, j] < 1.5}


def dbscan(M, eps, least):
    near = M < eps
    core = near.sum(axis=1) >= least
    label = {}
    for i in np.nonzero(core)[0]:
        if i in label:
            continue
        stack = [i]
        while stack:
            x = stack.pop()
            if x in label:
                continue
            label[x] = i
            stack += [y for y in np.nonzero(near[x] & core)[0] if y not in label]
    for i in np.nonzero(~core)[0]:
        hit = [label[j] for j in np.nonzero(near[i] & core)[0]]
        if hit:
            label[i] = min(hit)
    return label


@pytest.mark.parametrize("eps,least", [(1.2, 4), (1.8, 6), (0.01, 3)])
def test_dbscan_matches_flood_fill(make, blobs, eps, least):
    X, code = blobs
    got = clusters(C.dbscan(make(X, code), eps, least, normalize=False))
    assert got == dbscan(euclid(X), eps, least)


def test_connected_components_on_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, j) for j in range(101, 140)] + [(200, 201)]
    nodes = sorted({x for e in edges for x in e} | {500})
    e = spark.createDataFrame(edges, "src long, dst long")
    n = spark.createDataFrame([(x,) for x in nodes], "id long")
    got = {r["id"]: r["component"] for r in G.connected_components(e, n).collect()}
    assert got == {x: 0 if x <= 30 else 100 if x < 200 else 200 if x < 500 else 500 for x in nodes}


def test_markov_clustering_separates_cliques(spark):
    edges = [(a, b, 1.0) for g in (0, 10) for a in range(g, g + 4) for b in range(a + 1, g + 4)] + [(3, 10, 0.05)]
    nodes = spark.createDataFrame([(i,) for i in [*range(4), *range(10, 14)]], "id long")
    m = G.transition_matrix(spark.createDataFrame(edges, "src long, dst long, w double"), nodes)
    got = clusters(G.mcl(m))
    assert len({got[i] for i in range(4)}) == 1 and len({got[i] for i in range(10, 14)}) == 1 and got[0] != got[10]


def test_markov_clusters_of_an_unkept_matrix(spark, make, monkeypatch):
    """Clusters are the same whether the first matrix is kept or made again from the points by every pass."""
    rng = np.random.default_rng(6)
    points = make(np.repeat(np.eye(4), 3, axis=0) + 0.15 * rng.random((12, 4)))
    want = clusters(G.mcl(G.transition_matrix(C.similarity_edges(points, 0.5), points), most_steps=1))
    monkeypatch.setattr(G, "KEPT_ENTRIES", 0)
    monkeypatch.setattr(G, "FEW_TERMS", 0)
    got = clusters(G.mcl(G.transition_matrix(C.similarity_edges(points, 0.5), points, once=True), most_steps=1))
    assert got == want and len(set(got.values())) == 4


def test_kmeans_finds_separated_groups(make, spark):
    rng = np.random.default_rng(2)
    X = np.r_[rng.normal(size=(40, 2)), rng.normal(size=(40, 2)) + 50]
    points = make(X)
    for limit in (None, "1"):
        if limit:
            spark.conf.set("spark.vecmine.broadcastBytes", limit)
        try:
            got = clusters(C.kmeans(points, 2, 20))
        finally:
            spark.conf.unset("spark.vecmine.broadcastBytes")
        assert len(got) == 80 and len({got[i] for i in range(40)}) == 1 and got[0] != got[79]
    key, best, scores = C.kmeans_select_k(points, 2, 2, repeats=2, iterations=5)
    assert best.count() == 80 and len(scores) == 2
    assert len(set(clusters(C.kmedoids(points, 2, 10)).values())) == 2
    assert len(set(clusters(C.som(points, epochs=5)).values())) >= 1


def test_farthest_first_traversal(make, blobs):
    X, _ = blobs
    M = euclid(X)
    chosen = [5]
    while len(chosen) < 4:
        gap = M[:, chosen].min(axis=1)
        chosen.append(int(np.nonzero(gap == gap.max())[0][0]))
    assert [i for i, _ in C.farthest_first_centres(make(X), 4, first=5)] == chosen


def test_assignment_without_broadcast(make, blobs, spark):
    X, code = blobs
    points = make(X, code)
    centres = C._frame(spark, X[[0, 40, 80]])
    local = clusters(assign_nearest(points, Representatives(centres, 5)))
    spark.conf.set("spark.vecmine.broadcastBytes", "1")
    try:
        tiled = clusters(assign_nearest(points, Representatives(centres, 5)))
    finally:
        spark.conf.unset("spark.vecmine.broadcastBytes")
    assert local == tiled == dict(enumerate(euclid(X, X[[0, 40, 80]]).argmin(axis=1)))


def test_mean_classifiers_without_broadcast(make, blobs, spark):
    X, code = blobs
    points = make(X, code)
    def run():
        a = {r["id"]: r["predicted"] for r in K.nearest_mean(points, points).collect()}
        b = {r["id"]: (r["predicted"], r["share"]) for r in K.feature_voting(points, points).collect()}
        return a, b
    local = run()
    spark.conf.set("spark.vecmine.broadcastBytes", "1")
    try:
        assert run() == local
    finally:
        spark.conf.unset("spark.vecmine.broadcastBytes")


def test_cross_validation_equals_fold_by_fold(make, blobs):
    X, code = blobs
    points = make(X, code)
    fast = {r["label"]: tuple(r)[1:] for r in K.cross_validate_nearest_mean(points, 4).collect()}
    slow = {r["label"]: tuple(r)[1:] for r in K.cross_validate(points, K.nearest_mean, 4).collect()}
    assert fast == slow and sum(v[0] for v in fast.values()) > 80


def test_naive_bayes_by_hand(make):
    train = make([[0.0], [0.0], [1.0]], labels=["a", "a", "b"])
    test = make([[0.0], [7.0]])
    got = {(r["id"], r["label"]): r["probability"] for r in K.naive_bayes(train, test).collect()}
    a, b = 2 / 3 * 3 / 4, 1 / 3 * 1 / 3  # seen value: two distinct values
    assert abs(got[0, "a"] - a / (a + b)) < 1e-12
    a, b = 2 / 3 * 1 / 5, 1 / 3 * 1 / 4  # unseen value: one distinct value more
    assert abs(got[1, "b"] - b / (a + b)) < 1e-12


def test_dependence_parents(make):
    rng = np.random.default_rng(6)
    a = rng.integers(0, 3, 400)
    X = np.c_[a, (a + (rng.random(400) < 0.1)) % 3, rng.integers(0, 3, 400)]
    points = make(X, labels=[str(int(v > 0)) for v in a])
    assert K.dependence_parents(points, 1)[1] == [0]
    scores = K.dependent_bayes(points, points, 1)
    right = K.most_probable(scores, points, "score").where("predicted = label").count()
    assert right > 360


def test_measures_with_undefined_ratios(spark):
    counts = spark.createDataFrame([("a", 0, 0, 5, 5), ("b", 4, 1, 4, 1)], "label string, tp long, fp long, tn long, fn long")
    rows = {r["label"]: r for r in K.measures(counts).collect()}
    assert rows["a"]["precision"] is None and rows["a"]["f_measure"] == 0
    assert abs(rows["b"]["f_measure"] - 0.8) < 1e-12 and abs(rows["b"]["correlation_coefficient"] - 0.6) < 1e-12


def test_feature_rankings_find_the_informative_attribute(make):
    rng = np.random.default_rng(9)
    labels = rng.integers(0, 2, 200)
    X = np.c_[rng.normal(size=200), labels * 4 + rng.normal(size=200), rng.normal(size=200)]
    points = make(X, labels=[str(v) for v in labels])
    for score in (E.gain_ratio, E.symmetrical_uncertainty, E.kl_divergence, E.relief, E.forest_permutation):
        assert E.rank_scores(score(points)).where("rank = 0").first()["attr"] == 1, score.__name__
    assert [r["attr"] for r in E.select_forward(points, 1).collect()] == [1]
    assert E.rank_svm_rfe(points).where("rank = 0").first()["attr"] == 1
    assert E.rank_ensemble(points).where("rank = 0").first()["attr"] == 1
