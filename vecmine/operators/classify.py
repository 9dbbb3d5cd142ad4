"""Classifiers and their evaluation. Every classifier fits on (id, features, label) and adds `predicted`."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distances import block_distance, measure
from ..session import collect_bounded, settle_small
from ..sources.points import class_index, long_form
from .centroids import dims_of
from .clustering import som_assign, som_fit
from .pairs import matrix, nearest
from .sampling import bootstrap, kfold_split


def class_counts(points: DataFrame) -> DataFrame:
    """(label, n); the largest one is the majority prediction, ties to the smallest label."""
    return points.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def zero_r(train: DataFrame, test: DataFrame) -> DataFrame:
    top = class_counts(train).agg(F.min_by("label", F.struct(-F.col("n"), F.col("label")))).scalar()
    return test.withColumn("predicted", top)


def class_means(points: DataFrame, *by: str) -> DataFrame:
    """(*by, label, n, centroid)."""
    vec = array_to_vector("features")
    g = points.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(vec).alias("m"))
    return g.select(*by, "label", "n", vector_to_array("m").alias("centroid"))


def _shipped_means(means: DataFrame, dims: int, group: str | None = None):
    """{group: (labels, matrix)} broadcast to the tasks, or None beyond the limit."""
    rows = collect_bounded(means, 8 * dims + 64)
    if rows is None:
        return None
    out: dict = {}
    for r in sorted(rows, key=lambda r: r["label"]):
        out.setdefault(r[group] if group else None, []).append((r["label"], r["centroid"]))
    packed = {g: ([x for x, _ in v], np.array([c for _, c in v], dtype=np.float64)) for g, v in out.items()}
    return means.sparkSession.sparkContext.broadcast(packed)


def nearest_mean(train: DataFrame, test: DataFrame, metric: str = "euclidean") -> DataFrame:
    return nearest_mean_by_group(class_means(train), test, None, dims_of(train), metric)


def nearest_mean_by_group(means: DataFrame, test: DataFrame, group: str | None, dims: int,
                          metric: str = "euclidean") -> DataFrame:
    """Label of the closest class mean, means and points matched on the integer column `group` if given."""
    m = measure(metric)
    ship = _shipped_means(means, dims, group)
    if ship is None:
        # Beyond the limit: meet on the group (or on the label set) with an ordinary join, one running minimum per point.
        keyed = means if group else means.withColumn("_g", F.lit(0))
        points = test if group else test.withColumn("_g", F.lit(0))
        key = group or "_g"
        met = points.join(keyed.select(key, F.col("label").alias("_l"), "centroid"), key)
        gap = m.badness(m.column(F.col("features"), F.col("centroid")))
        keys = ["id"] + ([group] if group else [])
        best = met.groupBy(*keys).agg(F.min_by("_l", F.struct(gap.alias("g"), F.col("_l"))).alias("predicted"))
        return test.join(best, keys)

    @F.arrow_udf("string")
    def closest(v: pa.Array, g: pa.Array) -> pa.Array:
        X, groups = matrix(v), np.asarray(g)
        out = np.empty(len(X), dtype=object)
        for key in np.unique(groups):
            at = groups == key
            labels, M = ship.value[None if group is None else int(key)]
            bad = m.badness_np(block_distance(metric, X[at], M))
            out[at] = np.array(labels, dtype=object)[bad.argmin(axis=1)]
        return pa.array(out.tolist(), pa.string())

    tag = F.col(group) if group else F.lit(0)
    return test.withColumn("predicted", closest("features", tag.cast("int")))


def knn_classify(train: DataFrame, test: DataFrame, k: int = 5, metric: str = "euclidean", same: bool = False) -> DataFrame:
    """(id, label, votes): votes of the k nearest training points, rescaled to [0, 1] over all classes."""
    near = nearest(test, train, k, metric, same=same).select("id", "neighbour")
    votes = near.join(train.select(F.col("id").alias("neighbour"), "label"), "neighbour").groupBy("id", "label").agg(
        F.count(F.lit(1)).cast("double").alias("votes"))
    classes = class_counts(train).agg(F.count(F.lit(1))).scalar()
    per = votes.groupBy("id").agg(F.max("votes").alias("hi"), F.min("votes").alias("lo"), F.count(F.lit(1)).alias("seen"),
                                  F.collect_list(F.struct("label", "votes")).alias("v"))  # at most k entries
    lo = F.when(F.col("seen") < classes, F.lit(0.0)).otherwise(F.col("lo"))
    flat = per.select("id", "hi", lo.alias("lo"), F.explode("v").alias("e"))
    scaled = F.when(F.col("hi") != F.col("lo"), (F.col("e.votes") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.col("e.votes"))
    return flat.select("id", F.col("e.label").alias("label"), scaled.alias("votes"))


def knn_predict(train: DataFrame, test: DataFrame, k: int = 5, metric: str = "euclidean", same: bool = False) -> DataFrame:
    votes = knn_classify(train, test, k, metric, same)
    best = votes.groupBy("id").agg(F.min_by("label", F.struct(-F.col("votes"), F.col("label"))).alias("predicted"))
    return test.join(best, "id", "left")


def feature_voting(train: DataFrame, test: DataFrame) -> DataFrame:
    """Adds `predicted` and `share`: every attribute votes for the class whose mean is closest in that attribute."""
    means = class_means(train)
    ship = _shipped_means(means, dims_of(train))
    if ship is None:
        m = means.select("label", F.posexplode("centroid").alias("attr", "mean"))
        met = long_form(test, "id").join(m, "attr").groupBy("id", "attr").agg(
            F.min_by("label", F.struct(F.abs(F.col("value") - F.col("mean")).alias("g"), F.col("label"))).alias("vote"))
        count = met.groupBy("id", "vote").agg(F.count(F.lit(1)).alias("n"))
        best = count.groupBy("id").agg(F.min(F.struct(-F.col("n"), F.col("vote"))).alias("x"), F.sum("n").alias("d"))
        return test.join(best.select("id", F.col("x.vote").alias("predicted"), (-F.col("x.col1") / F.col("d")).alias("share")), "id")

    @F.arrow_udf("struct<label: string, share: double>")
    def vote(v: pa.Array) -> pa.Array:
        labels, M = ship.value[None]
        X = matrix(v)
        pick = np.zeros(X.shape, dtype=np.int64)
        best = np.full(X.shape, np.inf)
        for c in range(len(labels)):
            gap = np.abs(X - M[c])
            closer = gap < best
            pick[closer], best[closer] = c, gap[closer]
        counts = np.stack([(pick == c).sum(axis=1) for c in range(len(labels))], axis=1)
        top = counts.argmax(axis=1)
        return pa.StructArray.from_arrays(
            [pa.array([labels[t] for t in top], pa.string()), pa.array(counts[np.arange(len(top)), top] / X.shape[1])],
            names=["label", "share"])

    hit = test.withColumn("_v", vote("features"))
    return hit.withColumns({"predicted": F.col("_v.label"), "share": F.col("_v.share")}).drop("_v")


# ---- Bayes on discrete values --------------------------------------------------------------------

def value_counts(train: DataFrame) -> DataFrame:
    """(attr, value, label, n)."""
    return long_form(train, "label").groupBy("attr", "value", "label").agg(F.count(F.lit(1)).alias("n"))


def _labels(train: DataFrame) -> list[tuple[str, int]]:
    rows = collect_bounded(class_counts(train), 64)
    if rows is None:
        raise ValueError("too many classes")
    return sorted((r["label"], r["n"]) for r in rows)


def naive_bayes(train: DataFrame, test: DataFrame) -> DataFrame:
    """(id, label, probability): class prior times (n + 1) / (class size + distinct values) per attribute.

    A value unseen in training counts as one more distinct value with no rows.
    """
    labels = _labels(train)
    total = sum(n for _, n in labels)
    wide = long_form(train, "label").groupBy("attr", "value").agg(
        *[F.count(F.when(F.col("label") == c, 1)).alias(f"n{i}") for i, (c, _) in enumerate(labels)])
    # Few values a row: counts are shipped while they fit, so that cells are not dealt by attribute or value, whose rows grow with the input.
    wide, _ = settle_small(wide, 8 * len(labels) + 32)
    distinct = wide.groupBy("attr").agg(F.count(F.lit(1)).alias("v"))
    cells = long_form(test, "id")
    met = cells.join(F.broadcast(distinct), "attr", "left").join(wide, ["attr", "value"], "left")  # one row per attribute
    values = F.coalesce("v", F.lit(0)) + F.when(F.col("n0").isNull(), 1).otherwise(0)
    parts = [F.sum(F.log2(F.coalesce(f"n{i}", F.lit(0)) + 1.0) - F.log2(F.lit(float(n)) + values)).alias(f"s{i}")
             for i, (_, n) in enumerate(labels)]
    summed = met.groupBy("id").agg(*parts)
    return _normalized(summed, [(c, n / total) for c, n in labels])


def _normalized(summed: DataFrame, priors: list[tuple[str, float]]) -> DataFrame:
    """Log2 scores s0.. plus log priors to (id, label, probability)."""
    score = [F.col(f"s{i}") + F.log2(F.lit(p)) for i, (_, p) in enumerate(priors)]
    top = reduce(lambda a, b: F.greatest(a, b), score[1:], score[0])
    power = [F.pow(F.lit(2.0), s - top) for s in score]
    whole = sum(power[1:], power[0])
    rows = F.array(*[F.struct(F.lit(c).alias("label"), (p / whole).alias("probability")) for (c, _), p in zip(priors, power)])
    return summed.select("id", F.explode(rows).alias("r")).select("id", "r.label", "r.probability")


def most_probable(scores: DataFrame, test: DataFrame, column: str = "probability") -> DataFrame:
    best = scores.groupBy("id").agg(F.min_by("label", F.struct(-F.col(column), F.col("label"))).alias("predicted"))
    return test.join(best, "id")


def mutual_information(train: DataFrame) -> DataFrame:
    """(attr, mi): information between each discrete attribute and the class, base 10."""
    counts, _ = settle_small(value_counts(train))
    n = counts.where("attr = 0").agg(F.sum("n")).scalar()
    lg = lambda p: p * F.log10(p)
    p = F.col("n") / F.col("all")
    base = counts.withColumn("all", n)
    joint = base.groupBy("attr").agg(F.sum(lg(p)).alias("xc"))
    values = base.groupBy("attr", "value").agg(F.sum("n").alias("n"), F.max("all").alias("all")).groupBy("attr").agg(F.sum(lg(p)).alias("x"))
    classes = base.groupBy("attr", "label").agg(F.sum("n").alias("n"), F.max("all").alias("all")).groupBy("attr").agg(F.sum(lg(p)).alias("c"))
    return joint.join(values, "attr").join(classes, "attr").select("attr", (F.col("xc") - F.col("x") - F.col("c")).alias("mi"))


def conditional_mutual_information(train: DataFrame) -> DataFrame:
    """(attr1 < attr2, cmi): sum over classes of the pairwise information within the class, base 10.

    Attribute pairs are formed inside each row, so points are never joined with each other.
    """
    d = F.size("features")
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), d - 2), lambda i: F.transform(
        F.sequence(i + 1, d - 1), lambda j: F.struct(
            i.alias("a1"), F.get("features", i).alias("v1"), j.alias("a2"), F.get("features", j).alias("v2")))))
    sizes = class_counts(train).withColumnRenamed("n", "n_c")
    lg = lambda: F.sum(F.col("n") / F.col("n_c") * F.log10(F.col("n") / F.col("n_c")))
    both = train.where(d >= 2).select("label", F.explode(pairs).alias("p")).groupBy("p.a1", "p.v1", "p.a2", "p.v2", "label").agg(
        F.count(F.lit(1)).alias("n")).join(sizes, "label").groupBy("a1", "a2").agg(lg().alias("xy"))
    one = value_counts(train).join(sizes, "label").groupBy("attr").agg(lg().alias("x"))
    return both.join(one.select(F.col("attr").alias("a1"), F.col("x").alias("x1")), "a1").join(
        one.select(F.col("attr").alias("a2"), F.col("x").alias("x2")), "a2").select(
        F.col("a1").alias("attr1"), F.col("a2").alias("attr2"), (F.col("xy") - F.col("x1") - F.col("x2")).alias("cmi"))


def dependence_parents(train: DataFrame, k: int, threshold: float = 0.0) -> dict[int, list[int]]:
    """Parents per attribute: among attributes with more class information, the k with the largest conditional one."""
    order = [r["attr"] for r in mutual_information(train).orderBy(F.desc("mi"), "attr").collect()]  # one row per attribute
    place = {a: i for i, a in enumerate(order)}
    cmi = conditional_mutual_information(train)
    later = F.create_map(*[x for a, i in place.items() for x in (F.lit(a), F.lit(i))])
    child_first = later[F.col("attr1")] > later[F.col("attr2")]
    edges = cmi.where(F.col("cmi") > threshold).select(
        F.when(child_first, F.col("attr1")).otherwise(F.col("attr2")).alias("child"),
        F.when(child_first, F.col("attr2")).otherwise(F.col("attr1")).alias("parent"), "cmi")
    w = Window.partitionBy("child").orderBy(F.desc("cmi"), "parent")
    out: dict[int, list[int]] = {a: [] for a in order}
    for r in edges.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).orderBy("child", "r").collect():  # k per attribute
        out[r["child"]].append(r["parent"])
    return out


def dependent_bayes(train: DataFrame, test: DataFrame, k: int = 1, threshold: float = 0.0) -> DataFrame:
    """(id, label, score, percentage): attributes conditioned on the class and up to k parent attributes.

    `percentage` spaces the classes evenly by rank of their score.
    """
    labels = _labels(train)
    total = sum(n for _, n in labels)
    parents = dependence_parents(train, k, threshold)

    def keyed(points: DataFrame, *keep: str) -> DataFrame:
        rows = []
        for a, ps in sorted(parents.items()):
            up = F.concat_ws("|", *[F.get("features", p).cast("string") for p in ps]) if ps else F.lit("")
            rows.append(F.struct(F.lit(a).alias("attr"), F.get("features", a).cast("string").alias("value"), up.alias("up")))
        return points.select(*keep, F.explode(F.array(*rows)).alias("r")).select(*keep, "r.*")

    per_class = [F.count(F.when(F.col("label") == c, 1)) for c, _ in labels]
    seen = keyed(train, "label")
    num = seen.groupBy("attr", "value", "up").agg(*[x.alias(f"n{i}") for i, x in enumerate(per_class)])
    # Shipped while they fit, the rest derived from them: neither cells nor training rows are dealt by attribute or value.
    num, _ = settle_small(num, 8 * len(labels) + 64)
    den, _ = settle_small(num.groupBy("attr", "up").agg(*[F.sum(f"n{i}").alias(f"d{i}") for i in range(len(labels))]), 8 * len(labels) + 48)
    known, _ = settle_small(num.groupBy("attr", "value").agg(F.lit(1).alias("known")), 48)
    distinct = known.groupBy("attr").agg(F.count(F.lit(1)).alias("v"))
    met = keyed(test, "id").join(F.broadcast(distinct), "attr").join(known, ["attr", "value"], "left").join(
        num, ["attr", "value", "up"], "left").join(den, ["attr", "up"], "left")
    values = F.col("v") + F.when(F.col("known").isNull(), 1).otherwise(0)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    summed = met.groupBy("id").agg(*[
        F.sum(F.log2((zero(f"n{i}") + 1) / (zero(f"d{i}") + values))).alias(f"s{i}") for i in range(len(labels))])
    rows = F.array(*[F.struct((F.col(f"s{i}") + F.log2(F.lit(n / total))).alias("score"), F.lit(c).alias("label"))
                     for i, (c, n) in enumerate(labels)])
    ranked = summed.select("id", F.posexplode(F.array_sort(rows)).alias("pos", "r"))
    return ranked.select("id", "r.label", "r.score", ((F.col("pos") + 1) * float(100 // len(labels))).alias("percentage"))


# ---- bagging -------------------------------------------------------------------------------------

def bagged_nearest_mean(train: DataFrame, test: DataFrame, bags: int = 10, seed: int = 1) -> DataFrame:
    """(id, label, share): votes of one nearest-mean classifier per bootstrap bag."""
    bag, _ = bootstrap(train, bags=bags, seed=seed)
    means = class_means(bag, "bag")
    every = test.withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1))))
    voted = nearest_mean_by_group(means, every, "bag", dims_of(train))
    return voted.groupBy("id", F.col("predicted").alias("label")).agg((F.count(F.lit(1)) / F.lit(float(bags))).alias("share"))


def out_of_bag_error(train: DataFrame, bags: int = 10, seed: int = 1) -> DataFrame:
    """(tested, error): share of wrong predictions over all (bag, out-of-bag point) pairs."""
    bag, oob = bootstrap(train, bags=bags, seed=seed)
    voted = nearest_mean_by_group(class_means(bag, "bag"), oob, "bag", dims_of(train))
    return voted.agg(F.count(F.lit(1)).alias("tested"),
                     F.avg((F.col("predicted") != F.col("label")).cast("double")).alias("error"))


# ---- Spark ML classifiers ------------------------------------------------------------------------

def _ml_input(points: DataFrame) -> DataFrame:
    return points.withColumn("vec", array_to_vector("features"))


def _ml_fit_predict(train: DataFrame, test: DataFrame, estimator) -> DataFrame:
    data = _ml_input(train)
    index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(data)
    model = estimator.setFeaturesCol("vec").setLabelCol("y").fit(index.transform(data))
    scored = model.transform(_ml_input(test))
    back = IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels)
    clean = test.drop("prediction")
    return back.transform(scored.withColumn("prediction", F.col("prediction").cast("double"))).select(*clean.columns, "predicted")


def tree(train: DataFrame, test: DataFrame, depth: int = 5) -> DataFrame:
    return _ml_fit_predict(train.drop("prediction"), test.drop("prediction"), DecisionTreeClassifier(maxDepth=depth, seed=1))


def random_forest(train: DataFrame, test: DataFrame, trees: int = 10, depth: int = 5, seed: int = 1) -> DataFrame:
    return _ml_fit_predict(train.drop("prediction"), test.drop("prediction"),
                           RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed))


def _svm(c: float, rows: float, iterations: int, classes: int):
    """Soft-margin model for cost c. Spark weighs the mean loss, so its regularisation is 1 / (c * rows); two classes need
    one model only."""
    one = LinearSVC(regParam=1.0 / (c * max(rows, 1)), maxIter=iterations)
    return one if classes == 2 else OneVsRest(classifier=one)


def _indexed(points: DataFrame) -> tuple[DataFrame, int]:
    """Rows with `vec` and the class number `y`, and the number of classes."""
    data = _ml_input(points.drop("prediction"))
    index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(data)
    return index.transform(data), len(index.labels)


def linear_svm(train: DataFrame, test: DataFrame, c: float = 1.0, iterations: int = 100) -> DataFrame:
    rows, classes = train.agg(F.count(F.lit(1)), F.countDistinct("label")).first()
    return _ml_fit_predict(train.drop("prediction"), test.drop("prediction"), _svm(c, rows, iterations, classes))


def svm_weights(points: DataFrame, c: float = 1.0, iterations: int = 100) -> np.ndarray:
    """Sum of absolute weights per attribute over the models."""
    data, classes = _indexed(points)
    model = _svm(c, points.count(), iterations, classes).setFeaturesCol("vec").setLabelCol("y").fit(data)
    return sum(np.abs(m.coefficients.toArray()) for m in getattr(model, "models", [model]))


class SumOfF(Evaluator):
    """Sum over the classes of the F-measure."""

    def _evaluate(self, dataset):
        own, said, right = Counter(), Counter(), Counter()
        for r in dataset.groupBy("y", "prediction").count().collect():  # at most classes x classes rows
            own[r["y"]] += r["count"]
            said[r["prediction"]] += r["count"]
            right[r["y"]] += r["count"] * (r["y"] == r["prediction"])
        return sum(2.0 * right[c] / (own[c] + said[c]) for c in own)

    def isLargerBetter(self):
        return True


def svm_grid_search(points: DataFrame, lower: int = -5, upper: int = 5, folds: int = 4, iterations: int = 100, seed: int = 1) -> DataFrame:
    """(c, score, best): cross-validated sum of the classes' F-measures for C = 2^lower .. 2^(upper-1)."""
    data, classes = _indexed(points)
    data = data.select("vec", "y").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        cs = [2.0 ** e for e in range(lower, upper)]
        models = [_svm(c, data.count() * (folds - 1) / folds, iterations, classes) for c in cs]
        ask = models[0].setFeaturesCol("vec").setLabelCol("y")
        grid = [{ask.regParam: m.getRegParam()} if classes == 2 else {ask.classifier: m.getClassifier()} for m in models]
        cv = CrossValidator(estimator=ask, estimatorParamMaps=grid, numFolds=folds, seed=seed, parallelism=4, evaluator=SumOfF())
        scores = cv.fit(data).avgMetrics
    finally:
        data.unpersist()
    best = int(np.argmax(scores))
    return points.sparkSession.createDataFrame(
        [(c, float(s), i == best) for i, (c, s) in enumerate(zip(cs, scores))], "c double, score double, best boolean")


def self_tuned_svm(train: DataFrame, test: DataFrame, iterations: int = 100, **grid) -> DataFrame:
    """The linear model with the best C of the grid, fitted to all of `train`."""
    best = svm_grid_search(train, iterations=iterations, **grid).where("best").first()["c"]
    return linear_svm(train, test, best, iterations)


def som_classify(train: DataFrame, test: DataFrame, **options) -> DataFrame:
    """Majority class of the map cell a point falls into, from the training points of that cell."""
    weights = som_fit(train, **options)
    cells = som_assign(train, weights).groupBy("prediction", "label").agg(F.count(F.lit(1)).alias("n"))
    top = cells.groupBy("prediction").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("predicted"))
    return som_assign(test, weights).join(top, "prediction", "left")


# ---- evaluation ----------------------------------------------------------------------------------

def confusion_counts(predicted: DataFrame, *by: str) -> DataFrame:
    """(*by, label, tp, fp, tn, fn) for every true class."""
    return confusion_of(predicted.groupBy(*by, "label", "predicted").agg(F.count(F.lit(1)).alias("n")), *by)


def confusion_of(pairs: DataFrame, *by: str) -> DataFrame:
    """The same from counted pairs (*by, label, predicted, n)."""
    truth = pairs.groupBy(*by, "label").agg(
        F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("pos"))
    called = pairs.groupBy(*by, F.col("predicted").alias("label")).agg(F.sum("n").alias("called"))
    total = pairs.groupBy(*by).agg(F.sum("n").alias("total"))
    full = truth.join(called, [*by, "label"], "left")
    full = full.join(total, list(by)) if by else full.withColumn("total", total.scalar())
    fp = F.coalesce("called", F.lit(0)) - F.col("tp")
    fn = F.col("pos") - F.col("tp")
    return full.select(*by, "label", "tp", fp.alias("fp"), (F.col("total") - F.col("tp") - fp - fn).alias("tn"), fn.alias("fn"))


def measures(counts: DataFrame, beta: float = 1.0) -> DataFrame:
    """All rates and scores derived from tp, fp, tn, fn; undefined ratios are null, F is 0 then."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    div = F.try_divide
    recall, precision = div(tp, tp + fn), div(tp, tp + fp)
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    b2 = beta * beta
    miss, alarm = div(fn, tp + fn), div(fp, tn + fp)
    q9 = F.when(tp + fn == 0, div(tn - fp, tn + fp)).when(tn + fp == 0, div(tp - fn, tp + fn)).otherwise(
        1 - F.sqrt(F.lit(2.0)) * F.sqrt(miss * miss + alarm * alarm))
    bcr = F.when((tn == 0) & (fp == 0), recall).when((tp == 0) & (fn == 0), div(tn, tn + fp)).otherwise(
        0.5 * (recall + div(tn, tn + fp)))
    total = tp + fp + tn + fn
    return counts.select(
        *[c for c in counts.columns], recall.alias("tp_rate"), div(tn, tn + fp).alias("tn_rate"), miss.alias("fn_rate"),
        alarm.alias("fp_rate"), ((fp + fn) / total).alias("error_rate"), ((tp + tn) / total).alias("accuracy"),
        recall.alias("recall"), precision.alias("precision"),
        F.coalesce(div((b2 + 1) * precision * recall, b2 * precision + recall), F.lit(0.0)).alias("f_measure"),
        div(tp * tn - fp * fn, root).alias("correlation_coefficient"), div(tp * tn + fp * fn, root).alias("correlation"),
        div(fp, tp).alias("cost"), q9.alias("q9"), bcr.alias("bcr"), total.alias("total"))


def cross_validate_nearest_mean(points: DataFrame, folds: int = 10, seed: int = 1, metric: str = "euclidean") -> DataFrame:
    """(label, tp, fp, tn, fn) over all folds. The means for a fold come from the sums of the other folds, so the
    points are aggregated once and classified once, whatever the number of folds."""
    split = kfold_split(points, folds, seed)
    vec = array_to_vector("features")
    per = split.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"), Summarizer.sum(vec).alias("s"))
    dims = dims_of(points)
    per, _ = settle_small(per.select("fold", "label", "n", vector_to_array("s").alias("s")), 8 * dims + 64)
    whole = per.groupBy("label").agg(F.sum("n").alias("nt"), Summarizer.sum(array_to_vector("s")).alias("st"))
    whole = whole.select("label", "nt", vector_to_array("st").alias("st"),
                         F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    rest = whole.join(per, ["fold", "label"], "left")
    left = F.col("nt") - F.coalesce("n", F.lit(0))
    zero = F.transform("st", lambda x: F.lit(0.0))
    means = rest.where(left > 0).select("fold", "label", F.zip_with(
        "st", F.coalesce("s", zero), lambda a, b: (a - b) / left).alias("centroid"))
    return confusion_counts(nearest_mean_by_group(means, split, "fold", dims, metric))


def cross_validate(points: DataFrame, fit_predict, folds: int = 10, seed: int = 1) -> DataFrame:
    """The same for any `fit_predict(train, test)` that adds `predicted`; one fit per fold."""
    from ..session import cut_lineage

    split = cut_lineage(kfold_split(points, folds, seed))
    scored = [fit_predict(split.where(F.col("fold") != f), split.where(F.col("fold") == f)).select("id", "label", "predicted")
              for f in range(folds)]
    return confusion_counts(reduce(DataFrame.unionByName, scored))
