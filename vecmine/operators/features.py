"""Feature scores, rankings and subsets. Scores are (attr, score), rankings (attr, rank) with 0 = best."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distances import measure
from ..functions.hashing import hash_uniform
from ..session import cut_lineage, one_row, settle_small
from ..sources.points import class_index, long_form
from .classify import confusion_counts, measures, svm_weights
from .filters import EqualWidthBinner, MidrangeScaler, retain_attributes
from .pairs import nearest
from .sampling import bootstrap
from .stats import as_row, attribute_stats


def _binned_entropies(points: DataFrame, bins: int) -> DataFrame:
    """(attr, t, cell, r, c): totals of n log2 n over cells, bins and classes after equal-width binning."""
    binned = EqualWidthBinner(bins).fit_transform(points)
    counts = long_form(binned, "label").groupBy("attr", "value", "label").agg(F.count(F.lit(1)).cast("double").alias("n"))
    counts, _ = settle_small(counts)  # at most bins x classes rows per attribute
    xlogx = lambda c: F.sum(F.when(F.col(c) > 0, F.col(c) * F.log2(c)).otherwise(0.0))
    cell = counts.groupBy("attr").agg(F.sum("n").alias("t"), xlogx("n").alias("cell"))
    rows = counts.groupBy("attr", "value").agg(F.sum("n").alias("x")).groupBy("attr").agg(xlogx("x").alias("r"))
    cols = counts.groupBy("attr", "label").agg(F.sum("n").alias("x")).groupBy("attr").agg(xlogx("x").alias("c"))
    return cell.join(rows, "attr").join(cols, "attr").select("attr", "t", "cell", "r", "c", (F.col("t") * F.log2("t")).alias("tt"))


def gain_ratio(points: DataFrame, bins: int = 10) -> DataFrame:
    e = _binned_entropies(points, bins)
    gain = (F.col("tt") - F.col("c")) - (F.col("r") - F.col("cell"))
    split = F.col("tt") - F.col("r")
    return e.select("attr", F.when(split < 1e-9, F.lit(0.0)).otherwise(F.try_divide(gain, split)).alias("score"))


def symmetrical_uncertainty(points: DataFrame, bins: int = 10) -> DataFrame:
    e = _binned_entropies(points, bins)
    gain = (F.col("tt") - F.col("c")) - (F.col("r") - F.col("cell"))
    both = (F.col("tt") - F.col("r")) + (F.col("tt") - F.col("c"))
    return e.select("attr", F.when(both < 1e-9, F.lit(0.0)).otherwise(F.try_divide(2 * gain, both)).alias("score"))


def kl_divergence(points: DataFrame, bins: int = 100) -> DataFrame:
    """Largest scaled divergence over ordered class pairs; empty bins count as 1e-7, each pair scaled by its maximum."""
    scaled = MidrangeScaler(bins / 2.0, bins - 0.000001).fit_transform(points)
    cells = long_form(scaled, "label").select("attr", "label", F.floor("value").cast("int").alias("bin"))
    counts = cells.groupBy("attr", "label", "bin").agg(F.count(F.lit(1)).alias("n"))
    counts, _ = settle_small(counts)
    # One row of `bins` shares per attribute and class.
    share = counts.groupBy("attr", "label").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.sum("n").alias("t"))
    share = share.select("attr", "label", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(
        F.try_element_at("m", b) / F.col("t"), F.lit(0.0000001))).alias("p"))
    other = share.select("attr", F.col("label").alias("label_q"), F.col("p").alias("q"))
    terms = F.zip_with("p", "q", lambda p, q: p * F.log(p / q))
    pairs = share.join(other, "attr").where("label <> label_q").select(
        "attr", "label", "label_q", F.aggregate(terms, F.lit(0.0), lambda a, x: a + x).alias("kl"))
    top = pairs.groupBy("label", "label_q").agg(F.max("kl").alias("top"))
    return pairs.join(top, ["label", "label_q"]).groupBy("attr").agg(
        F.max(F.try_divide("kl", "top")).alias("score"))


def relief(points: DataFrame, k: int = 2) -> DataFrame:
    """Mean difference to the k nearest misses minus that to the k nearest hits, over all points, on [0, 1] data."""
    scaled = MidrangeScaler(0.5, 1.0).fit_transform(points)
    coded = scaled.join(class_index(points), "label").select(
        "id", "features", F.col("class_index").cast("bigint").alias("cls"))
    near = cut_lineage(nearest(coded, coded, k, "manhattan", same=True, by_label=True).select("id", "neighbour", "hit"))  # read twice
    size = near.groupBy("id", "hit").agg(F.count(F.lit(1)).alias("c"))
    a = coded.select("id", F.col("features").alias("x"))
    b = coded.select(F.col("id").alias("neighbour"), F.col("features").alias("y"))
    met = near.join(size, ["id", "hit"]).join(a, "id").join(b, "neighbour")
    gaps = met.select("hit", "c", F.posexplode(F.zip_with("x", "y", lambda p, q: F.abs(p - q))).alias("attr", "gap"))
    signed = F.when(F.col("hit"), -F.col("gap")).otherwise(F.col("gap")) / F.col("c")
    m = points.agg(F.count(F.lit(1)).cast("double")).scalar()
    return gaps.groupBy("attr").agg(F.sum(signed).alias("s")).select("attr", (F.col("s") / m).alias("score"))


def forest_permutation(points: DataFrame, trees: int = 10, depth: int = 5, seed: int = 1, test_share: float = 0.3) -> DataFrame:
    """Drop of the summed F-measure on held-out points when one attribute is replaced by random values from its
    range, scaled to 0..1. All attributes are scored in one pass over the held-out points."""
    u = hash_uniform(F.col("id"), f"{seed}:hold")
    data = points.select("id", "features", "label").withColumn("u", u)
    train, test = data.where(F.col("u") >= test_share), data.where(F.col("u") < test_share)
    index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(data)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="vec", labelCol="y")
    model = forest.fit(index.transform(train.withColumn("vec", array_to_vector("features"))))
    box = one_row(as_row(attribute_stats(points).select("attr", "min", "max")))
    every = test.withColumn("s", box).withColumn("attr", F.explode(F.sequence(F.lit(-1), F.size("features") - 1)))
    noise = hash_uniform(F.concat_ws("|", "id", "attr"), f"{seed}:noise")
    lo, hi = F.get("s.min", F.col("attr")), F.get("s.max", F.col("attr"))
    changed = F.transform("features", lambda x, i: F.when(i == F.col("attr"), lo + noise * (hi - lo)).otherwise(x))
    scored = model.transform(every.withColumn("vec", array_to_vector(changed)))
    named = IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels).transform(scored)
    per = measures(confusion_counts(named.select("attr", "label", "predicted"), "attr")).groupBy("attr").agg(F.sum("f_measure").alias("f"))
    base = per.where("attr = -1").select("f").scalar()
    drop = per.where("attr >= 0").withColumn("drop", base - F.col("f"))
    span = one_row(drop.agg(F.min("drop").alias("lo"), F.max("drop").alias("hi")))
    return drop.withColumn("s", span).select("attr", F.coalesce(
        F.try_divide(F.col("drop") - F.col("s.lo"), F.col("s.hi") - F.col("s.lo")), F.lit(0.0)).alias("score"))


def rank_scores(scores: DataFrame) -> DataFrame:
    """Highest score gets rank 0, ties by attribute. One row per attribute."""
    ordered = scores.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("attr")))).alias("r"))
    return ordered.select(F.posexplode("r").alias("rank", "x")).select(F.col("x.attr").alias("attr"), "rank")


# ---- relation of each attribute to the class index -----------------------------------------------

def relation_to_class(points: DataFrame, metric: str = "pearson") -> DataFrame:
    """(attr, score) of the attribute column against the class-index column."""
    coded = points.join(class_index(points), "label")
    cells = long_form(coded, F.col("class_index").cast("double").alias("y"))
    x, y = F.col("value"), F.col("y")
    formula = {
        "pearson": F.corr("value", "y"),
        "euclidean": F.sqrt(F.sum((x - y) * (x - y))),
        "manhattan": F.sum(F.abs(x - y)),
        "chebyshev": F.max(F.abs(x - y)),
        "cosine_similarity": F.greatest(F.try_divide(F.sum(x * y), F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y))), F.lit(0.0)),
    }[metric]
    return cells.groupBy("attr").agg(formula.alias("score"))


def _by_relation(points: DataFrame, n: int, metric: str) -> DataFrame:
    bad = measure(metric).badness(F.col("score"))
    scored = relation_to_class(points, metric)
    usable = scored.where(F.col("score").isNotNull() & ~F.isnan("score"))
    ordered = usable.agg(F.array_sort(F.collect_list(F.struct(bad.alias("b"), F.col("attr"), F.col("score")))).alias("r"))
    top = F.slice("r", 1, n)
    return ordered.select(F.explode(top).alias("x")).select("x.attr", "x.score")


def select_forward(points: DataFrame, n: int, metric: str = "pearson") -> DataFrame:
    """(attr, score): the n attributes most related to the class. Scores do not depend on earlier picks."""
    return _by_relation(points, n, metric)


def select_backward(points: DataFrame, n: int, metric: str = "pearson") -> DataFrame:
    """(attr, score) left after dropping the worst ones; undefined scores go first, then ties from the last attribute."""
    return _by_relation(points, n, metric)


def rank_svm_rfe(points: DataFrame, remove: float = 0.2, c: float = 1.0, iterations: int = 100) -> DataFrame:
    """(attr, rank): refit a linear SVM, drop the given share of the lightest attributes, repeat."""
    left = list(range(len(points.select("features").first()[0])))
    order: list[int] = []  # worst first
    while left:
        if len(left) == 1:
            order += left
            break
        weights = svm_weights(retain_attributes(points, left), c, iterations)
        drop = max(1, int(len(left) * remove))
        worst = sorted(range(len(left)), key=lambda i: (weights[i], -left[i]))[:drop]
        order += [left[i] for i in worst]
        left = [a for i, a in enumerate(left) if i not in set(worst)]
    rows = [(a, r) for r, a in enumerate(reversed(order))]
    return points.sparkSession.createDataFrame(rows, "attr int, rank int")


def rank_ensemble(points: DataFrame, scorers=(gain_ratio, symmetrical_uncertainty), seed: int = 1) -> DataFrame:
    """(attr, total, rank): ranks on one bootstrap bag per scorer, summed; smallest sum is best."""
    bag, _ = bootstrap(points.select("id", "features", "label"), bags=len(scorers), seed=seed)
    ranked = [rank_scores(score(bag.where(F.col("bag") == i))) for i, score in enumerate(scorers)]
    total = reduce(DataFrame.unionByName, ranked).groupBy("attr").agg(F.sum("rank").alias("total"))
    order = total.agg(F.array_sort(F.collect_list(F.struct("total", "attr"))).alias("r"))
    return order.select(F.posexplode("r").alias("rank", "x")).select("x.attr", "x.total", "rank")
