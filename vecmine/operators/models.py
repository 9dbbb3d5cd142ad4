"""Classifiers as objects: `fit` gives a model, a model's `transform` adds `predicted` and `distribution` (class -> share, summing to one).

Every classifier can be fitted once per group (`fit_groups`, by a bag or fold column); those whose model is an aggregate fit all groups in one
pass. Bagging and cross-validation take any of them. A model whose prediction needs only the row itself adds its columns without an exchange, so a
bag's votes are gathered in the row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, settle_small
from . import classify as K
from .centroids import dims_of
from .sampling import kfold_split
from .trees import bagged, random_forest, random_tree, with_majority


@dataclass
class Model:
    """A fitted classifier: `predict` adds `predicted` and, if it knows shares, `distribution`."""

    predict: Callable[[DataFrame], DataFrame]

    def transform(self, points: DataFrame) -> DataFrame:
        out = self.predict(points.drop("predicted", "distribution"))
        if "distribution" not in out.columns:
            sure = F.when(F.col("predicted").isNotNull(), F.create_map("predicted", F.lit(1.0)))
            out = out.withColumn("distribution", sure)
        return out


class Classifier:
    """`fit(train)` on (id, features, label); rows without a label teach nothing."""

    def fit(self, train: DataFrame) -> Model:
        raise NotImplementedError

    def fit_groups(self, train: DataFrame, by: str, groups: int) -> list[Model]:
        """One model for every value 0 .. groups - 1 of the integer column `by`."""
        return [self.fit(train.where(F.col(by) == g).drop(by)) for g in range(groups)]


class _Aggregated(Classifier):
    """A classifier whose model is an aggregate with few rows per group."""

    def aggregate(self, train: DataFrame, *by: str) -> DataFrame:
        raise NotImplementedError

    def model(self, stats: DataFrame, dims: int) -> Model:
        raise NotImplementedError

    def row_bytes(self, dims: int) -> int:
        return 64

    def fit(self, train: DataFrame) -> Model:
        dims = dims_of(train)
        return self.model(settle_small(self.aggregate(train.where("label IS NOT NULL")), self.row_bytes(dims))[0], dims)

    def fit_groups(self, train: DataFrame, by: str, groups: int) -> list[Model]:
        dims = dims_of(train)
        stats, rows = settle_small(self.aggregate(train.where("label IS NOT NULL"), by), self.row_bytes(dims))
        stats = cut_lineage(stats) if rows is None else stats
        return [self.model(stats.where(F.col(by) == g).drop(by), dims) for g in range(groups)]


class Majority(_Aggregated):
    """The most frequent class, ties to the smallest; the shares are those of the training rows."""

    def aggregate(self, train, *by):
        return train.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"))

    def model(self, stats, dims):
        top = stats.agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("t")).scalar()
        total = stats.agg(F.sum("n")).scalar()
        shares = stats.agg(F.map_from_entries(F.collect_list(F.struct("label", F.col("n") / total)))).scalar()  # a row per class
        return Model(lambda points: points.withColumns({"predicted": top, "distribution": shares}))


class NearestMean(_Aggregated):
    """The class whose mean is nearest."""

    def __init__(self, metric: str = "euclidean"):
        self.metric = metric

    def aggregate(self, train, *by):
        return K.class_means(train, *by)

    def row_bytes(self, dims):
        return 8 * dims + 64

    def model(self, stats, dims):
        return Model(lambda points: K.nearest_mean_by_group(stats, points, None, dims, self.metric))


class FitPredict(Classifier):
    """Any function (train, points) -> points with `predicted` as a classifier."""

    def __init__(self, call: Callable[[DataFrame, DataFrame], DataFrame]):
        self.call = call

    def fit(self, train):
        return Model(lambda points: self.call(train, points))


class NearestNeighbours(Classifier):
    """Most votes of the k nearest training points; the distribution is the share of votes."""

    def __init__(self, k: int = 5, metric: str = "euclidean"):
        self.k, self.metric = k, metric

    def fit(self, train):
        train = train.where("label IS NOT NULL")

        def predict(points):
            near = K.nearest(points, train, self.k, self.metric).select("id", "neighbour")
            votes = near.join(train.select(F.col("id").alias("neighbour"), "label"), "neighbour").groupBy("id").agg(F.collect_list("label").alias("votes"))  # k a row
            return with_majority(points.join(votes, "id", "left")).drop("votes")

        return Model(predict)


class NaiveBayes(Classifier):
    """Discrete naive Bayes with its class probabilities."""

    def fit(self, train):
        train = train.where("label IS NOT NULL")

        def predict(points):
            scores = K.naive_bayes(train, points)
            best = scores.groupBy("id").agg(F.min_by("label", F.struct(-F.col("probability"), F.col("label"))).alias("predicted"),
                                            F.map_from_entries(F.collect_list(F.struct("label", "probability"))).alias("distribution"))
            return points.join(best, "id", "left")

        return Model(predict)


class RandomTree(Classifier):
    def __init__(self, attributes: int | None = None, depth: int = 8, seed: int = 1):
        self.attributes, self.depth, self.seed = attributes, depth, seed

    def fit(self, train):
        return Model(random_tree(train, self.attributes, self.depth, self.seed).transform)


class RandomForest(Classifier):
    def __init__(self, trees: int = 10, attributes: int | None = None, depth: int = 8, seed: int = 1):
        self.trees, self.attributes, self.depth, self.seed = trees, attributes, depth, seed

    def fit(self, train):
        return Model(random_forest(train, self.trees, self.attributes, self.depth, self.seed)[0].transform)


class LinearSvm(FitPredict):
    def __init__(self, c: float = 1.0, iterations: int = 100):
        super().__init__(lambda train, points: K.linear_svm(train, points, c, iterations))


class Bagging(Classifier):
    """`bags` models of any classifier, each fitted on rows drawn with Poisson multiplicities; a vote a bag."""

    def __init__(self, base: Classifier, bags: int = 10, seed: int = 1):
        self.base, self.bags, self.seed = base, bags, seed

    def fit(self, train) -> "BaggedModel":
        rows = bagged(train, self.bags, self.seed)
        drawn = rows.select("id", "features", "label", F.posexplode("w").alias("bag", "copies")).where("copies > 0")
        # A row drawn twice is there twice.
        drawn = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")
        return BaggedModel(self.base.fit_groups(drawn, "bag", self.bags), rows)


class BaggedModel(Model):
    def __init__(self, models: list[Model], rows: DataFrame):
        super().__init__(lambda points: with_majority(self.votes(points)).drop("votes"))
        self.models, self.rows = models, rows

    def votes(self, points: DataFrame) -> DataFrame:
        """Points with `votes`, one class per bag."""
        names = [f"vote{b}" for b in range(len(self.models))]
        out = points
        for name, model in zip(names, self.models):
            out = model.predict(out).withColumnRenamed("predicted", name).drop("distribution")
        return out.withColumn("votes", F.array(*names)).drop(*names)

    def out_of_bag(self) -> DataFrame:
        """Training rows with the majority of the bags that did not draw them; null where every bag did."""
        held_out = F.filter(F.zip_with("votes", "w", lambda v, w: F.when(w == 0, v)), lambda v: v.isNotNull())
        return with_majority(self.votes(self.rows), held_out).drop("votes", "w")

    def out_of_bag_error(self) -> DataFrame:
        """(tested, error) over the labelled rows that some bag did not draw."""
        said = self.out_of_bag().where("predicted IS NOT NULL AND label IS NOT NULL")
        return said.agg(F.count(F.lit(1)).alias("tested"), F.avg((F.col("predicted") != F.col("label")).cast("double")).alias("error"))


def cross_validate(classifier: Classifier, points: DataFrame, folds: int = 10, seed: int = 1) -> DataFrame:
    """(label, tp, fp, tn, fn) over all folds, each predicted by the model of the others."""
    split = cut_lineage(kfold_split(points.select("id", "features", "label"), folds, seed))
    # A row teaches every fold but its own.
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("fold"))
    taught = split.withColumn("other", F.explode(others)).drop("fold").withColumnRenamed("other", "fold")
    models = classifier.fit_groups(taught, "fold", folds)
    scored = [m.transform(split.where(F.col("fold") == f).drop("fold")).select("id", "label", "predicted") for f, m in enumerate(models)]
    return K.confusion_counts(reduce(DataFrame.unionByName, scored))
