"""Shapley values of a fitted forest's features, exact over its trees.

The value of a set of features is what a tree predicts if the others are unknown:
at a split on an unknown feature both sides count by their training weight.  A leaf
then adds to a set's value its prediction times, for each feature on its path,
whether the row takes the path's side if the feature is in the set, else the share
of weight that goes that way.  Such a product's Shapley values follow from the
coefficients of one polynomial a feature, in the number of features known.  They
depend on a row only by the sides it takes, so a batch of rows needs them once for
each pattern of sides that occurs.  The fitted trees, bounded by their number and
depth, travel with the function; rows stay where they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import comb
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassificationModel, RandomForestClassificationModel
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stages import shared_folder


@dataclass
class Leaf:
    """A leaf's class shares and its path: for each feature on it the sides taken,
    (left, categories or None, threshold), and the share of weight that takes them."""

    value: np.ndarray
    sides: dict[int, list[tuple[bool, np.ndarray | None, float]]] = field(default_factory=dict)
    share: dict[int, float] = field(default_factory=dict)

    def below(self, feature: int, side: tuple[bool, np.ndarray | None, float], share: float) -> Leaf:
        sides = {**self.sides, feature: [*self.sides.get(feature, []), side]}
        return Leaf(self.value, sides, {**self.share, feature: self.share.get(feature, 1.0) * share})

    def takes(self, x: np.ndarray) -> np.ndarray:
        """Whether rows of ``x`` take the path's side, a column for each feature on it."""
        out = np.ones((len(x), len(self.sides)), bool)
        for j, (f, sides) in enumerate(self.sides.items()):
            for left, categories, threshold in sides:
                hit = np.isin(x[:, f], categories) if categories is not None else x[:, f] <= threshold
                out[:, j] &= hit == left
        return out

    def weights(self, takes: np.ndarray) -> np.ndarray:
        """Shapley values of the product, for each pattern of sides and feature."""
        m, share = takes.shape[1], np.array(list(self.share.values()))
        out = np.zeros(takes.shape)
        for i in range(m):
            known = np.zeros((len(takes), m))
            known[:, 0] = 1.0
            for j in range(m):
                if j != i:
                    more = np.zeros_like(known)
                    more[:, 1:] = known[:, :-1] * takes[:, j : j + 1]
                    known = known * share[j] + more
            size = np.array([1.0 / (m * comb(m - 1, s)) for s in range(m)])
            out[:, i] = (takes[:, i] - share[i]) * (known @ size)
        return out


class Forest(NamedTuple):
    """The leaves of every tree, and the numbers of features and classes."""

    trees: list[list[Leaf]]
    features: int
    classes: int


Model = RandomForestClassificationModel | DecisionTreeClassificationModel


def forest(models: Model | Forest | Sequence[Model], spark: SparkSession) -> Forest:
    """The trees of one model, or of several together."""
    if isinstance(models, Forest):
        return models
    several = models if isinstance(models, list) else [models]
    return Forest([tree for m in several for tree in leaves(m, spark)], several[0].numFeatures, max(m.numClasses for m in several))


def leaves(model: RandomForestClassificationModel | DecisionTreeClassificationModel, spark: SparkSession) -> list[list[Leaf]]:
    """The leaves of every tree, from the model's saved table of nodes, in the shared folder."""
    at = f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}"
    model.write().overwrite().save(at)
    try:
        saved = spark.read.parquet(f"{at}/data")
        rows = saved.select(*(["treeID", "nodeData.*"] if "treeID" in saved.columns else [F.lit(0).alias("treeID"), "*"])).collect()  # the nodes of the fitted trees
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    trees: dict[int, dict[int, object]] = {}
    for r in rows:
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    out = []
    for _, nodes in sorted(trees.items()):
        found: list[Leaf] = []
        todo = [(0, Leaf(np.zeros(0)))]
        while todo:
            at_node, path_so_far = todo.pop()
            node = nodes[at_node]
            stats = np.array(node["impurityStats"], float)
            if node["leftChild"] < 0:
                found.append(Leaf(stats / max(stats.sum(), 1e-300), path_so_far.sides, path_so_far.share))
                continue
            split = node["split"]
            values = split["leftCategoriesOrThreshold"]
            categories, threshold = (None, values[0]) if split["numCategories"] < 0 else (np.array(values), 0.0)
            for child, left in ((node["leftChild"], True), (node["rightChild"], False)):
                share = sum(nodes[child]["impurityStats"]) / max(stats.sum(), 1e-300)
                todo.append((child, path_so_far.below(split["featureIndex"], (left, categories, threshold), share)))
        out.append(found)
    return out


def mean_prediction(trees: Sequence[Sequence[Leaf]]) -> np.ndarray:
    """Class shares with no feature known; attributions add up to a row's minus these."""
    return sum((leaf.value * np.prod(list(leaf.share.values())) for tree in trees for leaf in tree), np.zeros(1)) / len(trees)


def shapley(trees: Sequence[Sequence[Leaf]], x: np.ndarray, features: int, classes: int) -> np.ndarray:
    """rows x classes x features: the mean over the trees."""
    out = np.zeros((len(x), classes, features))
    for tree in trees:
        for leaf in tree:
            if not leaf.sides or not len(x):
                continue
            takes = leaf.takes(x)
            _, first, own = np.unique(takes @ (1 << np.arange(takes.shape[1])), return_index=True, return_inverse=True)
            each = leaf.weights(takes[first])[:, None, :] * leaf.value[None, :, None] / len(trees)
            out[:, :, list(leaf.sides)] += each[own.ravel()]
    return out


def attributed(df: DataFrame, model: Model | Forest | Sequence[Model], features: str = "features", to: str = "attributions") -> DataFrame:
    """ML-43: ``df`` with an array over the classes of arrays over the features: how much
    each moved the class's probability from its mean.  A missing number takes the right
    side of a threshold, as in the model; a null vector gives null."""
    trees, n, k = forest(model, df.sparkSession)

    @F.pandas_udf("array<array<double>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            there = rows.notna()
            out = pd.Series([None] * len(rows), dtype=object)
            if there.any():
                got = shapley(trees, np.stack(rows[there].to_list()), n, k)
                out[there.to_numpy()] = pd.Series([list(map(list, g)) for g in got], dtype=object).to_numpy()
            yield out

    return df.withColumn(to, of(F.when(F.col(features).isNotNull(), vector_to_array(features))))


def patterns(df: DataFrame, model: Model | Forest | Sequence[Model], features: str = "features", weight: str | None = None) -> DataFrame:
    """(features, n): a vector for each pattern of sides that rows of ``df`` take at the
    model's splits, and the number of such rows, each counting ``weight`` times; null
    vectors are left out.

    A number is replaced by the largest that takes the same sides everywhere, a
    category stays.  There are at most as many vectors as products of the features'
    splits, however many rows, and rows are only counted."""
    trees, width, _ = forest(model, df.sparkSession)
    sides = [(f, side) for tree in trees for leaf in tree for f, own in leaf.sides.items() for side in own]
    rows, kept, names = df.where(F.col(features).isNotNull()).select(vector_to_array(features).alias("__x"), (F.col(weight) if weight else F.lit(1)).alias("__n")), [], []
    for f in range(width):
        cuts = sorted({cut for at, (_, categories, cut) in sides if at == f and categories is None})
        name = f"__f{f}"
        if any(at == f and categories is not None for at, (_, categories, _) in sides):
            rows, value = rows.withColumn(name, F.get("__x", F.lit(f))), F.col(name)
        elif cuts:
            # A cut's number is on its left side, a bucket's least number is in it.
            splits = [-np.inf, *sorted({float(np.nextafter(c, np.inf)) for c in cuts}), np.inf]
            rows = Bucketizer(splits=splits, inputCol=f"__v{f}", outputCol=name, handleInvalid="keep").transform(rows.withColumn(f"__v{f}", F.get("__x", F.lit(f))))
            value = F.get(F.array(*[F.lit(float(v)) for v in [*cuts, np.inf, np.inf]]), F.col(name).cast("int"))  # missing: the right side
        else:
            rows, value = rows.withColumn(name, F.lit(0.0)), F.col(name)
        kept.append(value)
        names.append(name)
    return rows.groupBy(*names).agg(F.sum("__n").alias("n")).select(array_to_vector(F.array(*kept)).alias(features), "n")


def mean_attributions(df: DataFrame, names: Sequence[str], to: str = "attributions", weight: str | None = None) -> DataFrame:
    """(class, feature, mean_abs, mean): over all rows that have attributions, each
    counting ``weight`` times, one grouping with map-side sums."""
    named: Column = F.get(F.array(*[F.lit(x) for x in names]), F.col("i"))
    times = F.col(weight) if weight else F.lit(1)
    rows = df.select(times.alias("n"), F.posexplode(to).alias("class", "a")).select("n", "class", F.posexplode("a").alias("i", "v"))
    mean = lambda v: F.sum(v * F.col("n")) / F.sum("n")
    return rows.groupBy("class", "i").agg(mean(F.abs("v")).alias("mean_abs"), mean(F.col("v")).alias("mean")).select("class", named.alias("feature"), "mean_abs", "mean")
