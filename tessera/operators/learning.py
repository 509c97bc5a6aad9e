"""Models by ``pyspark.ml`` (ML-16..48, 53)."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, Bucketizer, Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import cuts
from .stages import settled
from .statistics import weighted_scores

BINS = 32  # of a column, as many as a forest's ``maxBins``
FITS = 4  # trees grown at a time
PART = 1 << 20  # rows of a partition that a forest keeps in memory


def vectors(df: DataFrame, column: str, to: str = "features") -> DataFrame:
    """An array column as a vector."""
    return df.withColumn(to, array_to_vector(F.col(column).cast("array<double>")))


def principal_components(df: DataFrame, k: int, features: str = "features", to: str = "pc") -> DataFrame:
    """ML-16, 17: centred principal components; signs are arbitrary."""
    centred = StandardScaler(inputCol=features, outputCol="__c", withMean=True, withStd=False).fit(df).transform(df)
    out = PCA(k=k, inputCol="__c", outputCol="__p").fit(centred).transform(centred)
    return out.withColumn(to, vector_to_array("__p")).drop("__c", "__p")


def loadings(df: DataFrame, k: int, features: str = "features") -> DataFrame:
    """ML-17: component, feature (both from 0), loading and rank: features by their
    weight in each of k principal components, largest first, of equals the first
    feature; a component's sign is such that its largest weight is positive.  The
    rows are the model's, as many as features times k."""
    model = PCA(k=k, inputCol=features, outputCol="__p").fit(df)
    rows = []
    for c, column in enumerate(model.pc.toArray().T):
        order = sorted(range(len(column)), key=lambda f: (-abs(column[f]), f))
        sign = -1.0 if column[order[0]] < 0 else 1.0
        rows += [(c, f, float(sign * column[f]), rank) for rank, f in enumerate(order, 1)]
    return df.sparkSession.createDataFrame(rows, "component int, feature int, loading double, rank int")


def clusters(df: DataFrame, k: int, how: str = "kmeans", seed: int = 1, features: str = "features", to: str = "cluster") -> DataFrame:
    """ML-22, 24, 26: k-means, bisecting (in place of agglomerative) or Gaussian mixture."""
    model = {"kmeans": KMeans, "bisecting": BisectingKMeans, "gaussian": GaussianMixture}[how](k=k, seed=seed, featuresCol=features, predictionCol=to)
    return model.fit(df).transform(df)


def best_k(df: DataFrame, ks: Sequence[int], seed: int = 1, features: str = "features") -> tuple[int, float]:
    """ML-23, 28, 30: the number of clusters with the best silhouette."""
    score = ClusteringEvaluator(featuresCol=features, predictionCol="cluster")
    return max(((k, score.evaluate(clusters(df, k, "kmeans", seed, features))) for k in ks), key=lambda x: x[1])


def classifier(name: str, label: str = "label", features: str = "features", seed: int = 1):
    """ML-37: a classifier by name; two-class ones are wrapped one against the rest."""
    made = {
        "logistic": lambda: LogisticRegression(labelCol=label, featuresCol=features),
        "tree": lambda: DecisionTreeClassifier(labelCol=label, featuresCol=features, seed=seed),
        "forest": lambda: RandomForestClassifier(labelCol=label, featuresCol=features, seed=seed),
        "boosting": lambda: OneVsRest(classifier=GBTClassifier(maxIter=10, seed=seed), labelCol=label, featuresCol=features),
        "svm": lambda: OneVsRest(classifier=LinearSVC(maxIter=50), labelCol=label, featuresCol=features),
    }
    if name not in made:
        raise ValueError(f"unknown classifier {name!r}")
    return made[name]()


def split(df: DataFrame, key: str, test_share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """ML-40: a split that depends on the keys and the seed only."""
    part = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(10_000)) < int(10_000 * test_share)
    return df.where(~part), df.where(part)


def folds(df: DataFrame, key: str, by: str, k: int, seed: int) -> DataFrame:
    """ML-39: stratified folds: dealt in turn within each class, in hashed order.

    A class may be large, so its places are those within one of 4,096 ranges of
    the hash plus the counts of the ranges before (4,096 rows a class at most)."""
    from pyspark.sql import Window

    hashed = df.withColumn("__h", F.xxhash64(F.lit(seed), F.col(key))).withColumn("__b", F.shiftright("__h", 52))
    earlier = Window.partitionBy("__c").orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)
    starts = hashed.groupBy(F.col(by).alias("__c"), F.col("__b").alias("__d")).count().withColumn("__s", F.coalesce(F.sum("count").over(earlier), F.lit(0))).drop("count")
    place = F.row_number().over(Window.partitionBy(by, "__b").orderBy("__h", key))
    placed = hashed.withColumn("__p", place).join(starts, F.col(by).eqNullSafe(F.col("__c")) & (F.col("__b") == F.col("__d")))
    return placed.withColumn("fold", ((F.col("__p") + F.col("__s")) % k).cast("int")).select(*df.columns, "fold")


def comparison(train: DataFrame, test: DataFrame, names: Sequence[str], label: str = "label") -> DataFrame:
    """ML-37, 42: weighted scores of several classifiers on the same split."""
    out = None
    for name in names:
        scores = weighted_scores(classifier(name, label).fit(train).transform(test), label, "prediction").withColumn("classifier", F.lit(name))
        out = scores if out is None else out.unionByName(scores)
    return out


def in_parts(df: DataFrame, rows: int = PART) -> DataFrame:
    """A table of more than ``rows`` rows in partitions of about as many, dealt by row
    number and in that order.  A forest keeps every partition of its input as one block
    of objects, several times the size of a file's columns."""
    parts = -(-df.count() // rows)
    if parts <= 1:
        return df
    return df.withColumn("__row", F.monotonically_increasing_id()).repartition(parts, "__row").sortWithinPartitions("__row").drop("__row")


def counted(df: DataFrame, columns: Sequence[str], label: str = "label", bins: int = BINS) -> DataFrame:
    """(features, label, n): the rows of ``df`` counted by the part of each column that they
    lie in (see ``cuts``) and by their label.

    A forest only learns from a column by such parts (its ``maxBins``), so the counts hold
    all it needs, and they are at most ``bins`` to the power of the columns for each label,
    however many rows.  A part's number stands for its numbers; a missing number is above all."""
    names = [f"__b{i}" for i in range(len(columns))]
    rows = df.select(*[F.col(c).cast("double").alias(f"__v{i}") for i, c in enumerate(columns)], F.col(label).alias("label"))
    for i, (name, ends) in enumerate(zip(names, cuts(df, columns, bins), strict=True)):
        # An end is in its part, a bucket's least number is in the bucket.
        splits = [-np.inf, *[float(np.nextafter(c, np.inf)) for c in ends], np.inf]
        if ends:
            rows = Bucketizer(splits=splits, inputCol=f"__v{i}", outputCol=name, handleInvalid="keep").transform(rows)
        else:
            rows = rows.withColumn(name, F.when(F.col(f"__v{i}").isNull() | F.isnan(f"__v{i}"), 1.0).otherwise(0.0))
    return settled(rows.groupBy(*names, "label").agg(F.count("*").alias("n")).select(array_to_vector(F.array(*names)).alias("features"), "label", "n"))


def drawn(df: DataFrame, trees: int, seed: int, to: str = "draws") -> DataFrame:
    """A table of ``counted`` with how often each tree's bootstrap draws its rows: a row is
    drawn as often as a Poisson number of mean 1 says, as in a forest, so n rows together as
    often as one of mean n.  Depends on features, label and seed alone."""

    @F.pandas_udf("array<double>")
    def draw(key: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng([seed, k & (2**64 - 1)]).poisson(m, trees).astype(float) for k, m in zip(key.tolist(), n.tolist(), strict=True)], dtype=object)

    return df.withColumn(to, draw(F.xxhash64(vector_to_array("features"), "label"), "n"))


def forest_of_counts(df: DataFrame, trees: int, depth: int, seed: int) -> list[RandomForestClassificationModel]:
    """The trees of a random forest over a table of ``counted``, as one model each."""
    rows = settled(drawn(df, trees, seed))

    def grow(t: int) -> RandomForestClassificationModel:
        forest = RandomForestClassifier(numTrees=1, maxDepth=depth, seed=seed + t, weightCol="w", bootstrap=False, featureSubsetStrategy="sqrt")
        return forest.fit(rows.withColumn("w", F.get("draws", F.lit(t))))

    with ThreadPool(FITS) as pool:
        return pool.map(inheritable_thread_target(df.sparkSession)(grow), range(trees))


def importances(train: DataFrame, columns: Sequence[str], label: str = "label", seed: int = 1) -> list[tuple[str, float]]:
    """ML-36, AGG-47: forest importances in falling order."""
    model = RandomForestClassifier(labelCol=label, seed=seed).fit(VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip").transform(in_parts(train)))
    return sorted(zip(columns, model.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def scoring_pipeline(train: DataFrame, columns: Sequence[str], label: str, name: str = "forest") -> PipelineModel:
    """ML-45, 47, 48: median imputation, scaling, label indexing and a classifier as one model."""
    filled = [f"__{c}" for c in columns]
    return Pipeline(stages=[
        Imputer(strategy="median", inputCols=list(columns), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="__v"),
        StandardScaler(inputCol="__v", outputCol="features", withMean=True),
        StringIndexer(inputCol=label, outputCol="__label", handleInvalid="keep"),
        classifier(name, "__label"),
    ]).fit(train)


def self_trained(labelled: DataFrame, unlabelled: DataFrame, name: str, confident: float, rounds: int) -> DataFrame:
    """ML-38: confident predictions on unlabelled rows join the training rows, for some rounds."""
    pool = labelled.select("label", "features")
    for _ in range(rounds):
        said = classifier(name).fit(pool).transform(unlabelled)
        sure = said.where(F.array_max(vector_to_array("probability")) >= confident).select(F.col("prediction").alias("label"), "features")
        pool = settled(labelled.select("label", "features").unionByName(sure))  # else every round fits all earlier ones again
    return classifier(name).fit(pool).transform(unlabelled)
