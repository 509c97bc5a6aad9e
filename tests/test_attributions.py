"""Shapley values of trees against all subsets of features, sums against predictions."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tessera.operators import attributions as A


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 4))
    x[:, 3] = rng.integers(0, 3, 400)
    y = (x[:, 0] * x[:, 1] > 0).astype(int) + (x[:, 3] == 1)
    df = spark.createDataFrame([(i, Vectors.dense(v.tolist()), float(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], ["id", "features", "label"])
    # A nominal column: its attribute makes the trees split it by categories.
    return df.withColumn("features", F.col("features").alias("features", metadata={"ml_attr": {"attrs": {"numeric": [{"idx": 0}, {"idx": 1}, {"idx": 2}], "nominal": [{"idx": 3, "vals": ["a", "b", "c"]}]}, "num_attrs": 4}}))


def by_subsets(trees, x):
    """Shapley values from the value of every set of features."""
    def value(known):
        total = 0.0
        for tree in trees:
            for leaf in tree:
                takes = dict(zip(leaf.sides, leaf.takes(x[None])[0], strict=True))
                total = total + leaf.value * np.prod([takes[f] if f in known else s for f, s in leaf.share.items()])
        return total / len(trees)

    n, out = len(x), []
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        out.append(sum(factorial(len(s)) * factorial(n - len(s) - 1) / factorial(n) * (value({*s, i}) - value(set(s))) for size in range(n) for s in combinations(rest, size)))
    return np.array(out).T


@pytest.mark.parametrize("make", [lambda: RandomForestClassifier(numTrees=5, maxDepth=6, seed=3), lambda: DecisionTreeClassifier(maxDepth=5, seed=3)])
def test_values_equal_all_subsets_and_add_up(spark, rows, make):
    model = make().fit(rows)
    trees = A.leaves(model, spark)
    got = A.attributed(model.transform(rows), model).orderBy("id").select("features", "probability", "attributions").collect()
    mean = A.mean_prediction(trees)
    assert len(mean) == 3 and abs(mean.sum() - 1) < 1e-9 and any(side[1] is not None for t in trees for leaf in t for s in leaf.sides.values() for side in s)
    for r in got:
        assert np.allclose(np.array(r["attributions"]).sum(axis=1), r["probability"].toArray() - mean, atol=1e-9)
    for r in got[:8]:
        assert np.allclose(np.array(r["attributions"]), by_subsets(trees, r["features"].toArray()), atol=1e-9)


def test_means_and_odd_rows(spark, rows):
    model = DecisionTreeClassifier(maxDepth=2, seed=3).fit(rows)
    more = rows.withColumn("i", F.lit(1)).withColumn("features", F.when(F.col("id") != 7, F.col("features")))
    got = A.attributed(more, model)
    assert got.where("attributions is null").count() == 1 and got.count() == 400 and A.attributed(more.limit(0), model).count() == 0
    mean = {(r["class"], r["feature"]): r["mean_abs"] for r in A.mean_attributions(got, ["p", "q", "r", "s"]).collect()}
    whole = np.array([r[0] for r in got.where("attributions is not null").select("attributions").collect()])
    assert len(mean) == 12 and all(np.isclose(mean[c, f], np.abs(whole[:, c, j]).mean()) for c in range(3) for j, f in enumerate("pqrs"))


def test_a_tree_of_one_leaf(spark):
    df = spark.createDataFrame([(Vectors.dense([1.0]), 1.0)] * 5, ["features", "label"])
    model = DecisionTreeClassifier().fit(df)
    assert [r[0] for r in A.attributed(df, model).select("attributions").distinct().collect()] == [[[0.0], [0.0]]]


@pytest.mark.parametrize("make", [lambda: RandomForestClassifier(numTrees=5, maxDepth=4, seed=3), lambda: DecisionTreeClassifier(maxDepth=5, seed=3)])
def test_patterns_have_the_means_of_all_rows(spark, rows, make):
    model = make().fit(rows)
    cut = next(s[2] for t in A.leaves(model, spark) for leaf in t for f, own in leaf.sides.items() for s in own if f == 0)
    odd = [Vectors.dense([cut, float("nan"), 0.0, 1.0]), Vectors.dense([float("inf"), float("-inf"), 0.0, 2.0]), None]
    more = rows.select("features").unionByName(spark.createDataFrame([(v,) for v in odd], rows.select("features").schema))
    more = more.crossJoin(spark.range(5)).select("features")
    found, names = A.patterns(more, model), ["p", "q", "r", "s"]
    assert found.agg(F.sum("n")).first()[0] == 5 * 402 and found.count() <= 402
    want = {tuple(r[:2]): r[2:] for r in A.mean_attributions(A.attributed(more, model), names).collect()}
    got = {tuple(r[:2]): r[2:] for r in A.mean_attributions(A.attributed(found, model), names, weight="n").collect()}
    assert want.keys() == got.keys() and all(np.allclose(want[k], got[k], atol=1e-12) for k in want)
