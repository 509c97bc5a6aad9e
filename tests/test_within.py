"""Sums over discs and the clusters made of them, against all pairs."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import neighbours as N
from tessera.operators.within import Within


def test_sums_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    x = np.unique(np.round(rng.normal(0, 4, (1500, 2)), 1), axis=0)  # many distances equal the radius
    w = rng.integers(0, 9, len(x)).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), float(n)) for i, (v, n) in enumerate(zip(x, w, strict=True))], "node long, x array<double>, n double")
    for radius, region in ((0.5, 64), (3.0, 64), (30.0, 64), (3.0, 4096)):
        discs = Within(df, 2, radius, region)
        got = {r["node"]: r["sum"] for r in discs.sums(discs.rows, F.col("n")).collect()}
        want = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= radius * radius
        assert [got[i] for i in range(len(x))] == (want @ w).tolist()


def test_many_copies_are_clustered_without_pairs(spark):
    """Two groups of copies, 20,000 rows each: 400 million pairs in all."""
    df = spark.range(40_000).select("id", (F.col("id") % 5 + F.when(F.col("id") < 20_000, 0).otherwise(100)).cast("double").alias("x"))
    more = df.unionByName(spark.createDataFrame([(-1, 50.0), (-2, None), (-3, float("nan"))], "id long, x double"))
    got = {r["at"]: (r["n"], r["cluster"]) for r in N.graph_clusters(more, "id", ["x"], 8.0, 2).groupBy((F.col("x") > 80).alias("at"), "cluster").agg(F.count("*").alias("n")).where("cluster is not null").collect()}
    assert got[False][0] == got[True][0] == 20_000 and got[False][1] != got[True][1]
    assert N.graph_clusters(more.where("id < 0"), "id", ["x"], 8.0, 2).where("cluster is null").count() == 3
