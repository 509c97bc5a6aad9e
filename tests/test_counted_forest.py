"""A forest over counts of binned rows: cuts, counts, draws and what it learns."""

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from tessera.operators import attributions as A
from tessera.operators import learning as M
from tessera.operators import quantiles as Q
from tessera.plans import statistics


def test_cuts_part_any_numbers_evenly(spark):
    rng, n = np.random.default_rng(4), 6_000
    columns = {
        "few": rng.integers(-2, 3, n) / 10,
        "many": rng.exponential(1e-300, n) * rng.choice([-1, 1], n),
        "late": np.where(rng.random(n) < 0.3, 0.0, 1.7e9 + rng.random(n)),  # all but the zeros begin alike
        "ends": np.r_[[np.inf, -np.inf, 1e308, -1e308], rng.normal(size=n - 4)],
        "one": np.full(n, 7.5),
        "none": np.full(n, np.nan),
    }
    rows = [tuple(None if i % 50 == 1 else float(v) for v in r) for i, r in enumerate(zip(*columns.values(), strict=True))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(3)
    got = dict(zip(columns, Q.cuts(df, list(columns), 8), strict=True))
    assert got == dict(zip(columns, Q.cuts(df.repartition(7), list(columns), 8), strict=True))
    assert got["few"] == [-0.2, -0.1, 0.0, 0.1] and got["one"] == got["none"] == []
    for c in ("many", "late", "ends"):
        own = np.array([r[list(columns).index(c)] for r in rows if r[0] is not None])
        sizes = np.bincount(np.searchsorted(got[c], own))
        assert set(got[c]) <= set(own.tolist()) and len(sizes) <= 8 and (sizes <= 1.5 * len(own) / 8).sum() >= len(sizes) - (c == "late")
    assert Q.cuts(df.limit(0), ["few", "one"]) == [[], []]


def test_the_forest_reads_counts_however_many_the_lines(spark, tmp_path, monkeypatch):
    columns = ["id % 5 AS l_quantity", "id % 7 * 1.5 AS l_extendedprice", "0.1 AS l_discount", "id % 2 * 0.02 AS l_tax", "element_at(array('A', 'N', 'R'), int(id % 3) + 1) AS l_returnflag"]
    spark.range(4_200).selectExpr(*columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    fit, read = RandomForestClassifier.fit, []
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, df, *a: (read.append(df.count()), fit(self, df, *a))[1])
    got = statistics.feature_attributions(spark, str(tmp_path)).collect()
    assert max(read) <= 5 * 7 * 2 * 3 < 4_200 and len(got) == 12
    rows = spark.read.parquet(f"{tmp_path}/lineitem.parquet").withColumn("label", F.lit(0.0)).withColumn("l_tax", F.when(F.col("l_tax") > 0, F.col("l_tax")))
    found = M.counted(rows, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    assert found.agg(F.sum("n")).first()[0] == 4_200 and found.count() == 70
    assert sorted(set(v for r in found.collect() for v in r["features"].toArray()[3:])) == [0.0, 1.0]  # a missing number is above all


def test_draws_are_a_bootstrap_for_any_partitioning(spark):
    df = M.counted(spark.range(60_000).selectExpr("id % 1000 AS x", "id % 2 AS y", "0.0 AS label"), ["x", "y"], bins=1000)
    got = M.drawn(df, 8, 3)
    again = M.drawn(df.repartition(5), 8, 3)
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect())) and df.count() == 1000
    draws = np.array([r["draws"] for r in got.collect()])
    assert abs(draws.mean() - 60) < 0.5 and 54 < draws.var() < 66 and abs(np.corrcoef(draws.T) - np.eye(8)).max() < 0.15


def test_the_forest_learns_as_one_of_rows_does(spark):
    rng = np.random.default_rng(7)
    x = rng.random((6_000, 3))
    label = ((x[:, 0] > 0.4) & (x[:, 1] > 0.3)).astype(float) + (x[:, 0] > 0.8)
    df = spark.createDataFrame([(*map(float, v), float(c)) for v, c in zip(x, label, strict=True)], "a double, b double, c double, label double")
    names, counts = ["a", "b", "c"], M.counted(df, ["a", "b", "c"])
    forest = A.forest(M.forest_of_counts(counts, 16, 4, seed=1), spark)
    assert len(forest.trees) == 16 and forest[1:] == (3, 3)
    mean = lambda rows, model: {tuple(r[:2]): r[2] for r in A.mean_attributions(A.attributed(A.patterns(rows, model, weight="n" if "n" in rows.columns else None), model), names, weight="n").collect()}
    rows = M.vectors(df.select(F.array(*names).alias("x"), "label"), "x")
    got, want = mean(counts, forest), mean(rows, RandomForestClassifier(numTrees=16, maxDepth=4, seed=1).fit(rows))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 0.05 for k in want) and max(want.values()) > 0.2
