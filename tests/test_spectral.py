"""Eigenvectors of a neighbour graph against numpy, clusters of rings, odd tables."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import spectral


def test_eigenvectors_equal_a_dense_solve(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 1.0, (100, 2)) for c in ((0, 0), (4, 0), (2, 4))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, x double, y double")
    apart = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(apart, np.inf)
    near = np.zeros((300, 300))
    for i in range(300):
        near[i, np.lexsort((np.arange(300), apart[i]))[:8]] = 1
    w = (near + near.T) / 2
    root = np.sqrt(w.sum(axis=1))
    values, vectors = np.linalg.eigh(w / root[:, None] / root[None])
    links = spectral.affinity(df, "id", ["x", "y"], 8)
    dense = np.zeros((300, 300))
    for r in links.collect():
        dense[r["a"], r["b"]] = r["s"]
    assert np.allclose(dense, w / root[:, None] / root[None], atol=1e-12)
    found, theirs = spectral.eigenvectors(links.select("a", "b", "s"), 4)
    got = np.array([r["v"] for r in found.orderBy("node").collect()])
    assert got.shape == (300, 4) and np.allclose(theirs, values[::-1][:4], atol=1e-9)
    for j in range(4):
        want = vectors[:, -1 - j]
        assert np.allclose(got[:, j] * np.sign(got[:, j] @ want), want, atol=1e-5)


def test_rings_are_clusters_and_copies_stay_together(spark):
    """Two rings around each other, which no cut by centres can part; a position holds a third of the rows."""
    angle = np.linspace(0, 2 * np.pi, 80, endpoint=False)
    points = [(float(r * np.cos(a)), float(r * np.sin(a))) for r in (1.0, 6.0) for a in angle] + [(1.0, 0.0)] * 80
    df = spark.createDataFrame([(i, *p, i) for i, p in enumerate(points)] + [(900, None, 1.0, 0), (901, float("nan"), 1.0, 0)], "id long, x double, y double, node long")
    got = {r["id"]: r["cluster"] for r in spectral.spectral_clusters(df, "id", ["x", "y"], 2, 6).collect()}
    assert len(got) == 242 and got[900] is got[901] is None
    assert {got[i] for i in range(80)} == {0} == {got[i] for i in range(160, 240)} and {got[i] for i in range(80, 160)} == {80}


def test_few_rows(spark):
    schema = "id long, x double"
    assert spectral.spectral_clusters(spark.createDataFrame([], schema), "id", ["x"], 2).count() == 0
    assert [r["cluster"] for r in spectral.spectral_clusters(spark.createDataFrame([(4, 1.0), (5, 1.0)], schema), "id", ["x"], 2).collect()] == [4, 4]
    got = spectral.spectral_clusters(spark.createDataFrame([(i, float(i // 3 * 50 + i)) for i in range(6)], schema), "id", ["x"], 2, 2)
    assert {r["id"]: r["cluster"] for r in got.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}
    assert got.where(F.col("cluster").isNull()).isEmpty()


def test_products_send_no_vectors_through_the_driver(spark, monkeypatch):
    """A broadcast collects its side in the driver, in each of hundreds of products."""
    plans = []

    def ran(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    links = spark.createDataFrame([(a, b, 0.5) for a in range(20) for b in ((a + 1) % 20, (a - 1) % 20)], "a long, b long, s double")
    held = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)], "node long, v array<double>")
    monkeypatch.setattr(spectral, "settled", ran)
    got = {r["node"]: list(r["w"]) for r in spectral._product(links, held, 0, 2).collect()}
    assert got == {i: [1.0, ((i + 1) % 20 + (i - 1) % 20) / 2] for i in range(20)}
    assert all("Join" in p and "Broadcast" not in p for p in plans) and len(plans) == 1
