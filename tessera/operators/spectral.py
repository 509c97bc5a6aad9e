"""Spectral clustering: eigenvectors of a neighbour graph by block Lanczos steps.

A product of the graph's matrix with a block of vectors is a join of its links
with the nodes and a grouping with map-side sums.  Every step adds the product
to the basis, freed of what the basis holds already, and after ``STEPS`` of them
the best vectors inside the basis start the next cycle, until what a product
leaves over is below a tolerance.  Only matrices of basis by basis, at most
``STEPS`` times the block wide, reach the driver; vectors stay distributed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nearest import neighbour_graph
from .stages import settled

STEPS = 8  # products of a cycle
MORE = 4  # vectors of a block beyond those asked for


def affinity(df: DataFrame, key: str, columns: Sequence[str], k: int) -> DataFrame:
    """(a, b, s, d) of the symmetric graph of ``k`` nearest neighbours: a link weighs 1
    if both rows name each other and 1/2 if one does, s is that over the root of both
    rows' sums of weights, and d is that sum of a."""
    near = neighbour_graph(df, key, columns, k).select("a", "b")
    links = settled(near.union(near.select("b", "a")).groupBy("a", "b").agg((F.count("*") / 2).alias("w")))
    sums = links.groupBy("a").agg(F.sum("w").alias("d"))
    weighed = links.join(sums, "a").join(sums.select(F.col("a").alias("b"), F.col("d").alias("e")), "b")
    return settled(weighed.select("a", "b", (F.col("w") / F.sqrt(F.col("d") * F.col("e"))).alias("s"), "d"))


def _product(links: DataFrame, held: DataFrame, first: int, size: int) -> DataFrame:
    """(node, v, w): w is the matrix times columns ``first`` to ``first + size`` of v.
    Vectors are never broadcast: there are hundreds of products, and each would send
    its vectors through the driver."""
    part = held.select(F.col("node").alias("b"), F.slice("v", first + 1, size).alias("x")).hint("merge")
    summed = links.join(part, "b").groupBy("a").agg(F.array(*[F.sum(F.col("s") * F.col("x")[i]) for i in range(size)]).alias("w"))
    return settled(held.join(summed.withColumnRenamed("a", "node").hint("merge"), "node"))


def _gram(df: DataFrame, column: Column, size: int) -> np.ndarray:
    """Sums of products of all pairs of entries, one small matrix a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_list())
                total += x.T @ x
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "g": total.ravel()})

    got = df.select(column.alias("x")).mapInPandas(run, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).toPandas()
    out = np.zeros((size, size))
    out[got["i"], got["j"]] = got["g"]
    return (out + out.T) / 2


def _combined(column: Column, matrix: np.ndarray) -> Column:
    """The array ``column``, a row vector, times a matrix."""

    @F.pandas_udf("array<double>")
    def times(rows: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(rows.to_list()) @ matrix)) if len(rows) else pd.Series([], dtype=object)

    return times(column)


def _unit(gram: np.ndarray) -> np.ndarray:
    """Combinations that are orthonormal under a Gram matrix, without those that vanish."""
    values, vectors = np.linalg.eigh(gram)
    keep = values > 1e-11 * max(values.max(), 1e-300)
    return vectors[:, keep] / np.sqrt(values[keep])


def eigenvectors(links: DataFrame, k: int, tolerance: float = 1e-6, most: int = 40) -> tuple[DataFrame, np.ndarray]:
    """(node, v) with the ``k`` entries of the eigenvectors of the largest eigenvalues
    of the symmetric matrix (a, b, s), and these values, largest first; fewer if there
    are fewer nodes.  At most ``most`` cycles.  An empty matrix has no rows."""
    size = k + MORE
    seeds = [F.xxhash64("node", F.lit(i)) / F.lit(float(1 << 63)) for i in range(size)]
    held = links.select(F.col("a").alias("node")).distinct().select("node", F.array(*seeds).alias("v"))
    held = settled(held)
    found = np.zeros(0)
    if held.isEmpty():
        return held, found
    start = _unit(_gram(held, F.col("v"), size))
    held, size = held.select("node", _combined(F.col("v"), start).alias("v")), start.shape[1]
    for cycle in range(most + 1):
        first, width = 0, size
        h = np.zeros((0, 0))
        for step in range(STEPS):
            both = _product(links, held, first, width)
            n = first + width
            g = _gram(both, F.concat("v", "w"), n + width)
            own, cross, left = g[:n, :n], g[:n, n:], g[n:, n:]
            if step == 0 and cycle:
                over = np.sqrt(np.maximum(np.diag(left) - np.diag(cross) ** 2, 0))[:k]
                if cycle == most or over.max() <= tolerance:
                    return both.select("node", F.slice("v", 1, k).alias("v")), found[:k]
            h = np.pad(h, (0, n - len(h)))
            h[:, first:n], h[first:n, :] = cross, cross.T
            taken = np.linalg.solve(own, cross)
            rest = left - cross.T @ taken
            values, vectors = np.linalg.eigh((rest + rest.T) / 2)
            keep = values > 1e-12
            held = both
            if step == STEPS - 1 or not keep.any():
                break
            new = vectors[:, keep] / np.sqrt(values[keep])
            held = both.select("node", F.concat("v", _combined(F.concat("v", "w"), np.vstack([-taken @ new, new]))).alias("v"))
            first, width = n, int(keep.sum())
        unit = _unit(own)
        values, inner = np.linalg.eigh(unit.T @ h @ unit)
        order = np.argsort(-values)[:size]
        found, size = values[order], len(order)
        held = held.select("node", _combined(F.col("v"), unit @ inner[:, order]).alias("v"))
    raise AssertionError("unreachable")


def spectral_clusters(df: DataFrame, key: str, columns: Sequence[str], clusters: int, k: int = 10, seed: int = 1) -> DataFrame:
    """ML-49: ``df`` with ``cluster``, the smallest key of the row's cluster.

    Rows at one position are one node, named by the smallest key, so that copies make
    no hub.  Nodes are linked with their ``k`` nearest, and k-means splits the graph's
    first eigenvectors, each entry over the root of its node's sum of weights.  Rows with
    a null or NaN coordinate get null; a table of one position is one cluster."""
    known = df.select(F.col(key).alias("node"), *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double") + F.lit(0.0)).alias(f"p{i}") for i, c in enumerate(columns)])
    p = [f"p{i}" for i in range(len(columns))]
    nodes = settled(known.dropna(subset=p).groupBy(*p).agg(F.min("node").alias("node")))
    links = affinity(nodes, "node", p, k)
    vectors, _ = eigenvectors(links.select("a", "b", "s"), clusters)
    if vectors.isEmpty():
        named = nodes.withColumn("cluster", F.col("node"))
    else:
        weights = links.select(F.col("a").alias("node"), "d").distinct()
        spread = settled(vectors.join(weights, "node").select("node", array_to_vector(F.transform("v", lambda x: x / F.sqrt("d"))).alias("features")))
        found = KMeans(k=clusters, seed=seed, maxIter=50).fit(spread).transform(spread).select("node", "prediction")
        least = found.groupBy("prediction").agg(F.min("node").alias("cluster"))
        named = nodes.join(found, "node").join(least, "prediction")
    place = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double") + F.lit(0.0)) for c in columns]
    out = df.withColumns({f"__q{i}": x for i, x in enumerate(place)})
    named = named.select(*[F.col(x).alias(f"__{x}") for x in p], F.col("cluster").alias("__cluster"))
    same = [F.col(f"__q{i}") == F.col(f"__p{i}") for i in range(len(p))]
    return out.join(named, same, "left").select(*[df[c] for c in df.columns], F.col("__cluster").alias("cluster"))
