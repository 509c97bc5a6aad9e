"""Centroid clustering with Elkan's bounds, exact in whole numbers.

Components are floor(``scale`` * x), so distances, sums and centroids are whole
numbers and the result depends on no order of summation.  Every vector keeps,
from round to round, an upper bound of the distance to its centroid and a lower
bound for each centroid.  When centroids move, bounds move by the same distance;
a vector whose upper bound lies below half the distance from its centroid to the
next one is not looked at, and of the other centroids only those are measured
whose lower bound and half distance allow it.  Bounds are floating numbers
rounded outwards (up for upper, down for lower), and a centroid is passed over
only if it is strictly farther, so that ties go to the smaller number as
without bounds.  What is measured is measured in 64-bit integers.

A round is one pass over the written state (vector, cluster, bounds) that writes
the next state, and one grouping into a row a cluster; no vector is shuffled.
Centroids, k rows, are all that the driver holds.

Defined cases: vectors of another length, with a null or non-finite component or
null themselves are left out; with fewer vectors than ``k`` each starts a
cluster; equal ids are ordered by their components; a null id hashes as '';
equal starting centroids leave the larger number empty, and an empty cluster
keeps its centroid; repeated rows count each; no vectors give no rows; columns
besides id and vector are not read.  A component beyond ``MOST`` would overflow
a 64-bit distance and is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Components up to here keep squared distances of 64 components below 2^63.
MOST = 1 << 27


def up(x: np.ndarray) -> np.ndarray:
    """Two places up: one for the integer made floating, one for the operation."""
    return np.nextafter(np.nextafter(x, np.inf), np.inf)


def down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.nextafter(x, -np.inf), -np.inf), 0.0)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return (d * d).sum(axis=-1)


class Step:
    """What a pass needs of the centroids: where they are, how far each has moved
    (an upper bound), and half their distances (lower bounds)."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.centroids = centroids
        self.moved = up(np.sqrt(squared(centroids, centroids if before is None else before).astype(float)))
        self.half = down(np.sqrt(squared(centroids[:, None], centroids[None]).astype(float))) / 2
        apart = self.half + np.where(np.eye(len(centroids), dtype=bool), np.inf, 0.0)
        self.next = apart.min(axis=1)

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """New clusters, upper and lower bounds, and how many distances were measured."""
        cluster, upper, lower = cluster.copy(), up(upper + self.moved[cluster]), down(lower - self.moved)
        measured = np.zeros(len(x), np.int64)
        open_ = np.flatnonzero(~(upper < self.next[cluster]))
        best = np.zeros(len(x), np.int64)
        # The bound of a vector's own centroid is made tight before others are tried.
        own = squared(x[open_], self.centroids[cluster[open_]])
        best[open_], root = own, np.sqrt(own.astype(float))
        upper[open_], lower[open_, cluster[open_]] = up(root), down(root)
        measured[open_] += 1
        for j in range(len(self.centroids)):
            at = open_[(cluster[open_] != j)]
            at = at[~((upper[at] < lower[at, j]) | (upper[at] < self.half[cluster[at], j]))]
            d = squared(x[at], self.centroids[j])
            root = np.sqrt(d.astype(float))
            lower[at, j] = down(root)
            measured[at] += 1
            nearer = (d < best[at]) | ((d == best[at]) & (j < cluster[at]))
            won = at[nearer]
            cluster[won], best[won], upper[won] = j, d[nearer], up(root[nearer])
        return cluster, upper, lower, measured


def _whole(df: DataFrame, vec_id: str, vector: str, size: int, scale: int) -> DataFrame:
    number = F.transform(df[vector], lambda x: x.cast("double"))
    fine = (F.size(df[vector]) == size) & F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(number, lambda x: F.floor(F.lit(float(scale)) * x))
    checked = F.transform(scaled, lambda q: F.when(F.abs(q) <= MOST, q.cast("int")).otherwise(F.raise_error(F.lit(f"a component beyond {MOST}")).cast("int")))
    return df.where(fine).select(df[vec_id].alias("vec_id"), checked.alias("v"))


def cluster_vectors(df: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid,
    measured (distances of the vector that were computed in all passes)."""
    with Scratch(df.sparkSession) as scratch:
        state = _whole(df, vec_id, vector, size, scale)
        key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
        first = state.select("v", key.alias("h")).orderBy("h", "v").limit(k).collect()  # k rows
        if not first:
            empty = "cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>, measured long"
            return state.select("vec_id", *[F.lit(None).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in empty.split(", ")]).limit(0)
        centroids = np.array([r.v for r in first], np.int64)
        n = len(centroids)
        state = state.select("*", F.lit(0).alias("cluster"), F.lit(float("inf")).alias("upper"), F.array_repeat(F.lit(0.0), n).alias("lower"), F.lit(0).cast("long").alias("measured"))
        schema, before = state.schema, centroids
        for left in range(rounds, -1, -1):
            step = Step(centroids, before)

            def passed(batches: Iterator[pd.DataFrame], step: Step = step, last: bool = left == 0) -> Iterator[pd.DataFrame]:
                for rows in batches:
                    if not len(rows):
                        continue
                    x = np.stack(rows["v"].to_numpy()).astype(np.int64)
                    cluster, upper, lower, measured = step.assign(x, rows["cluster"].to_numpy(), rows["upper"].to_numpy(float), np.stack(rows["lower"].to_numpy()))
                    rows = rows.assign(cluster=cluster, measured=rows["measured"] + measured)
                    if last:
                        yield rows[["vec_id", "cluster", "measured"]].assign(distance=squared(x, step.centroids[cluster]))
                    else:
                        yield rows.assign(upper=upper, lower=list(lower))

            if left == 0:
                kind = df.schema[vec_id].dataType.simpleString()
                out = scratch.keep(scratch.write(state.mapInPandas(passed, f"vec_id {kind}, cluster int, measured long, distance long"), "clusters"))
                break
            old, state = state, scratch.write(state.mapInPandas(passed, schema), "state")
            if left < rounds:
                scratch.drop(old)
            sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.get("v", F.lit(i)).cast("decimal(20,0)")).alias(f"s{i}") for i in range(size)]).collect()  # k rows
            before, centroids = centroids, centroids.copy()
            for r in sums:
                centroids[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(size)]
        inertia = {r.cluster: int(r.d) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    of = df.sparkSession.createDataFrame([(j, inertia[j], [int(x) for x in centroids[j]]) for j in sorted(inertia)], "c int, cluster_inertia long, centroid array<long>")
    joined = out.join(F.broadcast(of), F.col("cluster") == F.col("c"))  # k rows
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(inertia.values())).cast("long").alias("inertia"), "centroid", "measured")
