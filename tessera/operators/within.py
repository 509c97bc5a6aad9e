"""Sums over all rows within a radius, without pairs of rows.

Weighed positions are dealt to the regions of a k-d partition, as for the nearest
neighbours.  A region that lies wholly within the radius of another, by their boxes,
gives it one number, its sum; only regions that the radius cuts meet row by row, and
inside a task their leaves are told apart in the same way.  What is compared row by
row is therefore what lies about the rim, and nothing is kept of it but sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nearest import LEAF, MOST, SAMPLE, Cells, box_distances, numbers_of
from .stages import settled

REGION = 4096  # positions of a region


def far_corners(low: np.ndarray, high: np.ndarray, x_low: np.ndarray, x_high: np.ndarray) -> np.ndarray:
    """Largest squared distances between boxes (rows) and boxes (columns)."""
    d = np.zeros((len(x_low), len(low)))
    for c in range(low.shape[1]):
        gap = np.maximum(np.abs(x_low[:, c, None] - high[None, :, c]), np.abs(x_high[:, c, None] - low[None, :, c]))
        d += gap * gap
    return d


def near_sides(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least squared distances between all pairs of boxes."""
    d = np.zeros((len(low), len(low)))
    for c in range(low.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, c] - high[:, c, None], low[:, c, None] - high[None, :, c]), 0.0)
        d += gap * gap
    return d


def disc_sums(asked: np.ndarray, at: np.ndarray, weight: np.ndarray, reach: float, leaf: int = LEAF) -> np.ndarray:
    """For each of ``asked`` the sum of ``weight`` over the rows of ``at`` whose squared
    distance is at most ``reach``."""
    out = np.zeros(len(asked))
    if not len(at) or not len(asked):
        return out
    mine = Cells(at, -(-len(at) // leaf)).of(at)
    order = np.argsort(mine, kind="stable")
    at, weight = at[order], weight[order]
    first = np.flatnonzero(np.r_[True, np.diff(mine[order]) > 0])
    low, high, total = np.minimum.reduceat(at, first), np.maximum.reduceat(at, first), np.add.reduceat(weight, first)
    whole = far_corners(low, high, asked, asked) <= reach
    cut = ~whole & (box_distances(asked, low, high) <= reach)
    out += whole @ total
    for i, (start, end) in enumerate(zip(first, np.r_[first[1:], len(at)], strict=True)):
        rows = np.flatnonzero(cut[:, i])
        for part in np.array_split(rows, -(-len(rows) * int(end - start) // 1_000_000) or 1):
            d = np.zeros((len(part), end - start))
            for c in range(at.shape[1]):
                d += (asked[part, c, None] - at[start:end, c]) ** 2
            out[part] += (d <= reach) @ weight[start:end]
    return out


class Within:
    """The discs of positions (node, x array<double>, and more), dealt once for several
    sums; ``rows`` are the positions with their region."""

    def __init__(self, nodes: DataFrame, dims: int, radius: float, region: int = REGION):
        self.reach, self.dims = float(radius) * float(radius), dims
        n = nodes.count()
        share = max(1, n // SAMPLE)
        sample = numbers_of(nodes.where(F.pmod(F.xxhash64("x"), F.lit(share)) == 0), "x", dims)
        cells = Cells(sample, min(MOST, max(1, -(-n // region))))

        @F.pandas_udf("int")
        def region_of(x: pd.Series) -> pd.Series:
            return pd.Series(cells.of(np.array(x.tolist(), float).reshape(-1, dims)), dtype="int32")

        self.rows = settled(nodes.withColumn("region", region_of("x")))
        corners = [f(F.get("x", F.lit(c))).alias(f"{s}{c}") for c in range(dims) for s, f in (("low", F.min), ("high", F.max))]
        boxes = self.rows.groupBy("region").agg(*corners).orderBy("region").toPandas()  # MOST rows
        self.ids = boxes["region"].to_numpy(np.int32)
        low, high = (boxes[[f"{s}{c}" for c in range(dims)]].to_numpy(float) for s in ("low", "high"))
        self.whole = far_corners(low, high, low, high) <= self.reach
        to, met = np.nonzero(~self.whole & (near_sides(low, high) <= self.reach))
        pairs = pd.DataFrame({"to": self.ids[to], "region": self.ids[met]})
        self.meets = settled(nodes.sparkSession.createDataFrame(pairs, "to int, region int"))

    def sums(self, rows: DataFrame, weight: Column, to: str = "sum") -> DataFrame:
        """``rows``, which are this object's with any further columns, each with the sum
        of ``weight`` over its disc."""
        dims, reach = self.dims, self.reach
        held = rows.withColumn("__w", weight)
        totals = held.groupBy("region").agg(F.sum("__w").alias("w")).toPandas().set_index("region")["w"]  # MOST rows
        given = dict(zip(self.ids.tolist(), (self.whole @ totals.reindex(self.ids).to_numpy(float)).tolist(), strict=True))

        def met(asked: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
            points = lambda x: np.array(x.tolist(), float).reshape(-1, dims)
            return pd.DataFrame({"node": asked["asker"], "s": disc_sums(points(asked["q"]), points(at["x"]), at["__w"].to_numpy(float), reach)})

        @F.pandas_udf("double")
        def from_whole(region: pd.Series) -> pd.Series:
            return region.map(given)

        meets = F.broadcast(self.meets)
        other = F.broadcast(self.meets.select(F.col("to").alias("other"), F.col("region").alias("own")))
        asked = held.select(F.col("node").alias("asker"), F.col("x").alias("q"), F.col("region").alias("to")).join(meets, "to")
        dealt = held.select(F.col("x").alias("x"), "__w", F.col("region").alias("own")).join(other, "own")
        schema = f"node {rows.schema['node'].dataType.simpleString()}, s double"
        rim = asked.groupBy("to", "region").cogroup(dealt.groupBy("other", "own")).applyInPandas(met, schema).groupBy("node").agg(F.sum("s").alias("__s"))
        out = rows.join(rim, "node", "left").withColumn(to, F.coalesce("__s", F.lit(0.0)) + from_whole("region"))
        return settled(out.select(*rows.columns, to))
