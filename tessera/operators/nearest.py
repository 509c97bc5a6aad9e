"""Exact nearest neighbours by equality joins on the regions of a k-d partition.

The plane of ``columns`` is cut at medians into regions of about ``REGION``
positions.  The cuts come from a bounded sample and only decide how well work is
balanced; every row is dealt to a region and the answer is exact.  Queries meet
the rows of their own region first, which proves an upper bound of the k-th
distance, and then only the regions whose bounding box that bound reaches.
Inside a task rows are cut into leaves in the same way, so that a query is
compared with the rows of a few leaves, however many rows there are.

Rows at one position are alike to every query, so only the first k of them, by
``order``, take part: a position that holds a third of all rows costs k.
Queries are distinct positions too, and a region with many of them is searched
in blocks, each with the region's rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import settled

REGION = 8192  # positions of a region, and queries of a block
MOST = 4096  # regions, whose boxes every task holds; beyond it they grow
SAMPLE = 1 << 16  # positions from which the cuts are made
LEAF = 128  # positions of a leaf inside a task


class Cells:
    """A binary tree of cuts at medians, across the widest column each."""

    def __init__(self, x: np.ndarray, leaves: int):
        self.depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
        inner = (1 << self.depth) - 1
        self.column, self.cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        parts = {0: np.arange(len(x))}
        for node in range(inner):
            rows = parts.pop(node, None)
            if rows is None or len(rows) < 2:
                continue
            spread = x[rows].max(axis=0) - x[rows].min(axis=0)
            c = int(spread.argmax())
            if spread[c] > 0:
                values = x[rows, c]
                cut = np.partition(values, (len(rows) - 1) // 2)[(len(rows) - 1) // 2]
                if cut == values.max():  # most are equal to the largest: all others go left
                    cut = values[values < cut].max()
                self.column[node], self.cut[node] = c, cut
                left = values <= cut
                parts[2 * node + 1], parts[2 * node + 2] = rows[left], rows[~left]

    def of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row of x."""
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.column[node]] > self.cut[node])
        return node - ((1 << self.depth) - 1)


def box_distances(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least squared distances (rows, boxes) between x and boxes."""
    d = np.zeros((len(x), len(low)))
    for c in range(x.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, c] - x[:, c, None], x[:, c, None] - high[None, :, c]), 0.0)
        d += gap * gap
    return d


def search(at: np.ndarray, asked: np.ndarray, bound: np.ndarray, k: int, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of ``at`` to each of ``asked`` no farther than ``bound``
    (squared), of equals the first in ``at``: squared distances and places, and
    with how many rows each was compared.  Where there are fewer, the distance is
    infinite and the place that after the last."""
    m, n = len(asked), len(at)
    best, place, compared = np.full((m, k), np.inf), np.full((m, k), n, np.int64), np.zeros(m, np.int64)
    if not n or not m:
        return best, place, compared
    cells = Cells(at, -(-n // leaf))
    mine, home = cells.of(at), cells.of(asked)
    order = np.argsort(mine, kind="stable")
    used, first = np.unique(mine[order], return_index=True)
    low, high = np.minimum.reduceat(at[order], first), np.maximum.reduceat(at[order], first)
    groups = dict(zip(used.tolist(), np.split(order, first[1:]), strict=True))

    def meet(rows: np.ndarray, members: np.ndarray) -> None:
        for part in np.array_split(rows, -(-len(rows) * len(members) // 1_000_000) or 1):
            d = np.zeros((len(part), len(members)))
            for c in range(at.shape[1]):
                d += (asked[part, c, None] - at[members, c]) ** 2
            d[d > bound[part, None]] = np.inf
            d, where = np.hstack([best[part], d]), np.hstack([place[part], np.broadcast_to(members, d.shape)])
            by = np.argsort(where, axis=1, kind="stable")
            d, where = np.take_along_axis(d, by, 1), np.take_along_axis(where, by, 1)
            by = np.argsort(d, axis=1, kind="stable")[:, :k]
            best[part], place[part] = np.take_along_axis(d, by, 1), np.take_along_axis(where, by, 1)
            compared[part] += len(members)

    by_home = np.argsort(home, kind="stable")
    for rows in np.split(by_home, np.flatnonzero(np.diff(home[by_home])) + 1):
        if home[rows[0]] in groups:
            meet(rows, groups[home[rows[0]]])
    for i, leaf_id in enumerate(used.tolist()):
        reach = box_distances(asked, low[i : i + 1], high[i : i + 1])[:, 0]
        rows = np.flatnonzero((home != leaf_id) & (reach <= np.minimum(best[:, -1], bound)))
        if len(rows):
            meet(rows, groups[leaf_id])
    place[np.isinf(best)] = n
    return best, place, compared


def numbers_of(df: DataFrame, column: str, dims: int) -> np.ndarray:
    """The arrays of a bounded number of rows as a matrix."""
    return np.array(df.select(column).toArrow()[column].to_pylist(), float).reshape(-1, dims)


def _vector(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def nearest(queries: DataFrame, points: DataFrame, columns: Sequence[str], order: Sequence[str], k: int, region: int = REGION) -> DataFrame:
    """For each distinct position q (array of double) of ``queries``: its k nearest
    rows of ``points``, of equally near ones the first by ``order``.

    Returns q, the columns of ``order``, d (squared distance), rank (from 1) and
    compared (rows that q was compared with, over all regions).  Rows with a null
    or non-finite number in ``columns`` take no part.  Repeated rows count each.
    """
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # Positive and negative zero are one position.
    asked = queries.select(_vector(columns).alias("x")).where(fine).select(F.transform("x", lambda v: v + 0.0).alias("x")).distinct()
    asked = settled(asked)
    names = [f"o{i}" for i in range(len(order))]
    rows = points.select(_vector(columns).alias("x"), *[F.col(c).alias(n) for c, n in zip(order, names, strict=True)]).where(fine).withColumn("x", F.transform("x", lambda v: v + 0.0))
    first = F.row_number().over(Window.partitionBy("x").orderBy(*names))
    rows = settled(rows.withColumn("first", first).where(F.col("first") <= k).drop("first"))

    n = rows.count()
    kinds = {n: points.schema[c].dataType.simpleString() for c, n in zip(order, names, strict=True)}
    if n == 0:
        nothing = "q array<double>, " + ", ".join(f"`{c}` {t}" for c, t in zip(order, kinds.values(), strict=True))
        return points.sparkSession.createDataFrame([], f"{nothing}, d double, rank int, compared long")
    share = max(1, n // SAMPLE)
    dims = len(columns)
    sample = numbers_of(rows.where(F.pmod(F.xxhash64("x"), F.lit(share)) == 0), "x", dims)
    cells = Cells(sample, min(MOST, -(-n // region)))

    @F.pandas_udf("int")
    def region_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(cells.of(np.array(x.tolist(), float).reshape(-1, dims)), dtype="int32")

    rows = settled(rows.withColumn("region", region_of("x")))
    corners = [f(F.get("x", F.lit(c))).alias(f"{s}{c}") for c in range(dims) for s, f in (("low", F.min), ("high", F.max))]
    regions = rows.groupBy("region").agg(F.count("*").alias("n"), *corners).orderBy("region").collect()  # MOST rows
    ids = np.array([r.region for r in regions], np.int64)
    sizes = np.array([r.n for r in regions], np.int64)
    low = np.array([[r[f"low{c}"] for c in range(dims)] for r in regions], float).reshape(-1, dims)
    high = np.array([[r[f"high{c}"] for c in range(dims)] for r in regions], float).reshape(-1, dims)

    @F.pandas_udf("double")
    def farthest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        """A squared distance within which k rows lie for certain: the farthest
        corners of the nearest regions that hold as many."""
        for s in batches:
            x, out = np.array(s.tolist(), float).reshape(-1, dims), []
            for part in np.array_split(x, -(-len(x) // 256) or 1):
                d = np.zeros((len(part), len(ids)))
                for c in range(dims):
                    gap = np.maximum(np.abs(part[:, c, None] - low[None, :, c]), np.abs(high[None, :, c] - part[:, c, None]))
                    d += gap * gap
                by = np.argsort(d, axis=1)
                enough = np.cumsum(sizes[by], axis=1) >= k
                at = np.where(enough.any(axis=1), enough.argmax(axis=1), 0)
                got = np.take_along_axis(d, np.take_along_axis(by, at[:, None], 1), 1)[:, 0] if len(ids) else np.zeros(len(part))
                out.append(np.where(enough.any(axis=1), got * (1 + 1e-12), np.inf))
            yield pd.Series(np.concatenate(out) if out else [], dtype=float)

    @F.pandas_udf("array<int>")
    def reached(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        """Regions other than the own whose box lies within the bound."""
        for s, bound, own in batches:
            x, out = np.array(s.tolist(), float).reshape(-1, dims), []
            for start in range(0, len(x), 256):
                part = slice(start, start + 256)
                near = box_distances(x[part], low, high) <= bound.to_numpy(float)[part, None]
                near &= ids[None, :] != own.to_numpy()[part, None]
                out += [ids[row].astype("int32") for row in near]
            yield pd.Series(out, dtype=object)

    schema = "q array<double>, " + ", ".join(f"{n} {t}" for n, t in kinds.items()) + ", d double, compared long"

    def met(asked: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or at.empty:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ["q", *names, "d", "compared"]})
        at = at.sort_values(names, na_position="first", ignore_index=True)
        best, place, compared = search(np.array(at["x"].tolist(), float).reshape(-1, dims), np.array(asked["x"].tolist(), float).reshape(-1, dims), asked["bound"].to_numpy(float), k)
        query, rank = np.nonzero(place < len(at))
        got = at[names].iloc[place[query, rank]].reset_index(drop=True)
        got.insert(0, "q", asked["x"].iloc[query].reset_index(drop=True))
        # What a query was compared with stands on its first row.
        return got.assign(d=best[query, rank], compared=np.where(rank == 0, compared[query], 0))

    def meet(asked: DataFrame) -> DataFrame:
        """``asked``: x, bound, region.  Blocks of a region's queries and its rows."""
        blocks = settled(asked.groupBy("region").agg(F.ceil(F.count("*") / region).cast("int").alias("blocks")))  # MOST rows
        asked = asked.join(F.broadcast(blocks), "region").select("x", "bound", "region", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int").alias("block"))
        dealt = rows.join(F.broadcast(blocks.toDF("region", "n_blocks")), "region").select(*rows.columns, F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"))
        return asked.groupBy("region", "block").cogroup(dealt.groupBy("region", "block")).applyInPandas(met, schema)

    homes = settled(asked.select("x", region_of("x").alias("region"), farthest("x").alias("bound")))
    near = settled(meet(homes))
    proven = near.groupBy("q").agg(F.count("*").alias("n"), F.max("d").alias("kth"))
    others = homes.join(proven, F.col("x") == F.col("q"), "left").withColumn("bound", F.when(F.col("n") >= k, F.least("bound", "kth")).otherwise(F.col("bound")))
    others = others.select("x", "bound", F.explode(reached("x", "bound", "region")).alias("region"))
    found = near.unionByName(meet(settled(others)))
    by = Window.partitionBy("q")
    ranked = found.withColumns({"rank": F.row_number().over(by.orderBy("d", *names)), "compared": F.sum("compared").over(by)}).where(F.col("rank") <= k)
    return ranked.select("q", *[F.col(n).alias(c) for c, n in zip(order, names, strict=True)], "d", "rank", "compared")


def neighbour_graph(df: DataFrame, key: str, columns: Sequence[str], k: int) -> DataFrame:
    """(a, b, d, rank): the k nearest other rows of every row by (distance, key);
    ``key`` is unique."""
    found = nearest(df, df, columns, [key], k + 1).select(F.col("q"), F.col(key).alias("b"), "d")
    own = df.select(F.col(key).alias("a"), F.transform(_vector(columns), lambda v: v + 0.0).alias("x"))
    pairs = own.join(found, F.col("x") == F.col("q")).where("a <> b")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).where(F.col("rank") <= k).select("a", "b", F.sqrt("d").alias("d"), "rank")


def outlier_factors(df: DataFrame, key: str, columns: Sequence[str], k: int = 20) -> DataFrame:
    """ML-32: local outlier factor, the mean density of a row's k nearest others over
    its own; about 1 inside a cluster, larger outside.  Density is one over the mean
    reachability distance (1e-10 is added, for rows at one position).  Two joins over
    the neighbour graph; a row without neighbours has no factor."""
    graph = settled(neighbour_graph(df, key, columns, k))
    reach = graph.groupBy("a").agg(F.max("d").alias("reach")).withColumnRenamed("a", "b")
    density = graph.join(reach, "b").groupBy("a").agg((1 / (F.avg(F.greatest("d", "reach")) + 1e-10)).alias("density"))
    around = graph.join(density.select(F.col("a").alias("b"), F.col("density").alias("other")), "b").groupBy("a").agg(F.avg("other").alias("other"))
    factor = around.join(density, "a").select(F.col("a").alias(key), (F.col("other") / F.col("density")).alias("factor"))
    return df.join(factor, key, "left")
