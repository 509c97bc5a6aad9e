"""Density clusters (ML-25) by cells, without the pairs of a dense cell.

Rows are dealt to cells whose diagonal is ``eps``, so all rows of a cell are
neighbours: a cell with ``least`` rows consists of core rows, and the core rows
of a cell always belong together.  Rows of other cells, fewer than ``least`` a
cell, are held against the bounding boxes of the cells around them; only where a
box lies neither wholly inside nor wholly outside their reach are they compared
with its rows.  Whether two cells are linked is decided by their boxes and one
row of each; pairs that stay open are cut into halves of their sides, again and
again, until a pair within reach is found or none can be.  Every step is an
equality join on cells, and linked cells become clusters by connected
components.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stages import connected, settled


def _sum(parts: Sequence[Column]) -> Column:
    return sum(parts[1:], parts[0])


class _Grid:
    """Cells of side eps / sqrt(columns), and expressions over points and boxes."""

    def __init__(self, dims: int, eps: float):
        self.dims, self.eps = dims, eps
        self.side = eps / math.sqrt(dims) * (1 - 1e-12)
        reach = math.ceil(math.sqrt(dims))
        apart = lambda o: sum(max(abs(s) - 1, 0) ** 2 for s in o)
        #: Steps to the cells that may hold a row within reach.
        self.steps = [o for o in itertools.product(range(-reach, reach + 1), repeat=dims) if apart(o) <= dims]

    def cell(self, halvings: int = 0) -> Column:
        """The cell of x0, x1, ..., its sides halved so often."""
        return F.array(*[F.floor(F.col(f"x{c}") / F.lit(self.side * 2.0**-halvings)).cast("long") for c in range(self.dims)])

    def around(self, steps: Sequence[tuple[int, ...]]) -> Column:
        shifts = F.array(*[F.array(*[F.lit(s).cast("long") for s in step]) for step in steps])
        return F.explode(F.transform(shifts, lambda s: F.zip_with(F.col("cell"), s, lambda p, q: p + q)))

    def boxes(self, rows: DataFrame, by: Sequence[str]) -> DataFrame:
        """Number, corners and one row (p0, p1, ...) of each group."""
        some = F.min(F.struct(*[f"x{c}" for c in range(self.dims)]))
        corners = [f(f"x{c}").alias(f"{s}{c}") for c in range(self.dims) for s, f in (("low", F.min), ("high", F.max))]
        return rows.groupBy(*by).agg(F.count("*").alias("n"), *corners, some.alias("some")).select(*by, "n", *[f"{s}{c}" for c in range(self.dims) for s in ("low", "high")], *[F.col(f"some.x{c}").alias(f"p{c}") for c in range(self.dims)])

    def between(self, x: str, y: str) -> Column:
        """Squared distance of two points."""
        return _sum([F.pow(F.col(f"{x}{c}") - F.col(f"{y}{c}"), F.lit(2)) for c in range(self.dims)])

    def least(self, low: str, high: str, other_low: str, other_high: str) -> Column:
        """Least squared distance of two boxes (or of a point, its own corners)."""
        gap = lambda c: F.greatest(F.lit(0.0), F.col(f"{other_low}{c}") - F.col(f"{high}{c}"), F.col(f"{low}{c}") - F.col(f"{other_high}{c}"))
        return _sum([F.pow(gap(c), F.lit(2)) for c in range(self.dims)])

    def most(self, x: str, low: str, high: str) -> Column:
        """Largest squared distance of a point from a box."""
        return _sum([F.pow(F.greatest(F.abs(F.col(f"{x}{c}") - F.col(f"{low}{c}")), F.abs(F.col(f"{x}{c}") - F.col(f"{high}{c}"))), F.lit(2)) for c in range(self.dims)])


def _cores(grid: _Grid, rows: DataFrame, least: int) -> DataFrame:
    """key, cell, x0, ... of the rows with ``least`` neighbours, themselves included."""
    reach = F.lit(grid.eps * grid.eps)
    cells = settled(grid.boxes(rows, ["cell"]))
    dense = cells.where(F.col("n") >= least).select("cell")
    sparse = settled(rows.join(dense, "cell", "left_anti"))
    points = [F.col(f"x{c}").alias(f"y{c}") for c in range(grid.dims)]
    met = sparse.select(F.col("key").alias("asked"), *points, grid.around(grid.steps).alias("cell")).join(cells, "cell").where(grid.least("y", "y", "low", "high") <= reach)
    met = settled(met.withColumn("inside", grid.most("y", "low", "high") <= reach).select("asked", *[f"y{c}" for c in range(grid.dims)], "cell", "n", "inside"))
    sure = met.where("inside").groupBy("asked").agg(F.sum("n").alias("n"))
    enough = sure.where(F.col("n") >= least).select("asked")
    close = met.where("not inside").join(enough, "asked", "left_anti").select("asked", *[f"y{c}" for c in range(grid.dims)], "cell").join(rows, "cell").where(grid.between("x", "y") <= reach)
    more = sure.unionByName(close.groupBy("asked").agg(F.count("*").alias("n"))).groupBy("asked").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return rows.join(dense, "cell", "left_semi").unionByName(sparse.join(more, F.col("key") == F.col("asked"), "left_semi").select(*rows.columns))


def _links(grid: _Grid, cores: DataFrame) -> DataFrame:
    """(a, b): cells, named by their first core row, that hold core rows within reach
    of each other.  ``cores``: node, cell, x0, ..."""
    reach, dims = F.lit(grid.eps * grid.eps), range(grid.dims)
    mine = lambda side: {f"{s}{c}": f"{side}{s}{c}" for s in ("low", "high", "p") for c in dims}
    named = lambda parts, side: parts.withColumnsRenamed(mine(side) | {"node": side, "cell": f"{side}_cell"}).drop("n")
    judge = lambda pairs: settled(pairs.where(grid.least("alow", "ahigh", "blow", "bhigh") <= reach).withColumn("linked", grid.between("ap", "bp") <= reach).select("a", "b", "a_cell", "b_cell", "linked"))
    boxes = settled(grid.boxes(cores, ["node", "cell"]))
    forward = [s for s in grid.steps if s > (0,) * grid.dims]
    first = named(boxes, "a").withColumn("cell", F.col("a_cell"))
    first = first.select(*[c for c in first.columns if c != "cell"], grid.around(forward).alias("b_cell"))
    pairs = judge(first.join(named(boxes, "b"), "b_cell"))
    links, halvings = pairs.where("linked").select("a", "b"), 0
    while True:
        found = pairs.where("linked").select("a", "b").distinct()
        open_ = settled(pairs.where("not linked").join(found, ["a", "b"], "left_anti").select("a", "b", "a_cell", "b_cell"))
        if open_.isEmpty():
            return links.distinct()
        halvings += 1
        nodes = open_.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        parts = cores.join(nodes, "node", "left_semi").select("node", *[f"x{c}" for c in dims], grid.cell(halvings).alias("cell"))
        parts = settled(grid.boxes(parts, ["node", "cell"]).withColumn("parent", F.transform("cell", lambda v: F.shiftright(v, 1))))
        left = named(parts, "a").withColumnRenamed("parent", "a_parent")
        right = named(parts, "b").withColumnRenamed("parent", "b_parent")
        both = open_.withColumnsRenamed({"a_cell": "a_parent", "b_cell": "b_parent"}).join(left, ["a", "a_parent"]).join(right, ["b", "b_parent"])
        pairs = judge(both)
        links = settled(links.unionByName(pairs.where("linked").select("a", "b")).distinct())


def density_clusters(df: DataFrame, key: str, columns: Sequence[str], eps: float, least: int) -> DataFrame:
    """ML-25: ``df`` with core (has ``least`` rows within ``eps``, itself included) and
    cluster, the smallest key of its core rows.  Rows within ``eps`` of a core row
    belong to the smallest such cluster, all others to none (null).

    ``key`` is unique; few columns (the cells around one grow with their number).
    Rows with a null or non-finite number are neither core nor in a cluster.
    """
    grid = _Grid(len(columns), float(eps))
    reach, dims = F.lit(grid.eps * grid.eps), range(len(columns))
    fine = F.lit(True)
    for c in columns:
        fine = fine & F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))
    rows = df.where(fine).select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    rows = settled(rows.withColumn("cell", grid.cell()))
    cores = _cores(grid, rows, least)
    node = cores.groupBy("cell").agg(F.min("key").alias("node"))
    cores = settled(cores.join(node, "cell"))
    label = settled(connected(cores, _links(grid, cores.drop("key"))))
    inner = settled(cores.join(label, "node").select("key", F.lit(True).alias("core"), F.col("label").alias("cluster")))
    # The others, fewer than ``least`` a cell, look for core rows around them.
    boxes = grid.boxes(cores, ["node", "cell"]).join(label, "node")
    points = [F.col(f"x{c}").alias(f"y{c}") for c in dims]
    rest = rows.join(inner, "key", "left_anti").select(F.col("key").alias("asked"), *points, grid.around(grid.steps).alias("cell"))
    met = rest.join(boxes, "cell").where(grid.least("y", "y", "low", "high") <= reach)
    met = settled(met.withColumn("sure", grid.between("y", "p") <= reach).select("asked", *[f"y{c}" for c in dims], "cell", "label", "sure"))
    close = met.where("not sure").join(cores, "cell").where(grid.between("x", "y") <= reach)
    border = met.where("sure").select("asked", "label").unionByName(close.select("asked", "label")).groupBy("asked").agg(F.min("label").alias("cluster"))
    found = inner.unionByName(border.select(F.col("asked").alias("key"), F.lit(False).alias("core"), "cluster"))
    return df.join(found.withColumnRenamed("key", key), key, "left").withColumn("core", F.coalesce("core", F.lit(False)))
