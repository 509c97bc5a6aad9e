"""Connected components by alternating large-star and small-star rounds.

Every round is a grouping and a join over the edges; nothing is collected, and
each round is written to the shared folder.  The number of rounds grows with
the logarithm of the number of nodes.

Defined cases: repeated edges and loops count once and not at all; no edges
give an empty table; an edge with a null end links nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``edges``: longs a, b.  Returns (node, label): each node of an edge that
    isn't its component's smallest node, with that smallest node.  The result
    is a table written under ``scratch``; the rounds before it are deleted."""
    scratch = scratch or Scratch(edges.sparkSession)
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    pairs = scratch.write(pairs, "edges")
    before, done = _mark(pairs), []
    while before[0]:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, pairs = pairs, scratch.write(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        done.append(last)
        after = _mark(pairs)
        if after == before:
            break
        before = after
    scratch.drop(*done)
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("label"))
