"""Cutting the lineage of iterative operators, and connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, that the session names in ``spark.checkpoint.dir``.  Only a
    session on a local master may do without the setting."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="tessera-checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as a checkpoint in the shared folder, so that it
    survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def beside(df: DataFrame, other: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df`` with the further columns of ``other``, which has one row for each group
    of ``by`` (null is a group too), or one row in all."""
    more = [c for c in other.columns if c not in by]
    if not by:
        return df.withColumns({c: other.select(c).scalar() for c in more})
    other = other.select(*[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)], *more)
    same = df[by[0]].eqNullSafe(other["__b0"])
    for i, c in enumerate(by[1:], 1):
        same = same & df[c].eqNullSafe(other[f"__b{i}"])
    return df.join(other, same, "left").drop(*[f"__b{i}" for i in range(len(by))])


def connected(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label): every node of the column ``node`` with the smallest node that
    links (a, b) lead to.  Rounds of groupings and joins: each node is linked to the
    smallest of its neighbours, then every node's neighbours to its smallest one,
    until nothing changes; the number of rounds grows with the logarithm of the
    number of nodes."""
    pairs = settled(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(pairs)
    while before[0]:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        larger = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = larger.groupBy("a").agg(F.min("b").alias("m"))
        pairs = settled(larger.join(low, "a").select("b", "m").union(low.select("a", "m")).toDF("a", "b").where("a <> b").distinct())
        after = mark(pairs)
        if after == before:
            break
        before = after
    found = pairs.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.select("node").distinct().join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
