"""Set operations, upserts and maintenance as join rewrites (SET, UPS).

Plain Parquet has no MERGE, so an upsert is a full join on the key and a
coalesce of each column; the result replaces the table in one write.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .filters import present
from .ranking import keep_first


def union_all(*frames: DataFrame) -> DataFrame:
    """SET-1, 2, SRC-17: rows of all frames, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def shared_columns(*frames: DataFrame, without: Sequence[str] = ("id",)) -> list[str]:
    """SET-3: column names that all frames have."""
    common = set.intersection(*[{c.lower() for c in f.columns} for f in frames])
    return sorted(common - set(without))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """SET-4: one row with the numbers of keys in both and in one only."""
    sides = a.select(key).distinct().withColumn("s", F.lit(1)).unionByName(b.select(key).distinct().withColumn("s", F.lit(2)))
    each = sides.groupBy(key).agg(F.sum("s").alias("s"))
    return each.agg(F.count_if(F.col("s") == 3).alias("both"), F.count_if(F.col("s") == 1).alias("left_only"), F.count_if(F.col("s") == 2).alias("right_only"))


def all_keys(key: str, *frames: DataFrame) -> DataFrame:
    """SET-5."""
    return union_all(*[f.select(key) for f in frames]).distinct()


def pruned(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SET-6: target rows whose key the source still has."""
    return target.join(source.select(*keys).distinct(), list(keys), "left_semi")


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """UPS-1, 2, 9, JOIN-24: update by key with values that mean something, insert the rest."""
    s = source.select(*[F.col(c).alias(f"__s_{c}") for c in source.columns])
    both = target.join(s, [F.col(k).eqNullSafe(F.col(f"__s_{k}")) for k in keys], "full")
    out = []
    for f in target.schema.fields:
        old, new = F.col(f.name), F.col(f"__s_{f.name}")
        if f.name not in source.columns:
            out.append(old)
        elif f.name in keys:
            out.append(F.coalesce(old, new).alias(f.name))
        else:
            # overwrite with a value that means something, or where the old one doesn't
            out.append(F.when(present(new, f.dataType) | ~F.coalesce(present(old, f.dataType), F.lit(False)), F.coalesce(new, old)).otherwise(old).alias(f.name))
    return both.select(*out)


def upsert_counts(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """UPS-2: one row (inserted, updated)."""
    known = target.select(*keys).distinct().withColumn("__known", F.lit(True))
    marked = source.select(*keys).distinct().join(known, list(keys), "left")
    return marked.agg(F.count_if(F.col("__known").isNull()).alias("inserted"), F.count_if(F.col("__known")).alias("updated"))


def delete_matching(target: DataFrame, source: DataFrame, ident: str, keys: Sequence[str]) -> DataFrame:
    """JOIN-23: target rows but for those with a source row's id and another key."""
    s = source.select(F.col(ident), F.struct(*keys).alias("__k"))
    clash = target.join(s, ident).where(~F.struct(*[F.col(k) for k in keys]).eqNullSafe(F.col("__k"))).select(ident).distinct()
    return target.join(clash, ident, "left_anti")


def backfilled(target: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """UPS-3: blanks of a column filled from one value per key."""
    v = values.groupBy(key).agg(F.min(column).alias("__v"))
    old = F.when(F.trim(F.col(column)) != "", F.col(column))
    return target.join(v, key, "left").withColumn(column, F.coalesce(old, F.col("__v"))).drop("__v")


def agreed_values(df: DataFrame, key: Column, value: Column) -> tuple[DataFrame, DataFrame]:
    """UPS-4: (key, value) of keys with one value, and the keys in conflict."""
    groups = df.select(key.alias("key"), value.alias("value")).where("key is not null and value is not null").groupBy("key").agg(F.count_distinct("value").alias("n"), F.min("value").alias("value"))
    return groups.where("n = 1").select("key", "value"), groups.where("n > 1").select("key", "n")


def evolved(df: DataFrame, schema: T.StructType) -> DataFrame:
    """UPS-6: columns of the schema that are missing are added as nulls."""
    have = {c.lower() for c in df.columns}
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name.lower() not in have})


def file_upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """UPS-8, SORT-14: both together, of each normalised key the last one stays."""
    code = F.upper(F.trim(F.col(key)))
    both = union_all(old.withColumn("__at", F.lit(0)), new.withColumn("__at", F.lit(1))).withColumn(key, code)
    return keep_first(both, [key], [F.col("__at").desc()]).drop("__at")
