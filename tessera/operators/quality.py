"""Data-quality checks, each a small frame (AGG-19..34)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AGG-30: keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def ambiguous(df: DataFrame, key: str, value: str) -> DataFrame:
    """AGG-31: keys with more than one value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n")).where("n > 1")


def drift(current: DataFrame, previous: DataFrame, limit: float) -> DataFrame:
    """AGG-32: rows now and before, and whether the change exceeds the share."""
    both = current.agg(F.count("*").alias("n_now")).withColumn("n_before", previous.agg(F.count("*").alias("n")).scalar())
    change = F.try_divide(F.abs(F.col("n_now") - F.col("n_before")).cast("double"), F.col("n_before"))
    return both.withColumn("change", change).withColumn("drifted", F.coalesce(F.col("change") > limit, F.lit(False)))


def covered(df: DataFrame, words: Sequence[str], *columns: Column) -> DataFrame:
    """AGG-33: per required word whether any row's text has it."""
    body = F.lower(F.concat_ws(" ", *columns))
    row = df.agg(*[F.coalesce(F.bool_or(body.contains(w.lower())), F.lit(False)).alias(f"w{i}") for i, w in enumerate(words)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(w).alias("word"), F.col(f"w{i}").alias("found")) for i, w in enumerate(words)])))


def unresolved(df: DataFrame, flag: Column, target: Column) -> DataFrame:
    """AGG-34: flagged rows without a target, counted."""
    return df.agg(F.count_if(flag & F.coalesce(F.trim(target) == "", F.lit(True))).alias("unresolved"), F.count_if(flag).alias("flagged"))


def missing_values(df: DataFrame) -> DataFrame:
    """AGG-40, 42: nulls of each column and their percentage, one pass."""
    row = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing"), F.try_divide(F.col(f"m{i}") * 100.0, F.col("n")).alias("percent")) for i, c in enumerate(df.columns)])
    return row.select(F.inline(each))


def about(df: DataFrame, label: str) -> dict[str, object]:
    """AGG-22: attributes of a table by kind; reads the schema only."""
    from .filters import split_by_type

    numeric, other = split_by_type(df)
    return {"label": label, "attributes": len(df.columns), "quantitative": len(numeric), "nominal": len(other)}
