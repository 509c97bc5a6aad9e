"""Event counting, the same in batch and stream (STR).

Each transformation takes and returns a DataFrame, so a test can run it over a
table and a job over ``readStream``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def bucket(ts: Column, seconds: int) -> Column:
    """STR-2: start of the fixed bucket a time falls in."""
    return F.window(ts, f"{seconds} seconds")["start"]


def over_limit(events: DataFrame, ts: str, keys: list[str], seconds: int, limit: int, delay: str | None = None) -> DataFrame:
    """STR-1: buckets with more events than allowed; a stream needs ``delay``
    for its watermark (and a timestamp with time zone)."""
    rows = events.withWatermark(ts, delay) if delay else events
    counts = rows.groupBy(F.window(ts, f"{seconds} seconds").alias("w"), *keys).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > limit).select(*keys, F.col("w.start").alias("bucket"), "n")


def table_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """STR-3: Parquet files as a stream, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def upsert_stream(stream: DataFrame, checkpoint: str, merge: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """STR-3, UPS-2: each micro-batch is merged once; restarts go on from the checkpoint."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """Stream without repeats of a key within the delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def runs(events: DataFrame, by: str, ts: str, ident: str, kind: str) -> DataFrame:
    """Consecutive events of one kind per key (SCL-32 over rows)."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(ts, ident)
    new = (F.lag(kind).over(w).isNull() | (F.lag(kind).over(w) != F.col(kind))).cast("int")
    marked = events.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(by, "run", kind).agg(F.count("*").alias("n"), F.min(ts).alias("start"), F.max(ts).alias("end"))


def stale(rows: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """STR-11: one row: whether the newest row is older than the days."""
    return rows.agg(F.coalesce(F.max(ts) < now - F.expr(f"interval {int(days)} days"), F.lit(True)).alias("stale"))


def run_stages(stages: dict[str, Callable[[DataFrame], DataFrame]], df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """STR-8: named stages in order, all or the chosen ones."""
    unknown = set(names or []) - set(stages)
    if unknown:
        raise ValueError(f"unknown stages {sorted(unknown)}")
    for name, stage in stages.items():
        if names is None or name in names:
            df = stage(df)
    return df
