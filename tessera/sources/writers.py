"""Sinks (SRC-22..25, 30, 33, UPS-5, 7)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import exists


def download(df: DataFrame, path: str, kind: str) -> None:
    """SRC-22, 23: csv, tsv or json parts; xlsx needs a sheet writer at the
    driver's edge and is refused like any unknown kind."""
    if kind == "json":
        df.write.mode("overwrite").json(path)
    elif kind in ("csv", "tsv"):
        df.write.mode("overwrite").options(header="true", sep="," if kind == "csv" else "\t").csv(path)
    else:
        raise ValueError(f"unknown format {kind!r}")


def prefixed(sources: dict[str, DataFrame], key: str, joined: DataFrame | None = None) -> DataFrame:
    """SRC-24: left joins on the key with each source's columns under its prefix;
    a name in several sources is read from its own source."""
    out = None
    for name, df in sources.items():
        own = df.select(F.col(key), *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != key])
        out = own if out is None else out.join(own, key, "left")
    return out


def release(df: DataFrame, folder: str, label: str, keep: int = 25) -> str:
    """SRC-25: a versioned release, with a manifest of the newest ones.

    The manifest row is appended after the data is complete, so readers who
    start from the manifest never see half a release.
    """
    at = f"{folder}/release={label}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(at)
    df.sparkSession.createDataFrame([(label, at)], "label string, path string").withColumn("made", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return at


def releases(spark: SparkSession, folder: str, keep: int = 25) -> DataFrame:
    """Newest releases first."""
    return spark.read.parquet(f"{folder}/manifest").orderBy(F.desc("made")).limit(keep)


def reuse(spark: SparkSession, path: str, version: str, make) -> DataFrame:
    """SRC-30, STR-10: a result stored under its sources' version; made if absent."""
    at = f"{path}/version={version}"
    if not exists(spark, f"{at}/_SUCCESS"):
        make().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def store_export(df: DataFrame, providers: Sequence[str], methods: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """SRC-33: chosen providers and methods in key order."""
    return df.where(F.col("provider").isin(*providers) & F.col("method").isin(*methods)).orderBy(*keys)


def audit(spark: SparkSession, folder: str, **event: str) -> None:
    """UPS-7: one event appended."""
    names = sorted(event)
    spark.createDataFrame([tuple(str(event[n]) for n in names)], ", ".join(f"{n} string" for n in names)).withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(folder)


def fasta_lines(df: DataFrame, ident: str, sequence: str) -> DataFrame:
    """SRC-26: a text column of FASTA records, to be written with ``write.text``."""
    return df.select(F.concat(F.lit(">"), F.col(ident).cast("string"), F.lit("\n"), F.col(sequence)).alias("value"))


def batched(df: DataFrame, key: str, batches: int, folder: str) -> DataFrame:
    """SRC-16: a costly frame written in batches by hashed key; a batch that was
    written in full is reused when the job runs again."""
    spark = df.sparkSession
    part = F.pmod(F.xxhash64(key), F.lit(batches))
    for b in range(batches):
        at = f"{folder}/batch={b}"
        if not exists(spark, f"{at}/_SUCCESS"):
            df.where(part == b).write.mode("overwrite").parquet(at)
    return spark.read.schema(df.schema).parquet(*[f"{folder}/batch={b}" for b in range(batches)])


def progress(spark: SparkSession, folder: str, task: str, state: str, detail: str = "") -> None:
    """STR-12: one event of a task's life: started, progress, succeeded, failed or skipped."""
    if state not in ("started", "progress", "succeeded", "failed", "skipped"):
        raise ValueError(f"unknown state {state!r}")
    audit(spark, folder, task=task, state=state, detail=detail)
