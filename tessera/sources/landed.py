"""Landed JSON records: flat columns, entries under replaced codes, restartable landing (SRC-12, 13, 16)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

BROKEN = "_corrupt_record"


def _leaves(schema: T.StructType, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], T.DataType]]:
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            yield from _leaves(f.dataType, (*path, f.name))
        else:
            yield (*path, f.name), f.dataType


def flattened(df: DataFrame, separator: str = "_") -> DataFrame:
    """Every field inside records as a column named by its path; lists and maps stay
    as JSON text.  A null record gives null fields.  Of columns whose paths spell the
    same name, whatever their case, the second ends in ``_2`` and so on."""
    taken: set[str] = set()
    out: list[Column] = []
    for path, kind in _leaves(df.schema):
        base = name = separator.join(path)
        n = 1
        while name.lower() in taken:
            n += 1
            name = f"{base}{separator}{n}"
        taken.add(name.lower())
        value = F.col(".".join(f"`{p.replace('`', '``')}`" for p in path))
        out.append((F.to_json(value) if isinstance(kind, (T.ArrayType, T.MapType)) else value).alias(name))
    return df.select(*out)


def entries(wanted: DataFrame, code: str, records: DataFrame, record_code: str, replaced: DataFrame) -> DataFrame:
    """SRC-12: the record of every distinct wanted code, or of the code that replaced it.

    ``replaced`` has columns (old, new).  Of repeated records, and of repeated
    replacements of a code, the largest counts.  The result has ``code``, ``is_replaced``
    (Replaced or Not Replaced), ``code_changed`` (old->new, or empty), ``replacement_code``
    (or empty), ``canonical_code``, ``missing`` and ``record``, a struct, null where
    there is none.  Codes are looked up trimmed and in upper case; a blank one is not wanted.
    """
    norm = lambda c: F.upper(F.trim(F.col(c).cast("string")))
    asked = wanted.select(norm(code).alias("code")).where("code <> ''").distinct()
    held = records.select(norm(record_code).alias("__k"), F.struct(*[records[c] for c in records.columns]).alias("record"))
    held = held.where("__k <> ''").groupBy("__k").agg(F.max("record").alias("record"))
    newer = replaced.select(norm("old").alias("code"), norm("new").alias("__new")).where("__new <> '' and __new <> code").groupBy("code").agg(F.max("__new").alias("__new"))
    direct = asked.join(held.withColumnRenamed("__k", "code"), "code", "left")
    # Only codes without a record of their own look for a replacement.
    lost = direct.where("record is null").select("code").join(newer, "code", "left")
    found = lost.join(held, lost["__new"] == held["__k"], "left").select("code", "__new", "record")
    rows = direct.where("record is not null").select("code", F.lit(None).cast("string").alias("__new"), "record").unionByName(found)
    is_new = F.col("__new").isNotNull()
    return rows.select(
        "code", F.when(is_new, "Replaced").otherwise("Not Replaced").alias("is_replaced"), F.when(is_new, F.concat_ws("->", "code", "__new")).otherwise("").alias("code_changed"),
        F.coalesce("__new", F.lit("")).alias("replacement_code"), F.coalesce("__new", "code").alias("canonical_code"), F.col("record").isNull().alias("missing"), "record",
    )


def record_stream(spark: SparkSession, folder: str, schema: T.StructType, files: int = 100) -> DataFrame:
    """Landed JSON lines as a stream, ``files`` files a batch; a line that is no record
    has its text in ``_corrupt_record``."""
    whole = T.StructType([f for f in schema.fields if f.name != BROKEN] + [T.StructField(BROKEN, T.StringType())])
    return spark.readStream.schema(whole).option("maxFilesPerTrigger", files).option("columnNameOfCorruptRecord", BROKEN).json(folder)


def land(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """SRC-16: all files that have landed so far, written batch by batch as Parquet.

    The checkpoint keeps which files a batch has and the sink which batches are whole,
    so a run that was stopped, or lost its executors, goes on with its next batch when it
    is started again with the same two folders: no file is read into a second batch and
    every record is in ``out`` once.  Both folders must be shared by all executors."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
