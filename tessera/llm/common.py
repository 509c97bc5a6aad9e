"""Helpers shared by the training-data operators.

Nothing here imports the rest of the library and nothing in the rest of the
library imports this subpackage.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts spell it, ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST = -(1 << 63)
#: Up to so many rows are broadcast to find their texts; beyond it all texts are shuffled.
FIND = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees, as the session names it.

    ``spark.checkpoint.dir`` comes from the cluster.  Only a session on a local
    master, whose executor is the driver, may do without it and gets a
    temporary folder; elsewhere a folder of one machine would lose rows, so it
    is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, row
    ids and sampled bounds are fixed, and the planner knows the true size."""
    return Scratch(df.sparkSession).write(df, tag)


def freed(spark: SparkSession) -> None:
    """Let Spark delete the shuffles that nothing reads any more, which it does
    once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Tables written on the way to a result.

    Used as a context, it deletes them at the end, but for those that ``keep``
    has named because the lazy result still reads them; ``drop`` deletes one
    early.  Only what was written under this object is ever deleted.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{tag}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def keep(self, df: DataFrame) -> DataFrame:
        self.paths.pop(id(df), None)
        return df

    def keep_tagged(self, tag: str) -> None:
        self.paths = {k: x for k, x in self.paths.items() if f"/{tag}-" not in x[1]}

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables and the shuffles behind them."""
        jvm = self.spark.sparkContext._jvm
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(df))[1])
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if tables:
            freed(self.spark)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop(*[df for df, _ in self.paths.values()])


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column, null counting as the empty text."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def sought(rows: DataFrame) -> DataFrame:
    """``rows``, a written table that names some texts, for a join with all texts."""
    return F.broadcast(rows) if rows.count() <= FIND else rows


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all other letters untouched."""
    return F.translate(c, UPPER, LOWER)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that clash with none of ``df``'s."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        n = f"__{name}"
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out
