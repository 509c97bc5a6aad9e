"""Line deduplication with levelled sorted runs of line hashes.

A run is a table of (a, b, n): a line's hash as two 64-bit integers and the
number of documents that hold it, bucketed by hash and sorted within its
buckets.  A batch of documents is counted, merge-anti-joined with each run, so
that lines which a run already knows as frequent drop out, and what is left is
added as a run of level 0.  When a level holds ``fanout`` runs they are merged
into one run of the next level, so the number of runs stays logarithmic in the
number of batches and every hash is rewritten a logarithmic number of times.

All runs have the same buckets, one sorted file each.  Joining a batch with a
run and merging two runs are therefore merge joins in which no run is shuffled
or sorted again.  A line that drops out of a batch is frequent whatever else is
counted, so the set of frequent lines is exact.

Only DataFrame functions are used.

Defined cases: a null text is one empty line; a key without code points is
never dropped; a line repeated in one document counts once for it; every input
row counts as one document, repeated and null ids too; a very long text only
has more lines; columns besides id and text are not read, whatever their names;
an empty table adds an empty run and gives an empty table.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, Scratch, ascii_lower, shared_dir, text_of

KEY = ["a", "b"]


def line_key(line: Column) -> Column:
    """The line stripped of ASCII white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def lines_of(body: Column) -> Column:
    return F.split(body, "\n", -1)


def placed_hashes(body: Column) -> Column:
    """Hashes of the keys of a text's lines, in order; null for an empty key."""
    return F.transform(lines_of(ascii_lower(body)), lambda x: F.when(F.btrim(x, F.lit(SPACES)) != "", _hash(F.btrim(x, F.lit(SPACES)))))


def line_hashes(body: Column) -> Column:
    """Hashes of the distinct keys of a text that have a code point at least."""
    keys = F.filter(F.transform(lines_of(ascii_lower(body)), lambda x: F.btrim(x, F.lit(SPACES))), lambda k: k != "")
    return F.transform(F.array_distinct(keys), _hash)  # of strings: distinct structs would be compared pair by pair


class LineRuns:
    """Levelled runs; ``min_docs`` is when a line counts as frequent.

    Runs are tables of the session's catalog with files in the shared folder; both
    go when the runs are merged, and by ``close``.
    """

    def __init__(self, spark: SparkSession, min_docs: int = 10, fanout: int = 4, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, self._made = f"line_runs_{uuid.uuid4().hex}", 0
        self.levels: list[list[str]] = [[]]
        self.folder = shared_dir(spark)

    @contextmanager
    def _sorted_scans(self) -> Iterator[None]:
        """Plans made inside know that a bucket's one file is sorted."""
        conf, key = self.spark.conf, "spark.sql.legacy.bucketedTableScan.outputOrdering"
        before = conf.get(key)
        conf.set(key, "true")
        try:
            yield
        finally:
            conf.set(key, before)

    def _write(self, counts: DataFrame, level: int) -> None:
        self._made += 1
        name = f"{self.name}_{self._made}"
        with self._sorted_scans():
            counts.repartition(self.buckets, *KEY).write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.folder}/{name}").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    @staticmethod
    def merged(runs: list[DataFrame]) -> DataFrame:
        """The sum of sorted runs, two at a time."""

        def two(x: DataFrame, y: DataFrame) -> DataFrame:
            zero = F.lit(0).cast("long")
            both = x.hint("merge").join(y.withColumnRenamed("n", "m"), KEY, "full_outer")
            return both.select(*KEY, (F.coalesce("n", zero) + F.coalesce("m", zero)).alias("n"))

        return functools.reduce(two, runs)

    def unknown(self, counts: DataFrame) -> DataFrame:
        """``counts`` without the lines that a run knows as frequent.

        The anti-join is written as an outer join whose hits are dropped: Spark
        would move a plain one below the count, in front of its combining.
        """
        for run in self._runs():
            known = run.where(F.col("n") >= self.min_docs).select(*KEY, F.lit(True).alias("known"))
            counts = counts.join(known.hint("merge"), KEY, "left").where("known is null").drop("known")
        return counts

    def add(self, hashes: DataFrame) -> None:
        """Add a batch: rows (a, b), one for each document and distinct line."""
        self._write(self.unknown(hashes.groupBy(*KEY).agg(F.count("*").alias("n"))), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self.merged([self.spark.table(name) for name in full]), level + 1)
            self._drop(full)
            level += 1

    def counts(self) -> DataFrame:
        """(a, b, n): documents of each line over all runs; of a line that was
        frequent in one run, of the batches until then."""
        return self.merged(self._runs()) if any(self.levels) else self.spark.createDataFrame([], "a bigint, b bigint, n bigint")

    def frequent(self) -> DataFrame:
        return self.counts().where(F.col("n") >= self.min_docs).select(*KEY)

    def _drop(self, names: list[str]) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(conf).delete(path, True)

    def close(self) -> None:
        self._drop([name for level in self.levels for name in level])
        self.levels = [[]]


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, batches: int = 3, fanout: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text: all of ``docs`` in ``batches``
    batches through the runs, then without the lines at the frequent ones' places.

    A document is told by its id and two hashes of its text, so that rows with one
    id (or none) meet only their own lines' places.
    """
    own = ["doc_id", "u", "w"]
    base = docs.select(docs[doc_id].alias("doc_id"), text_of(docs, text).alias("body"))
    base = base.select("doc_id", "body", F.xxhash64("body").alias("u"), F.xxhash64(F.lit(1), "body").alias("w"))
    with Scratch(docs.sparkSession) as scratch:
        part = F.pmod(F.xxhash64("doc_id", "u"), F.lit(batches)).cast("int").alias("part")
        rows = scratch.write(base.select(*own, part, line_hashes(F.col("body")).alias("once"), placed_hashes(F.col("body")).alias("h")), "hashes")
        runs = LineRuns(docs.sparkSession, min_docs, fanout)
        try:
            for i in range(batches):
                runs.add(rows.where(F.col("part") == i).select(F.explode("once").alias("h")).select("h.a", "h.b"))
            # Written first: with a plain shuffle on both sides the rows of a very
            # common line can be split at run time.
            with runs._sorted_scans():
                often = scratch.write(runs.frequent(), "often")
        finally:
            runs.close()
        mine = rows.select(*own, F.posexplode("h").alias("place", "h")).where("h is not null").select(*own, "place", "h.a", "h.b")
        hot = mine.join(often.hint("merge"), KEY, "left_semi").groupBy(*[F.col(c).alias(f"hot_{c}") for c in own]).agg(F.collect_set("place").alias("hot"))
        hot = scratch.keep(scratch.write(hot, "hot"))
    both = base.join(hot, base["doc_id"].eqNullSafe(hot["hot_doc_id"]) & (base["u"] == hot["hot_u"]) & (base["w"] == hot["hot_w"]), "left")
    # Differences of arrays are taken by hashing, so a text costs its length.
    lines, places = F.col("lines"), F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("hot"))
    kept = F.when(F.col("hot").isNull(), lines).otherwise(F.transform(places, lambda i: F.get("lines", i)))
    out = both.select("doc_id", "hot", lines_of(F.col("body")).alias("lines"))
    dropped = F.when(F.col("hot").isNull(), 0).otherwise(F.size("hot"))
    return out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("kept_text"))
