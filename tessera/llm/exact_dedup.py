"""Exact deduplication by deterministic block naming.

Every text is cut into blocks of a fixed number of code points.  The distinct
blocks are sorted by range partitioning and a block's name is its place in that
order: an integer.  Then adjacent names are named in pairs in the same way,
level by level (an odd last name is paired with none), until one name is left
for each document.  With the number of code points, which fixes the number of
blocks, it is the document's identity: equal identities mean equal texts.

A block enters the sort as a key of two 64-bit hashes of its content, so the
contents themselves are shuffled once only, with copies combined before the
shuffle, to prove that no key stands for two contents.  Where one does, its
contents are sorted and their place is part of the key.  Names are thus free of
collisions, the same for any partitioning, and all further shuffles carry
numbers only.

Defined cases: a null text is the empty text; the empty text has no block and
its own identity; a very long text has more levels; rows repeated with the same
doc_id are members of one group and exactly one of them is kept; a null doc_id
is lower than any other; columns of any name are carried along; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, sought, text_of

BLOCK = 4096
_ROW = (1 << 33) - 1  # monotonically_increasing_id: row within the partition


def _key(content: Column, mask: int) -> Column:
    """Two independent 64-bit integers; ``mask`` shortens them in tests."""
    a, b = F.xxhash64(content), F.xxhash64(F.lit(1), content)
    if mask != -1:
        a, b = a.bitwiseAND(F.lit(mask).cast("long")), F.lit(0).cast("long")
    return F.struct(a.alias("a"), b.alias("b"))


def _blocks(text: Column, block: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))


def sorted_names(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """The distinct rows of ``keys`` with ``name``: their place in sorted order.

    Range partitions are sorted and numbered each on its own; a partition's
    first number is the size of those before it (one row a partition).
    """
    by = keys.columns
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keys.distinct().repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    rows = scratch.write(rows, "names").withColumn("part", F.shiftright("at", 33))
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(sizes.select("part", before.alias("before"))), "part").select(*by, (F.col("before") + F.col("at").bitwiseAND(F.lit(_ROW))).alias("name"))


def identities(docs: DataFrame, doc_id: str, text: str, block: int, mask: int, scratch: Scratch) -> DataFrame:
    """(uid, d, n, sha, name) for every row: a row number, its doc_id, the
    number of code points, the text's SHA-256 and the last name (null for the
    empty text).  A written table without texts."""
    base = docs.select(docs[doc_id].alias("d"), text_of(docs, text).alias("text"))
    keys = F.transform(_blocks(F.col("text"), block), lambda b: _key(b, mask))
    rows = scratch.write(base.select(F.monotonically_increasing_id().alias("uid"), "d", F.length("text").cast("long").alias("n"), F.unhex(F.sha2("text", 256)).alias("sha"), keys.alias("keys")), "rows")
    cells = rows.select("uid", "sha", F.size("keys").alias("left"), F.posexplode("keys").alias("pos", "key")).select("uid", "sha", "left", "pos", "key.a", "key.b")
    if _clash(base, block, mask):
        cells = cells.join(_clashes(base, block, mask), ["sha", "pos"])
    else:
        cells = cells.withColumn("tie", F.lit(0))
    names = sorted_names(cells.select("a", "b", "tie"), scratch)
    cells = scratch.write(cells.join(names, ["a", "b", "tie"]).select("uid", "left", "pos", "name"), "cells")
    done = [cells.where("left = 1").select("uid", "name")]
    longest = rows.agg(F.max(F.size("keys"))).first()[0] or 0
    while longest > 1:
        longest = -(-longest // 2)
        half = F.when(F.col("pos") % 2 == 0, F.col("name")), F.when(F.col("pos") % 2 == 1, F.col("name"))
        pairs = cells.where("left > 1").groupBy("uid", F.floor(F.col("left") / 2 + 0.5).cast("int").alias("left"), F.floor(F.col("pos") / 2).cast("int").alias("pos"))
        pairs = scratch.write(pairs.agg(F.max(half[0]).alias("l"), F.coalesce(F.max(half[1]), F.lit(-1)).alias("r")), "pairs")
        names = sorted_names(pairs.select("l", "r"), scratch)
        cells = scratch.write(pairs.join(names, ["l", "r"]).select("uid", "left", "pos", "name"), "cells")
        done.append(cells.where("left = 1").select("uid", "name"))
    last = done[0]
    for more in done[1:]:
        last = last.unionByName(more)
    return scratch.write(rows.drop("keys").join(last, "uid", "left"), "identity")


def _clash(base: DataFrame, block: int, mask: int) -> bool:
    """Whether any key stands for two contents; the only shuffle of contents."""
    said = base.select(F.explode(_blocks(F.col("text"), block)).alias("content")).select(_key(F.col("content"), mask).alias("key"), "content").select("key.a", "key.b", "content")
    twice = said.groupBy("a", "b", "content").agg(F.lit(1).alias("one")).groupBy("a", "b").agg(F.count("*").alias("k")).where("k > 1")
    return not twice.limit(1).isEmpty()


def _clashes(base: DataFrame, block: int, mask: int) -> DataFrame:
    """(sha, pos, tie): the place of a block among the sorted contents of its key."""
    cells = base.select(F.unhex(F.sha2("text", 256)).alias("sha"), F.posexplode(_blocks(F.col("text"), block)).alias("pos", "content")).distinct()
    cells = cells.withColumn("key", _key(F.col("content"), mask))
    ranks = cells.select("key", "content").distinct().withColumn("tie", F.row_number().over(Window.partitionBy("key").orderBy("content")))
    return cells.join(ranks, ["key", "content"]).select("sha", "pos", "tie")


def _grouped(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` with ``best`` (d and uid of the row that stays) and ``size``."""
    best = rows.groupBy("n", "name").agg(F.max(F.struct("d", "uid")).alias("best"), F.count("*").alias("size"))
    # Written first: with a plain shuffle on both sides the join of a large
    # group can be split at run time.
    best = scratch.write(best.withColumnRenamed("n", "m"), "groups")
    return rows.join(best.withColumnRenamed("name", "last"), (F.col("n") == F.col("m")) & F.col("name").eqNullSafe(F.col("last")))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, mask: int = -1) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.keep(identities(docs, doc_id, text, block, mask, scratch))
        out = _grouped(rows, scratch)
        scratch.keep_tagged("groups")
    return out.select(
        F.col("d").alias("doc_id"),
        F.col("best.d").alias("keep_id"),
        F.col("size").cast("long").alias("group_size"),
        (F.col("best.uid") == F.col("uid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """``docs`` without all but one row (the largest doc_id) of equal texts.

    Of rows with that doc_id and text the one whose hash is least stays.
    """
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    back = [F.col(n).alias(c) for c, n in at.items()]
    ident = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    with Scratch(docs.sparkSession) as scratch:
        rows = _grouped(identities(docs, doc_id, text, block, -1, scratch), scratch)
        rows = scratch.write(rows.where("size > 1").select(ident(F.col("d")).alias("i"), "sha", ident(F.col("best.d")).alias("j"), (F.col("best.uid") == F.col("uid")).alias("stays")), "copies")
        lost = scratch.keep(scratch.write(rows.where("i <> j").select("i", "sha").distinct(), "lost"))
        again = scratch.keep(scratch.write(rows.where("i = j and not stays").select("i", "sha").distinct(), "again"))
    held = docs.toDF(*at.values())
    key = {"i": ident(F.col(at[doc_id])), "sha": F.unhex(F.sha2(text_of(held, at[text]), 256))}
    kept = held.withColumns(key).join(sought(lost), ["i", "sha"], "left_anti")
    if again.isEmpty():
        return kept.select(*back)
    hashed = F.xxhash64(*[n for n, kind in held.dtypes if "map<" not in kind])
    once = kept.join(again, ["i", "sha"], "left_anti").select(*at.values())
    some = kept.join(again, ["i", "sha"], "left_semi").groupBy("i", "sha").agg(F.min_by(F.struct(*at.values()), hashed).alias("row")).select("row.*")
    return once.unionByName(some).select(*back)
