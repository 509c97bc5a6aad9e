"""Exact quantiles by distributed selection.

The number at a rank is found by counting.  Numbers are ordered by their bits; a
pass counts a group's numbers by their next ``BITS`` bits, and the count in which
the rank falls says how the number begins.  Only numbers that begin like one
wanted are counted in the next pass.  A pass is one grouping that combines
before the shuffle into at most 2^BITS counts for each rank, so no task ever
holds the numbers of a group, and 64 / BITS passes do for any distribution.
Once at most ``FEW`` numbers are left they are counted one by one.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import settled

BITS = 16
FEW = 1 << 20
PARTS = 1 << 16  # counts of an interval in one pass
SMALL = 1 << 16  # wanted ranks, or groups, that are sent to every task


def _two(n: Column) -> Column:
    return F.pow(F.lit(2.0), n.cast("double"))


def _guess(size: Column) -> Column:
    return F.least(F.greatest(F.floor(F.log2(F.greatest(size, F.lit(2.2250738585072014e-308)))), F.lit(-1022)), F.lit(1024)).cast("int")


def _power(size: Column, guess: Column) -> Column:
    # The logarithm may be rounded up or down to a whole number.
    return F.when(_two(guess) > size, guess - 1).when(_two(guess + 1) <= size, guess + 1).otherwise(guess)


def _bits(value: Column, size: Column, power: Column) -> Column:
    whole = (power + 1023).cast("long") * F.lit(1 << 52) + ((size / _two(power) - 1) * F.lit(2.0**52)).cast("long")
    tiny = (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")  # multiples of the least number above zero
    bits = F.when(size < 2.2250738585072014e-308, tiny).when(size == float("inf"), F.lit(0x7FF << 52)).otherwise(whole)
    return F.when(value < 0, -bits).otherwise(bits)


def ordered_bits(c: Column) -> Column:
    """A double that is a number as a long in the same order; both zeros are 0."""
    value = c.cast("double")
    size = F.abs(value)
    return _bits(value, size, _power(size, _guess(size)))


def with_ordered_bits(df: DataFrame, column: str, to: str) -> DataFrame:
    """The same as a column, in steps: as one expression a row's logarithm and powers
    are computed again wherever they stand in it."""
    value, size = F.col(column).cast("double"), F.abs(F.col(column).cast("double"))
    out = df.withColumn("__guess", _guess(size)).withColumn("__power", _power(size, F.col("__guess")))
    return out.withColumn(to, _bits(value, size, F.col("__power"))).drop("__guess", "__power")


def _same(a: DataFrame, b: DataFrame, names: Sequence[str]) -> Column:
    out = a[names[0]].eqNullSafe(b[f"b_{names[0]}"])
    for n in names[1:]:
        out = out & a[n].eqNullSafe(b[f"b_{n}"])
    return out


def sent_if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` for a join, broadcast if it has few rows: a checkpoint has no size that
    the planner knows, and without it the large side would be shuffled by few keys."""
    return F.broadcast(df) if rows <= SMALL else df


def quantiles(df: DataFrame, by: Sequence[str], column: str, points: Sequence[float], few: int = FEW) -> DataFrame:
    """A row for each group of ``by`` with n (numbers) and q0, q1, ...: the column's
    quantiles at ``points`` (0 to 1), interpolated between the two ranks around
    them.

    Nulls and NaN don't count; a group without numbers has nulls; null is a group of
    its own; with no ``by`` all rows are one group.  Exact, as if groups were sorted.
    """
    names = ["g", *[f"g{i}" for i in range(len(by))]]
    v = F.col(column).cast("double")
    rows = df.select(F.lit(0).alias("g"), *[F.col(c).alias(n) for c, n in zip(by, names[1:], strict=True)], F.when(~F.isnan(v), v).alias("v"))
    groups = settled(rows.groupBy(*names).agg(F.count("v").alias("n")))
    held = with_ordered_bits(rows.where("v is not null"), "v", "at")
    place = F.col("p") * (F.col("n") - 1)
    wanted = groups.where("n > 0").select(*names, "n", F.explode(F.array(*[F.lit(float(p)) for p in points])).alias("p"))
    wanted = wanted.select(*names, F.explode(F.array(F.floor(place).cast("long"), F.ceil(place).cast("long"))).alias("rank")).distinct()
    # Of each rank: how its number begins, and its rank among those that begin so.
    ranks = settled(wanted.select(*names, "rank", F.lit(0).cast("long").alias("prefix"), F.col("rank").alias("left")))
    left, n_groups = groups.agg(F.sum("n"), F.count("*")).first()
    left, known, n_ranks = left or 0, 64, 2 * len(points) * n_groups  # at most
    while True:
        shift = 0 if left <= few else known - BITS
        begins = F.lit(0).cast("long") if known == 64 else F.shiftright("at", known)
        bins = held.select(*names, begins.alias("prefix"), F.shiftright("at", shift).alias("bin"), "v")
        asked = ranks.select(*[F.col(n).alias(f"b_{n}") for n in [*names, "prefix"]], "rank", "left")
        if known < 64:
            some = asked.drop("rank", "left").distinct()
            bins = bins.join(sent_if_small(some, n_ranks), _same(bins, some, [*names, "prefix"]), "left_semi")
        counts = bins.groupBy(*names, "prefix", "bin").agg(F.count("*").alias("count"), F.min("v").alias("v"))
        # At most 2^BITS rows, or ``few``, for each group and prefix.
        upto = F.sum("count").over(Window.partitionBy(*names, "prefix").orderBy("bin"))
        counts = counts.withColumn("before", upto - F.col("count"))
        hit = _same(counts, asked, [*names, "prefix"]) & (F.col("left") >= F.col("before")) & (F.col("left") < F.col("before") + F.col("count"))
        ranks = settled(counts.join(sent_if_small(asked, n_ranks), hit).select(*names, "rank", F.col("bin").alias("prefix"), (F.col("left") - F.col("before")).alias("left"), "count", "v"))
        if shift == 0:
            break
        left, known = ranks.select(*names, "prefix", "count").distinct().agg(F.sum("count")).first()[0] or 0, shift
    found = ranks.groupBy(*[F.col(n).alias(f"b_{n}") for n in names]).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("of"))  # two ranks a point
    out = groups.join(sent_if_small(found, n_groups), _same(groups, found, names), "left")
    number = lambda rank: F.try_element_at("of", rank.cast("long"))

    def between(p: Column) -> Column:
        at = p * (F.col("n") - 1)
        low, high = number(F.floor(at)), number(F.ceil(at))
        return F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at)))

    values = F.transform(F.array(*[F.lit(float(p)) for p in points]), between)
    out = out.select(*[F.col(n).alias(c) for n, c in zip(names[1:], by, strict=True)], "n", values.alias("__q"))
    return sent_if_small(out.select(*by, "n", *[F.get("__q", F.lit(i)).alias(f"q{i}") for i in range(len(points))]), n_groups)


def _at(v: float) -> int:
    """``ordered_bits`` of one number."""
    bits = struct.unpack("<q", struct.pack("<d", abs(v)))[0]
    return -bits if v < 0 else bits


def cuts(df: DataFrame, columns: Sequence[str], most: int = 32) -> list[list[float]]:
    """For each column the numbers that end its parts, but for the last part: its values,
    if it has at most ``most``, else up to ``most`` parts of about as many rows.

    All rows are counted, by the leading bits of a number within the column's range;
    an interval of several values with a quarter of a part's rows is divided again, so
    that no part has a quarter too many unless one value has.  Nulls and NaN don't count."""
    values = [F.col(c).cast("double") for c in columns]
    numbers = [F.when(~F.isnan(v), v) for v in values]
    found = df.agg(*[F.struct(F.min(v), F.max(v), F.count(v)) for v in numbers]).first()
    totals = [r[2] for r in found]
    rows = df.select(F.posexplode(F.array(*numbers)).alias("i", "v")).where("v is not null")
    rows = with_ordered_bits(rows, "v", "at").select("i", "v", "at")
    heavy = F.col("n") * (4 * most) > F.get(F.array(*[F.lit(t) for t in totals]), F.col("i"))
    todo, kept = [(i, low, high) for i, (low, high, n) in enumerate(found) if n], []
    while todo:
        shift = lambda low, high: next(s for s in range(64) if (_at(high) >> s) - (_at(low) >> s) < PARTS)
        asked = df.sparkSession.createDataFrame([(i, low, high, shift(low, high)) for i, low, high in todo], "j int, low double, high double, shift int")
        inside = (F.col("i") == F.col("j")) & F.col("v").between(F.col("low"), F.col("high"))
        counts = rows.join(F.broadcast(asked), inside).groupBy("i", "low", F.call_function("shiftright", F.col("at"), F.col("shift")).alias("bin"))
        counts = settled(counts.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).select("i", "lo", "hi", "n"))
        again = heavy & (F.col("lo") < F.col("hi"))
        todo = [tuple(r) for r in counts.where(again).select("i", "lo", "hi").collect()]  # 4 x most a column at most
        kept.append(counts.where(~again))
    out: list[list[float]] = [[] for _ in columns]
    if not kept:
        return out
    of = Window.partitionBy("i")
    upto, size = F.sum("n").over(of.orderBy("lo")), F.count("*").over(of)
    placed = reduce(DataFrame.union, kept).withColumns({"upto": upto, "all": F.sum("n").over(of), "size": size, "more": F.lead("hi").over(of.orderBy("lo")).isNotNull()})
    part = lambda n: F.floor(n * most / F.col("all"))
    ends = placed.where(F.col("more") & ((F.col("size") <= most) | (part(F.col("upto")) > part(F.col("upto") - F.col("n")))))
    for r in ends.select("i", "hi").orderBy("i", "hi").collect():  # ``most`` a column at most
        out[r["i"]].append(r["hi"])
    return out
