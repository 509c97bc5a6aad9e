"""Mean shift (ML-27) from binned seeds.

Seeds are the bins of side ``bandwidth`` that hold rows.  In each round a seed
moves to the mean of the rows within ``bandwidth``, which an equality join on
cells brings together and one grouping adds up; equal positions are one row with
a weight, so a position that holds a third of all rows costs one.  Seeds that
have come to rest are done.  Of modes closer than ``bandwidth`` the one with most
rows stays, and every row goes to its nearest mode.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nearest import nearest
from .stages import settled


def _cell(names: Sequence[str], side: float) -> Column:
    return F.array(*[F.floor(F.col(n) / side).cast("long") for n in names])


def _around(dims: int) -> Column:
    shifts = F.array(*[F.array(*[F.lit(s).cast("long") for s in step]) for step in itertools.product((-1, 0, 1), repeat=dims)])
    return F.explode(F.transform(shifts, lambda s: F.zip_with(F.col("cell"), s, lambda p, q: p + q)))


def _near(x: Sequence[str], y: Sequence[str], reach: float) -> Column:
    parts = [F.pow(F.col(a) - F.col(b), F.lit(2)) for a, b in zip(x, y, strict=True)]
    return sum(parts[1:], parts[0]) <= reach * reach


def _peaks(modes: DataFrame, dims: int, bandwidth: float) -> DataFrame:
    """Modes of which no other that stays, with more rows, lies within reach; of
    equal ones the first id.  Each round keeps what is first around it and drops
    what those reach."""
    s, t = [f"s{c}" for c in range(dims)], [f"t{c}" for c in range(dims)]
    left = settled(modes.select("id", "n", *s, _cell(s, bandwidth).alias("cell")))
    kept = None
    while not left.isEmpty():
        other = left.select(F.col("id").alias("other"), F.col("n").alias("m"), *[F.col(a).alias(b) for a, b in zip(s, t, strict=True)], _around(dims).alias("cell"))
        pairs = settled(left.join(other, "cell").where((F.col("id") != F.col("other")) & _near(s, t, bandwidth)).select("id", "other", "n", "m"))
        beaten = pairs.where((F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("other") < F.col("id")))).select("id").distinct()
        first = settled(left.join(beaten, "id", "left_anti"))
        gone = pairs.join(first.select(F.col("id").alias("other")), "other", "left_semi").select("id").unionByName(first.select("id")).distinct()
        kept = first if kept is None else kept.unionByName(first)
        left = settled(left.join(gone, "id", "left_anti"))
    return modes.limit(0).select("id", "n", *s) if kept is None else kept.select("id", "n", *s)


def mean_shift(df: DataFrame, key: str, columns: Sequence[str], bandwidth: float, least: int = 1, most: int = 300) -> DataFrame:
    """``df`` with the number of its mode's rows, mode_size, and where it lies, mode.

    Bins with fewer than ``least`` rows are no seeds; a seed rests when it moves by
    less than a thousandth of the bandwidth, and after ``most`` rounds in any case.
    Few columns.  Rows with a null or non-finite number get no mode (null).
    """
    dims = len(columns)
    x, s = [f"x{c}" for c in range(dims)], [f"s{c}" for c in range(dims)]
    fine = F.lit(True)
    for c in columns:
        fine = fine & F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))
    rows = df.where(fine).select(*[(F.col(c).cast("double") + 0.0).alias(n) for c, n in zip(columns, x, strict=True)])
    rows = settled(rows.groupBy(*x).agg(F.count("*").alias("w")).withColumn("cell", _cell(x, bandwidth)))
    bins = F.array(*[F.rint(F.col(n) / bandwidth) for n in x])
    seeds = rows.groupBy(bins.alias("bin")).agg(F.sum("w").alias("w")).where(F.col("w") >= least)
    moving = settled(seeds.select(F.array_join(F.col("bin").cast("array<string>"), ",").alias("id"), *[(F.get("bin", F.lit(c)) * bandwidth).alias(n) for c, n in enumerate(s)]))
    resting = None
    for _ in range(most):
        asked = moving.withColumn("cell", _cell(s, bandwidth)).select("id", *s, _around(dims).alias("cell"))
        met = asked.join(rows, "cell").where(_near(x, s, bandwidth))
        mean = [(F.sum(F.col(a) * F.col("w")) / F.sum("w")).alias(f"m{c}") for c, a in enumerate(x)]
        moved = met.groupBy("id").agg(F.sum("w").alias("n"), *mean, *[F.first(b).alias(b) for b in s])
        still = _near([f"m{c}" for c in range(dims)], s, 1e-3 * bandwidth)
        moved = settled(moved.select("id", "n", still.alias("still"), *[F.col(f"m{c}").alias(b) for c, b in enumerate(s)]))
        done = moved.where("still").drop("still")
        resting = done if resting is None else resting.unionByName(done)
        moving = moved.where("not still").select("id", *s)
        if moving.isEmpty():
            break
    else:
        resting = resting.unionByName(moved.where("not still").drop("still"))
    peaks = settled(_peaks(settled(resting), dims, bandwidth))
    modes = _nearest_modes(rows, peaks, x, s)
    out = df.withColumn("__q", F.when(fine, F.array(*[F.col(c).cast("double") + 0.0 for c in columns])))
    return out.join(modes, out["__q"] == modes["q"], "left").drop("__q", "q")


def _nearest_modes(rows: DataFrame, peaks: DataFrame, x: Sequence[str], s: Sequence[str]) -> DataFrame:
    found = nearest(rows, peaks.withColumnsRenamed(dict(zip(s, x, strict=True))), x, ["id"], 1)
    sizes = peaks.select("id", F.col("n").alias("mode_size"), F.array(*s).alias("mode"))
    return found.join(sizes, "id").select("q", "mode_size", "mode")
