"""Pivots, grids, bins and splits (RSH)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import keep_first, running_total
from .stages import settled


def grid(df: DataFrame, row: str, column: str, values: DataFrame | None = None) -> DataFrame:
    """Every row value with every column value: the distinct categories of
    ``column``, which must be few, are exploded on each row value."""
    rows = (values if values is not None else df.select(row)).dropna().distinct()
    levels = df.agg(F.sort_array(F.collect_set(column)).alias("v")).scalar()
    return rows.withColumn(column, F.explode(levels))


def crosstab(df: DataFrame, row: str, column: str, value: Column | None = None, to: str = "n") -> DataFrame:
    """RSH-1..4: long crosstab with 0 for missing cells."""
    counts = df.dropna(subset=[row, column]).groupBy(row, column).agg((value if value is not None else F.count("*")).alias(to))
    return grid(df, row, column).join(counts, [row, column], "left").withColumn(to, F.coalesce(F.col(to), F.lit(0)))


def cumulative_crosstab(df: DataFrame, row: str, column: str, to: str = "n", filled: bool = True) -> DataFrame:
    """RSH-1..3, WIN-1: running totals down the rows of each column; unfilled, a
    missing cell stays null and the total goes on behind it."""
    cells = crosstab(df, row, column, None, to)
    total = running_total(F.col(to), [column], [F.col(row)])
    return cells.withColumn("total", total if filled else F.when(F.col(to) > 0, total))


def years_filled(df: DataFrame, year: str, by: str, value: str) -> DataFrame:
    """RSH-10, 12: every year between first and last for each group, 0 where none."""
    span = df.agg(F.min(year).alias("lo"), F.max(year).alias("hi")).where("lo is not null")
    spine = span.select(F.explode(F.sequence("lo", "hi")).alias(year))
    return grid(df, year, by, spine).join(df.select(year, by, value), [year, by], "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)))


def dense_index(c: str) -> Column:
    """RSH-11: 0-based rank of distinct values; for small result tables."""
    return F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(c)) - 1


def range_bins(df: DataFrame, column: str, width: float, most: int = 100_000) -> DataFrame:
    """RSH-19..21, AGG-6: right-closed bins of equal width from 0 with all empty
    bins up to the largest value; values that are no numbers get their own rows.

    A value beyond ``most`` bins is an error: every empty bin is a row, so an
    outlier needs a larger width or a filter.
    """
    n = F.col(column).cast("string").try_cast("double")
    numbered = df.select(n.alias("v"), F.col(column).cast("string").alias("t")).where("t is not null")
    tops = numbered.select(F.ceil(F.col("v") / width).cast("long").alias("bin"), "v", "t")
    counts = tops.groupBy(F.when(F.col("v").isNull(), F.col("t")).alias("other"), F.when(F.col("v") > 0, F.col("bin")).alias("bin")).agg(F.count("*").alias("count"))
    within = F.when(F.col("top") <= most, F.col("top")).otherwise(F.raise_error(F.format_string("the largest value is in bin %d, more than %d are not listed", F.col("top"), F.lit(most))).cast("long"))
    spine = counts.agg(F.max("bin").alias("top")).where("top is not null").select(F.explode(F.sequence(F.lit(1).cast("long"), within)).alias("bin"))
    edge = lambda c: F.ceil(c * (width * 100)) / 100
    label = F.format_string("%.2f-%.2f", edge(F.col("bin") - 1), edge(F.col("bin")))
    binned = spine.join(counts.where("bin is not null").select("bin", "count"), "bin", "left").select(label.alias("label"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))
    return binned.unionByName(counts.where("other is not null").select(F.col("other").alias("label"), F.col("count").cast("long")))


def bin_edges(n: int, width: float) -> Column:
    """RSH-20: multiples of the width, rounded up to two decimals."""
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.ceil(i * width * 100) / 100)


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    """RSH-5..7, ML-54."""
    return df.unpivot(list(ids), list(values), name, value)


def pivoted(df: DataFrame, row: Sequence[str], column: str, levels: Sequence[str], value: Column, to: str = "{}") -> DataFrame:
    """RSH-8, 9, 23: one column per known level, by conditional aggregates in one pass."""
    return df.groupBy(*row).agg(*[F.max(F.when(F.col(column) == v, value)).alias(to.format(v)) for v in levels])


def wide_predictions(store: DataFrame, key: str, method: str, levels: Sequence[str], provider: str, prefer: str, ident: str, count: str, regions: str) -> DataFrame:
    """RSH-23, JOIN-30: per entity and method the preferred provider's newest row, spread wide."""
    order = [(F.col(provider) != prefer).cast("int"), F.col(ident).desc()]
    best = keep_first(store, [key, method], order)
    cells = [x for v in levels for x in (F.max(F.when(F.col(method) == v, F.col(count))).alias(f"{v}_count"), F.max(F.when(F.col(method) == v, F.col(regions))).alias(f"{v}_regions"))]
    return best.groupBy(key).agg(*cells)


def long_predictions(wide: DataFrame, key: str, levels: Sequence[str], accession: DataFrame) -> DataFrame:
    """RSH-24: a row per accession and method; entities without accession get a surrogate."""
    each = F.array(*[F.struct(F.lit(v).alias("method"), F.col(f"{v}_count").alias("tm_count"), F.col(f"{v}_regions").alias("tm_regions")) for v in levels])
    rows = wide.select(key, F.inline(each)).where("tm_count is not null or tm_regions is not null")
    return rows.join(accession, key, "left").withColumn("uniprot_id", F.coalesce("uniprot_id", F.concat(F.lit("PDB:"), F.col(key))))


def exploded(df: DataFrame, c: str, separator: str, to: str) -> DataFrame:
    """RSH-14: trimmed items of a delimited text; blanks are dropped."""
    return df.withColumn(to, F.explode(F.split(c, separator))).withColumn(to, F.trim(to)).where(F.col(to) != "")


def split_columns(df: DataFrame, c: str, separator: str, names: Sequence[str], limit: int = -1) -> DataFrame:
    """RSH-15, 16: parts of a text as columns, null where there is no part."""
    parts = F.split(F.col(c), separator, limit)
    return df.withColumns({n: F.trim(F.get(parts, F.lit(i))) for i, n in enumerate(names)})


def aligned_rows(df: DataFrame, lists: Sequence[str]) -> DataFrame:
    """RSH-13: array columns exploded in step."""
    other = [c for c in df.columns if c not in lists]
    return df.select(*other, F.inline(F.arrays_zip(*lists)))


def first_struct(df: DataFrame, c: str, schema: str) -> DataFrame:
    """RSH-17, 18: fields of the first object of a literal list as columns c_field."""
    one = F.get(F.from_json(F.replace(F.col(c), F.lit("'"), F.lit('"')), f"array<struct<{schema}>>"), F.lit(0))
    names = [f.split(":")[0] for f in schema.split(",")]
    return df.select("*", *[one[n].alias(f"{c}_{n}") for n in names])


def one_hot(df: DataFrame, c: str, levels: Sequence[str]) -> DataFrame:
    """RSH-26."""
    return df.withColumns({f"{c}_{v}": F.coalesce((F.col(c) == v).cast("int"), F.lit(0)) for v in levels})


def label_encoded(df: DataFrame, c: str, to: str) -> DataFrame:
    """RSH-27, SCL-53: rank of the sorted distinct values, -1 for null.  Values are
    dealt to ranges and ranked within each; a range's offset is the number of values
    before it."""
    levels = df.select(c).dropna().distinct()
    levels = settled(levels.repartitionByRange(c).withColumn("__part", F.spark_partition_id()))
    sizes = levels.groupBy("__part").agg(F.count("*").alias("__n"))  # a row for each range
    before = F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__part")) - F.col("__n")
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(c)) - 1 + F.col("__before")
    levels = levels.join(F.broadcast(sizes.select("__part", before.alias("__before"))), "__part").select(c, rank.cast("long").alias(to))
    return df.join(levels, c, "left").withColumn(to, F.coalesce(F.col(to), F.lit(-1).cast("long")))
