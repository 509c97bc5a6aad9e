"""Grouped statistics (AGG)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles
from .ranking import share
from .stages import beside

#: AGG-8, 9: aggregates by name, median besides; std and var are sample statistics.
NAMED = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_samp, "var": F.var_samp}


def group_count(df: DataFrame, *keys: str, to: str = "count") -> DataFrame:
    """AGG-1..4: rows per key; rows with a null key don't count."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias(to))


def without_values(df: DataFrame, key: str, values: Sequence[str], to: str = "count") -> DataFrame:
    """AGG-7: counts but for the named values and null."""
    return group_count(df.where(~F.col(key).isin(*values)), key, to=to)


def item_count(df: DataFrame, items: Column, to: str = "item") -> DataFrame:
    """AGG-5: frequency of the items of an array column."""
    return df.select(F.explode(items).alias(to)).where(F.col(to).isNotNull()).groupBy(to).agg(F.count("*").alias("count"))


def named_aggregates(df: DataFrame, by: Column, to: str, columns: Sequence[str], name: str) -> DataFrame:
    """AGG-8..13: one named aggregate over several columns by a group expression."""
    if name not in NAMED and name != "median":
        raise ValueError(f"unknown aggregate {name!r}; known: {', '.join([*NAMED, 'median'])}")
    if name == "median":
        rows = df.select(by.alias(to), *columns)
        out = rows.select(to).distinct()
        for c in columns:
            out = beside(out, quantiles(rows, [to], c, [0.5]).select(to, F.col("q0").alias(f"median_{c}")), [to])
        return out
    return df.groupBy(by.alias(to)).agg(*[NAMED[name](c).alias(f"{name}_{c}") for c in columns])


def many_aggregates(df: DataFrame, by: Sequence[str], column: str, names: Sequence[str]) -> DataFrame:
    """AGG-14."""
    out = df.groupBy(*by).agg(*[NAMED[n](column).alias(f"{n}_{column}") for n in names if n != "median"] or [F.count("*").alias("__n")])
    if "median" in names:
        out = beside(out, quantiles(df, by, column, [0.5]).select(*by, F.col("q0").alias(f"median_{column}")), by)
    return out.select(*by, *[f"{n}_{column}" for n in names])


def percentages(df: DataFrame, column: str, unique: str | None = None) -> DataFrame:
    """AGG-15: share of each value in percent; with ``unique``, the rows are one
    per unique value first; null counts under its own text."""
    rows = df.dropDuplicates([unique]) if unique else df
    counts = rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("None")).alias(column)).agg(F.count("*").alias("count"))
    return counts.withColumn("percentage", share(F.col("count"), []))


def tagged_counts(sources: dict[str, DataFrame], year: str) -> DataFrame:
    """AGG-18, 49, SET-1: counts by year of several sources in one long frame."""
    parts = [group_count(df, year).withColumn("source", F.lit(n)) for n, df in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def version_mark(df: DataFrame, updated: str) -> DataFrame:
    """AGG-21: (rows, latest update) as the data's version."""
    return df.agg(F.count("*").alias("n_rows"), F.max(updated).alias("latest"))


def distinct_options(c: Column, df: DataFrame, separator: str | None = None) -> DataFrame:
    """AGG-24, 25: trimmed distinct options, of a delimited list if a separator is given."""
    one = df.select(F.explode(F.split(c, separator)).alias("option")) if separator else df.select(c.alias("option"))
    return one.select(F.trim("option").alias("option")).where("option <> ''").distinct()


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """AGG-23: (column, value) of every distinct value that is not null, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(pairs)).where("value is not null").distinct()


def conditional_counts(df: DataFrame, by: Sequence[str] = (), **conditions: Column) -> DataFrame:
    """AGG-26, 27: rows that satisfy each condition, in one pass."""
    return df.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def deltas(counts: DataFrame, order: str, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """AGG-28: change against the row before."""
    from pyspark.sql import Window

    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(order)
    return counts.withColumns({f"delta_{c}": F.col(c) - F.lag(c).over(w) for c in columns})


def listed_by(df: DataFrame, by: str, columns: Sequence[str], order: str) -> DataFrame:
    """AGG-29: count and joined texts in the order of a column."""
    texts = [F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("v")))), lambda x: x["v"]), ", ").alias(c) for c in columns]
    return df.groupBy(by).agg(F.count("*").alias("count"), *texts)


def consensus(df: DataFrame, by: Sequence[str], value: str, text: str) -> DataFrame:
    """AGG-35: the group's value if it has one only, else ambiguous and null."""
    # The least and the largest are equal where there is one value only: one
    # exchange, combined before it.
    same = lambda c: F.coalesce(F.min(c) == F.max(c), F.lit(True))
    one = same(F.col(value)) & same(F.coalesce(F.col(text), F.lit("[]")))
    return df.groupBy(*by).agg(F.when(one, F.max(value)).alias(value), F.when(one, F.max(text)).alias(text), (~one).alias("ambiguous"), F.count("*").alias("n"))


def grouped_items(df: DataFrame, by: str, order: str, **fields: str) -> DataFrame:
    """AGG-36, 37: items of a group in order, and their names joined."""
    item = F.struct(F.col(order).alias("o"), *[F.col(c).alias(n) for n, c in fields.items()])
    return df.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("items"))


def note_summary(df: DataFrame, by: str, created: str, ident: str, comment: str, status: str, keep: int = 3) -> DataFrame:
    """AGG-38, WIN-12: number of notes and of open ones, the latest note and the newest few.

    Only the newest ``keep`` notes of a group are gathered.
    """
    from .ranking import numbered

    ranked = numbered(df, [by], [F.col(created).desc_nulls_last(), F.col(ident).desc()], "r")
    recent = F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= keep, F.struct("r", F.col(comment).alias("c"))))), lambda x: x["c"])
    return ranked.groupBy(by).agg(F.count("*").alias("notes"), F.count_if(F.col(status) == "open").alias("open"), F.max(created).alias("latest"), F.max(F.when(F.col("r") == 1, F.col(comment))).alias("latest_comment"), recent.alias("recent"))


def concordance(df: DataFrame, truth: str, columns: Sequence[str]) -> DataFrame:
    """AGG-46: per source matches, compared rows and share, in one pass."""
    aggs = []
    for c in columns:
        both = F.col(truth).isNotNull() & F.col(c).isNotNull()
        aggs += [F.count_if(both & (F.col(truth) == F.col(c))).alias(f"m_{c}"), F.count_if(both).alias(f"n_{c}")]
    row = df.agg(*aggs)
    each = F.array(*[F.struct(F.lit(c).alias("source"), F.col(f"m_{c}").alias("matches"), F.col(f"n_{c}").alias("compared")) for c in columns])
    return row.select(F.inline(each)).withColumn("share", F.try_divide(F.col("matches").cast("double"), F.col("compared")))


def count_errors(df: DataFrame, truth: str, columns: Sequence[str]) -> DataFrame:
    """AGG-45: per predictor n, exact hits, their share, mean absolute error and
    the sample deviation of the errors, over rows where both are there."""
    long = df.select(F.col(truth).cast("double").alias("t"), F.inline(F.array(*[F.struct(F.lit(c).alias("predictor"), F.col(c).cast("double").alias("v")) for c in columns])))
    e = F.abs(F.col("v") - F.col("t"))
    both = long.where("t is not null and v is not null")
    return both.groupBy("predictor").agg(F.count("*").alias("n"), F.count_if(e == 0).alias("exact"), F.avg((e == 0).cast("double")).alias("exact_share"), F.avg(e).alias("mae"), F.stddev_samp(e).alias("sd"))


def summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """AGG-41: count, mean, std, min, quartiles and max, exact, a row per column."""
    aggs = []
    for c in columns:
        aggs += [F.count(c), F.avg(c), F.stddev_samp(c), F.min(c), F.max(c)]
    names = ("count", "mean", "std", "min", "max")
    row = df.agg(*[a.cast("double").alias(f"a{i}") for i, a in enumerate(aggs)])
    quarters = [quantiles(df, [], c, [0.25, 0.5, 0.75]).select(F.struct("q0", "q1", "q2")).scalar() for c in columns]
    row = row.withColumns({f"q_{i}": q for i, q in enumerate(quarters)})
    each = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"a{5 * i + k}").alias(n) for k, n in enumerate(names)], *[F.col(f"q_{i}")[f"q{j}"].alias(n) for j, n in enumerate(("q25", "q50", "q75"))]) for i, c in enumerate(columns)])
    return row.select(F.inline(each))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """AGG-43, 44: Pearson correlation of each pair over rows where both are there."""
    pairs = [(a, b) for a in columns for b in columns]
    both = lambda a, b: F.corr(F.when(F.col(b).isNotNull(), F.col(a)).cast("double"), F.when(F.col(a).isNotNull(), F.col(b)).cast("double"))
    row = df.agg(*[both(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs) if a <= b])
    at = {p: i for i, p in enumerate(pairs)}
    each = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{at[min(a, b), max(a, b)]}").alias("r")) for a, b in pairs])
    return row.select(F.inline(each))


def run_means(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """AGG-48: mean and sample deviation of each metric over runs."""
    return df.groupBy(*by).agg(*[f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
