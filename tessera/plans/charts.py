"""Tidy frames that charts are drawn from (VIZ); drawing is left to the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import recode
from ..operators.aggregates import group_count
from ..operators.ranking import share
from ..sources.readers import table
from .registry import registry

query, QUERIES, ORACLE_SQL = registry()


def selection_counts(df: DataFrame, by: Sequence[str], **within: tuple[float, float] | Sequence[str]) -> DataFrame:
    """VIZ-2: counts by category of the rows in a chart's selection: value lists
    for categories, (low, high) for axes."""
    for c, chosen in within.items():
        numbers = len(chosen) == 2 and all(isinstance(x, (int, float)) for x in chosen)
        df = df.where(F.col(c).between(*chosen) if numbers else F.col(c).isin(*chosen))
    return group_count(df, *by)


def short_labels(c: Column, phrases: dict[str, str]) -> Column:
    """VIZ-3: long phrases cut short inside labels."""
    for long, short in phrases.items():
        c = F.replace(c, F.lit(long), F.lit(short))
    return c


def group_bars(df: DataFrame, group: str, names: dict[str, str]) -> DataFrame:
    """VIZ-1, VIZ-4: bars in rising order of their counts, with their share."""
    counts = group_count(df.withColumn(group, recode(F.col(group), names)), group)
    return counts.withColumn("percent", share(F.col("count"), [])).orderBy("count", group)


@query("SELECT c_mktsegment, count(*) AS count FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal BETWEEN 0 AND 5000 GROUP BY 1")
def chart_selection(spark, d):
    """VIZ-2, VIZ-6."""
    return selection_counts(table(spark, d, "customer"), ["c_mktsegment"], c_mktsegment=["BUILDING", "MACHINERY"], c_acctbal=(0, 5000))


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'Group 1' WHEN 'O' THEN 'Group 2' ELSE o_orderstatus END AS o_orderstatus, count(*) AS count, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percent FROM orders GROUP BY 1")
def chart_group_bars(spark, d):
    """VIZ-1, VIZ-3, VIZ-4, UDF-5."""
    names = {"F": "Group One", "O": "Group Two"}
    bars = group_bars(table(spark, d, "orders", ["o_orderstatus"]), "o_orderstatus", names)
    return bars.withColumns({"o_orderstatus": short_labels(F.col("o_orderstatus"), {"One": "1", "Two": "2"}), "percent": F.round("percent", 6)})


@query("SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority)::BIGINT AS place FROM orders")
def ranks_with_gaps(spark, d):
    """WIN-8."""
    from ..operators.ranking import ranked

    return table(spark, d, "orders").select("o_orderkey", ranked([F.col("o_orderpriority").asc()], ["o_custkey"]).cast("long").alias("place"))


@query("SELECT o_orderstatus, round(avg(o_totalprice), 3) AS o_totalprice_mean, round(stddev_samp(o_totalprice), 3) AS o_totalprice_std FROM orders GROUP BY 1")
def run_means(spark, d):
    """AGG-48."""
    from ..operators.aggregates import run_means as means

    out = means(table(spark, d, "orders"), ["o_orderstatus"], ["o_totalprice"])
    return out.withColumns({c: F.round(c, 3) for c in out.columns[1:]})


@query("SELECT n_name, m AS method FROM nation, (VALUES ('a'), ('b')) v(m) WHERE n_name <> '' AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 7000 AND m = 'a')")
def pending_work(spark, d):
    """JOIN-32, STR-5."""
    from ..operators.joins import pending

    nation = table(spark, d, "nation")
    store = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", F.lit("a").alias("method"), "s_acctbal")
    return pending(nation, store, "n_name", F.upper(F.trim("n_name")), ["a", "b"], F.col("s_acctbal") > 7000)
