"""Windows, ordering, paging and keep-first deduplication (WIN, SORT)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Order = Sequence[Column]


def numbered(df: DataFrame, by: Sequence[str], order: Order, to: str = "rn") -> DataFrame:
    """WIN-5, 6: row number within ``by`` (none: over everything)."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return df.withColumn(to, F.row_number().over(w.orderBy(*order)))


def keep_first(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """SORT-11..15, WIN-6, 9..14: the first row of each key in an explicit order."""
    return numbered(df, keys, order, "__rn").where("__rn = 1").drop("__rn")


def keep_first_by_key(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """SORT-11, 18: keys are compared trimmed; rows with an all-blank key stay."""
    parts = {f"__k{i}": F.trim(F.coalesce(F.col(k).cast("string"), F.lit(""))) for i, k in enumerate(keys)}
    marked = df.withColumns(parts)
    blank = F.concat(*parts) == ""
    kept = keep_first(marked.where(~blank), list(parts), order)
    return kept.unionByName(marked.where(blank)).drop(*parts)


#: SORT-13: natural keys by table.
NATURAL_KEYS = {"curated": ("pdb_code", "group", "subgroup"), "function": ("uniprot_id", "pdb_code"), "structure": ("pdb_code",), "orientation": ("pdb_code",)}


def ordered(df: DataFrame, column: str | None, direction: str, tiebreak: str, known: Sequence[str]) -> list[Column]:
    """SORT-1: sort by a known column, nulls last ascending and first descending."""
    if column is None:
        return [F.col(tiebreak).asc_nulls_last()]
    if column not in known:
        raise ValueError(f"unknown sort column {column!r}")
    c = F.col(column)
    return [c.desc_nulls_first() if direction == "desc" else c.asc_nulls_last(), F.col(tiebreak).asc_nulls_last()]


def page(df: DataFrame, order: Order, number: int = 1, size: int = 10) -> DataFrame:
    """SORT-2: one page; the order must end in a unique column."""
    number, size = max(1, number), max(1, size)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(total: int, size: int) -> int:
    return -(-total // max(1, size))


def clamped_page(total: int, number: int | None, size: int | None) -> tuple[int, int]:
    """SORT-3: page within 1..last, size within 1..200, default 25."""
    size = min(200, max(1, size or 25))
    return min(max(1, number or 1), max(1, page_count(total, size))), size


def top_slice(df: DataFrame, order: Order, start: int = 0, end: int = 50) -> DataFrame:
    """SORT-4, 5, 7: rows start..end of the order."""
    return df.orderBy(*order).offset(start).limit(end - start)


def relevance(query: str, exact: Sequence[tuple[str, str, int]], fields: Sequence[tuple[str, Sequence[str], int]]) -> tuple[Column, Column]:
    """SORT-6: (score, reasons).  ``exact``: (reason, code column, points) for
    equal codes.  ``fields``: (reason, columns, points): a column that contains
    the query scores, one that equals it scores 12 more under another reason."""
    q = query.strip().upper()
    score, why = F.lit(0), []
    for reason, c, points in exact:
        hit = F.coalesce(F.upper(F.trim(F.col(c))) == q, F.lit(False))
        score, why = score + F.when(hit, points).otherwise(0), [*why, F.when(hit, F.lit(reason))]
    for reason, cs, points in fields:
        values = [F.upper(F.trim(F.col(c))) for c in cs]
        whole = reduce(lambda a, b: a | b, [F.coalesce(v == q, F.lit(False)) for v in values])
        part = reduce(lambda a, b: a | b, [F.coalesce(v.contains(q), F.lit(False)) for v in values])
        score = score + F.when(whole, points + 12).when(part, points).otherwise(0)
        why.append(F.when(whole, F.lit(f"{reason}_exact")).when(part, F.lit(reason)))
    return score, F.filter(F.array(*why), lambda x: x.isNotNull())


def by_rank(c: Column, order: Sequence[str]) -> Column:
    """SORT-10: position in a given order, unknown values last."""
    out = F.lit(len(order))
    for i, v in enumerate(order):
        out = F.when(c == v, i).otherwise(out)
    return out


def preferred(df: DataFrame, by: Sequence[str], choice: Column, order: Sequence[str], then: Order) -> DataFrame:
    """WIN-9..11: per group the row of the most preferred choice."""
    return keep_first(df, by, [by_rank(choice, order).asc(), *then])


def running_total(value: Column, by: Sequence[str], order: Order) -> Column:
    """WIN-1."""
    return F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def share(value: Column, by: Sequence[str]) -> Column:
    """WIN-2, 3: percent of the group's sum, 0 for a sum of 0."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return F.coalesce(F.try_divide(value * 100.0, F.sum(value).over(w)), F.lit(0.0))


def zscore(value: Column, by: Sequence[str]) -> Column:
    """WIN-4: population deviation; null where it is 0."""
    w = Window.partitionBy(*by)
    return F.try_divide(value - F.avg(value).over(w), F.stddev_pop(value).over(w))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """SORT-19: a sample that depends on the keys and the seed only."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)).limit(n)


def ranked(order: Order, by: Sequence[str] = ()) -> Column:
    """WIN-8: rank with gaps, for small results if ``by`` is empty."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return F.rank().over(w.orderBy(*order))
