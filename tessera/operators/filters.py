"""Projections and predicates built from user input (FLT)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Filter texts that mean "no filter".
PLACEHOLDERS = frozenset(("", "all", "none", "null", "undefined", "nan"))


def filter_text(value: object) -> str | None:
    """FLT-2: a filter value as text, null for a placeholder."""
    s = "" if value is None else str(value).strip()
    return None if s.lower() in PLACEHOLDERS else s


def filter_value(value: object) -> str | list[str] | None:
    """FLT-3: the same for lists, an empty list is null."""
    if isinstance(value, (list, tuple, set)):
        kept = [t for v in value if (t := filter_text(v)) is not None]
        return kept or None
    return filter_text(value)


def every(predicates: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def some(predicates: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates, F.lit(False))


def _pattern(s: str, escape: bool) -> str:
    return "%" + (re.sub(r"([\\%_])", r"\\\1", s) if escape else s) + "%"


def substring_filters(given: dict[str, object], escape: bool = False) -> Column:
    """FLT-4: column ILIKE %value% for each real filter, all of them."""
    return every(F.col(c).ilike(_pattern(t, escape)) for c, v in given.items() if (t := filter_text(v)) is not None)


def global_search(term: str | None, columns: Sequence[str], escape: bool = False) -> Column:
    """FLT-5: every word of the term in some column."""
    words = (filter_text(term) or "").split()
    return every(some(F.coalesce(F.col(c).ilike(_pattern(w, escape)), F.lit(False)) for c in columns) for w in words)


def equals_folded(c: Column, value: str) -> Column:
    """FLT-10: equal to the value, case and underscores aside."""
    return F.upper(c) == value.replace("_", " ").upper()


def in_codes(c: Column, codes: Sequence[str]) -> Column:
    """FLT-7 with a short list; use ``joins.selected`` for long ones."""
    return F.upper(F.trim(c)).isin(*sorted({x.strip().upper() for x in codes}))


def numeric_guard(c: Column, op: str, value: float) -> Column:
    """FLT-9: compare a text as a number; texts that are none don't match."""
    n = c.try_cast("double")
    return {">": n > value, ">=": n >= value, "<": n < value, "<=": n <= value, "=": n == value}[op]


def any_column_is(columns: Sequence[str], value: str) -> Column:
    """FLT-11."""
    return F.array_contains(F.array(*[F.upper(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in columns]), value.strip().upper())


def present(c: Column, kind: T.DataType) -> Column:
    """FLT-12: not null, blank, NaN or empty, by the column's type."""
    if isinstance(kind, T.StringType):
        return c.isNotNull() & (F.trim(c) != "")
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return c.isNotNull() & (F.size(c) > 0)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return c.isNotNull() & ~F.isnan(c)
    return c.isNotNull()


def existing(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """SRC-4: the named columns that exist; none named means all."""
    kept = [c for c in columns or [] if c in df.columns]
    return df.select(*kept) if kept else df


def drop_by_name(df: DataFrame, patterns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """FLT-14, 15, 21: drop columns whose name matches, but for ``keep``."""
    bad = [c for c in df.columns if c not in keep and any(re.search(p, c) for p in patterns)]
    return df.drop(*bad)


def column_profile(df: DataFrame) -> dict[str, dict[str, float]]:
    """Null share, list-like content and number of distinct values of all
    columns in one pass; the result is one row (FLT-16, 17, AGG-40, 42)."""
    aggs = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        aggs.append(F.avg((~present(c, f.dataType)).cast("int")).alias(f"null_{i}"))
        listed = F.max(F.trim(c).rlike(r"^\[.*\]$").cast("int")) if isinstance(f.dataType, T.StringType) else F.lit(0)
        aggs.append(F.coalesce(listed, F.lit(0)).alias(f"list_{i}"))
    r = df.agg(*aggs).first()
    return {f.name: {"missing": r[f"null_{i}"] or 0.0, "listed": float(r[f"list_{i}"])} for i, f in enumerate(df.schema.fields)}


def drop_sparse(df: DataFrame, threshold: float = 20.0, protected: Sequence[str] = ()) -> DataFrame:
    """FLT-16, ML-3: keep columns with at most ``threshold`` percent missing."""
    p = column_profile(df)
    return df.select(*[c for c in df.columns if c in protected or p[c]["missing"] * 100 <= threshold])


def drop_listed(df: DataFrame, exempt: Sequence[str] = ()) -> DataFrame:
    """FLT-17: drop text columns that hold a bracketed list."""
    p = column_profile(df)
    return df.select(*[c for c in df.columns if c in exempt or not p[c]["listed"]])


def split_by_type(df: DataFrame) -> tuple[list[str], list[str]]:
    """FLT-18: numeric and other column names."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return numeric, [c for c in df.columns if c not in numeric]


def short_name(name: str, strip: bool = True) -> str:
    """FLT-20: of names with over four words the first two are cut to three letters."""
    parts = name.replace("-", "_").split("_")
    if len(parts) > 4:
        parts[:2] = [p[:3] for p in parts[:2]]
    out = "_".join(parts).lower()
    return re.sub(r"[^a-z0-9_]", "", out) if strip else out


def with_short_names(df: DataFrame) -> DataFrame:
    names = [short_name(c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError("shortened column names collide")
    return df.toDF(*names)


def year_split(df: DataFrame, year: str, cutoff: int | None = None) -> tuple[DataFrame, DataFrame]:
    """FLT-26: up to the cutoff, and later; default the third newest year."""
    if cutoff is None:
        newest = [r[0] for r in df.where(F.col(year).isNotNull()).select(year).distinct().orderBy(F.desc(year)).limit(3).collect()]
        cutoff = newest[-1] if newest else 0
    return df.where(F.col(year) <= cutoff), df.where(F.col(year) > cutoff)


def search_blob(columns: Sequence[str], term: str) -> Column:
    """FLT-22..24: the term occurs in the lower-cased joined columns, literally."""
    return F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])).contains(term.lower())


def completed(count: Column, regions: Column) -> Column:
    """FLT-25: a count and regions are both there."""
    return F.coalesce(count.isNotNull() & (F.trim(regions) != ""), F.lit(False))


def done_codes(store: DataFrame, provider: str, method: str, statuses: Sequence[str], permanent: str) -> DataFrame:
    """FLT-27: codes with a wanted status, or an error that will not go away."""
    own = (F.col("provider") == provider) & (F.col("method") == method)
    ends = F.col("status").isin(*statuses) | ((F.col("status") == "error") & F.coalesce(F.col("error").rlike(permanent), F.lit(False)))
    return store.where(own & ends).select(F.upper("pdb_code").alias("pdb_code")).distinct()


def complete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """FLT-13: rows without a null in the columns, or in any."""
    return df.dropna(subset=list(columns) if columns is not None else None)


#: FLT-19: words in the names of the columns kept for each experimental method.
METHOD_COLUMNS = {"X-ray": ("resolution", "r_free", "matthews", "crystal"), "EM": ("resolution", "em_", "emd"), "NMR": ("nmr", "weight"), "multi": ("resolution", "weight")}


def method_columns(df: DataFrame, method: str) -> list[str]:
    """FLT-19: the method's numeric columns; unknown methods get those that all have in common."""
    numeric, _ = split_by_type(df)
    of = {m: {c for c in numeric if any(w in c.lower() for w in words)} for m, words in METHOD_COLUMNS.items()}
    return sorted(of.get(method, set.intersection(*of.values())))


def cleaned(df: DataFrame, clean) -> DataFrame:
    """UDF-3: a Column function on every text column."""
    return df.withColumns({f.name: clean(F.col(f"`{f.name}`")) for f in df.schema.fields if isinstance(f.dataType, T.StringType)})
