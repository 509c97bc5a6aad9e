"""Joins of curated sources (JOIN).

Build sides are reduced to one row per key before a join wherever the result
needs one match only; alternatives between keys become equality joins on
exploded aliases, never a join on an OR.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import blank_to_null
from .ranking import keep_first


def star(fact: DataFrame, *dims: tuple[DataFrame, str, str]) -> DataFrame:
    """JOIN-1, FLT-1: fact left-joined with (dimension, fact key, dimension key)."""
    out = fact
    for dim, left, right in dims:
        out = out.join(dim, out[left] == dim[right], "left")
    return out


def _prune(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return right.drop(*[c for c in right.columns if c in left.columns and c not in keys])


def full_chain(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """JOIN-3..5: full outer joins on the same keys; of columns in several
    frames the first frame's stay."""
    return reduce(lambda a, b: a.join(_prune(a, b, keys), list(keys), "full"), frames)


def left_chain(base: DataFrame, sides: Sequence[tuple[DataFrame, str]], key: str, *order: str) -> DataFrame:
    """JOIN-6: left joins on one key; each side keeps its first row per key and
    gets its suffix on clashing names."""
    out = base
    for side, suffix in sides:
        one = keep_first(side, [key], [F.col(c) for c in order])
        one = one.select(key, *[F.col(c).alias(f"{c}{suffix}" if c in out.columns else c) for c in one.columns if c != key])
        out = out.join(one, key, "left")
    return out


def fill_from(df: DataFrame, pairs: dict[str, str], prefer_right: Sequence[str] = ()) -> DataFrame:
    """JOIN-8, 9, 11: fill blanks of a column from its twin and drop the twin."""
    def filled(a: str, b: str) -> Column:
        if dict(df.dtypes)[a] == "string":
            x, y = blank_to_null(F.col(a)), blank_to_null(F.col(b))
        else:
            x, y = F.col(a), F.col(b)
        return F.coalesce(y, x) if a in prefer_right else F.coalesce(x, y)

    return df.withColumns({a: filled(a, b) for a, b in pairs.items()}).drop(*pairs.values())


def counts_with_dimension(counts: DataFrame, dim: DataFrame, key: str, count: str = "count") -> DataFrame:
    """JOIN-12: every member of the dimension, 0 where nothing was counted."""
    return counts.join(dim, key, "full").withColumn(count, F.coalesce(F.col(count), F.lit(0)))


def labelled_counts(counts: DataFrame, dim: DataFrame, key: str, label: str, unknown: str, count: str = "count") -> DataFrame:
    """JOIN-13: counted members with a label, the unknown ones named so."""
    return counts.where(F.col(count) > 0).join(dim, key, "left").withColumn(label, F.coalesce(F.col(label), F.lit(unknown)))


def with_group_stat(df: DataFrame, group: Sequence[str], stat: Column, to: str) -> DataFrame:
    """JOIN-15: a group's statistic on each of its rows.

    Aggregated and joined back, so that a group's rows need not meet in one
    task: the join of a large group is broadcast or split at run time.
    """
    stats = df.groupBy(*[F.col(c).alias(f"__g_{c}") for c in group]).agg(stat.alias(to))
    on = [df[c].eqNullSafe(stats[f"__g_{c}"]) for c in group]
    return df.join(stats, on, "left").drop(*[f"__g_{c}" for c in group])


def join_back(df: DataFrame, fine: Sequence[str], coarse: str, to: str = "n") -> DataFrame:
    """JOIN-16: counts by ``fine`` joined back on ``coarse`` alone; rows repeat
    where a coarse value lies in several fine groups."""
    counts = df.groupBy(*fine).agg(F.count("*").alias(to)).select(coarse, to)
    return df.join(counts, coarse)


def missing_pairs(left: DataFrame, names: Sequence[str], done: DataFrame, key: str, name: str) -> DataFrame:
    """JOIN-19, 20: (key, name) of a short list of names that are not done yet."""
    wanted = left.select(key).distinct().withColumn(name, F.explode(F.array(*[F.lit(n) for n in names])))
    return wanted.join(done.select(key, name).distinct(), [key, name], "left_anti")


def not_yet(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JOIN-18, STR-4: rows whose keys are not done."""
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")


def selected(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """JOIN-21: rows whose key is selected."""
    return df.join(wanted.select(key).distinct(), key, "left_semi")


def without(df: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """FLT-8: rows whose key is not excluded; unlike NOT IN, a null key stays."""
    return df.join(excluded.select(key).distinct(), key, "left_anti")


def new_rows(target: DataFrame, source: DataFrame, *keys: Sequence[str]) -> DataFrame:
    """JOIN-22: source rows that match the target on none of the keys."""
    return reduce(lambda s, k: s.join(target.select(*k).distinct(), list(k), "left_anti"), keys, source)


def aliases(df: DataFrame, columns: Sequence[str], to: str = "alias") -> DataFrame:
    """JOIN-25: one row for each different code a row goes by."""
    codes = F.array_distinct(F.filter(F.array(*[F.upper(F.trim(F.col(c))) for c in columns]), lambda x: x.isNotNull() & (x != "")))
    return df.withColumn(to, F.explode(codes))


def by_alias(df: DataFrame, columns: Sequence[str], wanted: DataFrame, key: str) -> DataFrame:
    """JOIN-25, 26, 31: rows found under any of their codes, once per wanted code."""
    code = wanted.select(F.upper(F.trim(F.col(key))).alias("alias")).distinct()
    return aliases(df, columns).join(code, "alias").dropDuplicates(["alias", *columns])


def join_path(schemas: dict[str, Sequence[str]]) -> list[tuple[str, str, str]]:
    """JOIN-27: (table, table, shared column) steps that reach every table,
    breadth first; of several shared columns the first in name order."""
    names = list(schemas)
    seen, steps, queue = {names[0]}, [], deque(names[:1])
    while queue:
        a = queue.popleft()
        for b in names:
            if b not in seen and (shared := sorted(set(schemas[a]) & set(schemas[b]))):
                seen.add(b)
                steps.append((a, b, shared[0]))
                queue.append(b)
    if len(seen) < len(names):
        raise ValueError(f"no shared column reaches {sorted(set(names) - seen)}")
    return steps


def lookup(requests: DataFrame, key: str, sources: Sequence[tuple[str, DataFrame]], value: str) -> DataFrame:
    """JOIN-33: the value from the first source that knows the key, and its name."""
    out = requests
    for name, df in sources:
        out = out.join(df.groupBy(key).agg(F.min(value).alias(f"v_{name}")), key, "left")
    found = F.coalesce(*[F.col(f"v_{n}") for n, _ in sources])
    origin = F.coalesce(*[F.when(F.col(f"v_{n}").isNotNull(), F.lit(n)) for n, _ in sources])
    return out.select(*requests.columns, found.alias(value), origin.alias("origin"))


def zipped(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """JOIN-17: columns of two frames side by side.  Rows are matched by a key
    they carry; a row's position is no property of a distributed frame."""
    return a.join(_prune(a, b, [key]), key)


def with_features(df: DataFrame, features: DataFrame, key: str, *order: str, suffix: str = "_features") -> DataFrame:
    """JOIN-29: left join with the first row of each entity; clashing names get the suffix."""
    return left_chain(df, [(features, suffix)], key, *order)


def pending(entities: DataFrame, store: DataFrame, key: str, canonical: Column, methods: Sequence[str], done: Column, limit: int | None = None) -> DataFrame:
    """JOIN-32, STR-5: (canonical code, method) still to be predicted, in order.

    Entities are first resolved to their canonical codes; ``done`` tells the
    stored rows that count as complete.
    """
    codes = entities.select(canonical.alias(key)).where(F.col(key) != "").distinct()
    out = missing_pairs(codes, methods, store.where(F.coalesce(done, F.lit(False))).select(F.upper(F.trim(key)).alias(key), "method"), key, "method")
    return out.orderBy(key, "method").limit(limit) if limit is not None else out
