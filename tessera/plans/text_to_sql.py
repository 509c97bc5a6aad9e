"""Selections over related tables (T2S): filters as (field, comparison, value)
and the columns wanted, applied as Column expressions and equality joins.

No question is parsed and no SQL text is made, so nothing but a query can be
run and no value can become code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.filters import in_codes, numeric_guard
from ..operators.joins import join_path

COMPARISONS = (">=", "<=", ">", "<")
Condition = tuple[str, str, object]


def condition(field: str, comparison: str, value: object) -> Column:
    """T2S-2, 3, FLT-9: numbers are compared as numbers (texts that are none
    don't match), lists of codes without regard to case and spaces."""
    if comparison == "in":
        return in_codes(F.col(field), list(value))
    if comparison not in COMPARISONS:
        raise ValueError(f"unknown comparison {comparison!r}")
    return numeric_guard(F.col(field), comparison, float(value))


def select(tables: dict[str, DataFrame], conditions: Sequence[Condition] = (), include: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """T2S-1, 4..6, JOIN-28: the first table joined with the others on columns
    that they share (of ``keys`` only, if any are named), filtered and cut to
    ``include`` (all columns if empty).

    A field is looked up in the tables in order; each filter is applied to its
    own table, before the joins.
    """
    held = dict(tables)
    for field, comparison, value in conditions:
        owner = next((t for t, df in held.items() if field in df.columns), None)
        if owner is None:
            raise ValueError(f"no table has the field {field!r}")
        held[owner] = held[owner].where(condition(field, comparison, value))
    names = list(held)
    out = held[names[0]]
    for _, other, key in join_path({t: [c for c in df.columns if not keys or c in keys] for t, df in held.items()}) if len(held) > 1 else []:
        again = [c for c in held[other].columns if c in out.columns and c != key]
        out = out.join(held[other].drop(*again), key)
    missing = [c for c in include if c not in out.columns]
    if missing:
        raise ValueError(f"no table has the columns {missing}")
    return out.select(*include) if include else out
