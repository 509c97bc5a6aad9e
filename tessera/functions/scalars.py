"""Column-to-Column functions for codes, text, numbers, dates and lists (SCL).

Everything stays a built-in expression, so scans prune columns and whole-stage
code generation covers it; the only Python function is ``decode_entities``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Texts that stand for a missing value.
MISSING_TEXTS = ("", "nan", "none", "null", "undefined")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
COUNTRY_RECODES = {"UK": "GB", "KO": "KR"}


def code(c: Column) -> Column:
    """Trimmed upper-case code, null becomes '' (SCL-1)."""
    return F.upper(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def text(c: Column) -> Column:
    """Trimmed text, null for blanks and words that mean missing (SCL-2)."""
    t = F.trim(c.cast("string"))
    return F.when(~F.lower(t).isin(*MISSING_TEXTS), t)


def blank_to_null(c: Column) -> Column:
    t = F.trim(c.cast("string"))
    return F.when(t != "", t)


def first_present(*cs: Column) -> Column:
    """First value that is not blank (SCL-8)."""
    return F.coalesce(*[blank_to_null(c) for c in cs])


def replaced_flag(c: Column) -> Column:
    """True for replaced, true, 1, yes, y (SCL-3)."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("replaced", "true", "1", "yes", "y"), F.lit(False))


def replaced_flag_wide(c: Column) -> Column:
    """The wider rule: also obsolete, and any number but zero (SCL-4)."""
    t = F.lower(F.trim(c.cast("string")))
    number = t.try_cast("double")
    return F.coalesce(t.isin("replaced", "obsolete", "true", "1", "yes", "y") | F.coalesce(number != 0, F.lit(False)), F.lit(False))


def replaced_label(flag: Column) -> Column:
    """Replaced / Not Replaced (SCL-5)."""
    return F.when(flag, "Replaced").otherwise("Not Replaced")


def mapping_part(c: Column, side: int) -> Column:
    """Part of ``OLD->NEW``: side 0 old, 1 new; blank parts are null (SCL-6)."""
    return blank_to_null(F.get(F.split(c, "->", 2), F.lit(side)))


def replacement(code_col: Column, mapping: Column, new: Column, canonical: Column) -> Column:
    """legacy, replacement and canonical code of a record (SCL-7)."""
    to = F.coalesce(blank_to_null(new), mapping_part(mapping, 1))
    return F.struct(
        F.coalesce(mapping_part(mapping, 0), blank_to_null(code_col)).alias("legacy"),
        to.alias("replacement"),
        F.coalesce(blank_to_null(canonical), to, blank_to_null(code_col)).alias("canonical"),
    )


def count_tolerant(c: Column) -> Column:
    """Whole number of a text, else its first signed integer (SCL-9)."""
    t = F.trim(c.cast("string"))
    return F.coalesce(t.try_cast("double").cast("long"), F.regexp_extract(t, r"-?\d+", 0).try_cast("long"))


def count_strict(c: Column) -> Column:
    """Whole number of a numeric text, else null (SCL-10)."""
    return F.trim(c.cast("string")).try_cast("double").cast("long")


def number_or_text(c: Column) -> Column:
    """struct(number, text): one of both is set, none for a blank (SCL-11)."""
    t = blank_to_null(c)
    n = t.try_cast("double")
    return F.struct(n.alias("number"), F.when(n.isNull(), t).alias("text"))


def first_number(c: Column) -> Column:
    """First unsigned decimal in a text (SCL-12; the whole number, not only its fraction)."""
    return F.regexp_extract(c.cast("string"), r"\d+(\.\d+)?", 0).try_cast("double")


def bracketed_number(c: Column) -> Column:
    """2.5 of ``[2.50]`` (SCL-13)."""
    return F.regexp_extract(c.cast("string"), r"\[(\d+\.\d+)\]", 1).try_cast("double")


def year_in_pairs(c: Column) -> Column:
    """Year of a literal like ``['year', '1999']`` (SCL-14)."""
    return F.regexp_extract(c.cast("string"), r"'year',\s*'?(\d{4})", 1).try_cast("int")


def first_year(*cs: Column) -> Column:
    """First field that starts with a four-digit year (SCL-15)."""
    return F.coalesce(*[F.regexp_extract(c.cast("string"), r"^\s*(\d{4})", 1).try_cast("int") for c in cs])


def strip_tags(c: Column) -> Column:
    """Markup removed, CR and LF become blanks, null becomes '' (SCL-16)."""
    return F.translate(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "<.*?>", ""), "\r\n", "  ")


@F.pandas_udf(StringType())
def decode_entities(s: pd.Series) -> pd.Series:
    """HTML character references decoded (SCL-17); no built-in does this."""
    import html

    return s.map(lambda x: None if x is None else html.unescape(x))


def year_month(c: Column) -> Column:
    """``1999-Jan`` (SCL-18)."""
    return F.date_format(c.cast("timestamp_ntz"), "yyyy-MMM")


def readable_time(c: Column) -> Column:
    """``1999-01-31 23:59:59`` (SCL-19)."""
    return F.date_format(c.cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")


def latest_time(c: Column) -> Column:
    """Aggregate: latest of texts that parse as times (SCL-20)."""
    return F.max(c.try_cast("timestamp_ntz"))


def month_number(c: Column) -> Column:
    """1..12 of an English month's first three letters (SCL-21)."""
    known = F.create_map(*[x for i, m in enumerate(MONTHS, 1) for x in (F.lit(m), F.lit(i))])
    return F.try_element_at(known, F.initcap(F.substring(F.trim(c), 1, 3)))


def literal_list(c: Column, of: str = "string") -> Column:
    """Array of a Python list literal or JSON list; null if it is neither (SCL-22, 24)."""
    return F.from_json(F.replace(c.cast("string"), F.lit("'"), F.lit('"')), f"array<{of}>")


def literal_mean(c: Column) -> Column:
    """Mean of a literal list of numbers, 0 if there is none (SCL-23)."""
    a = F.filter(literal_list(c, "double"), lambda x: x.isNotNull())
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(F.when(F.size(a) > 0, total / F.size(a)), F.lit(0.0))


def clean_items(a: Column) -> Column:
    """Trimmed items without blanks (SCL-25)."""
    return F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def related_codes(c: Column) -> Column:
    """Distinct upper-case codes of a literal list, in first-seen order (SCL-26)."""
    return F.array_distinct(F.transform(clean_items(literal_list(c)), lambda x: F.upper(x)))


def excerpt(c: Column, limit: int = 160) -> Column:
    """At most ``limit`` characters; longer texts are cut one short and dotted (SCL-41)."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("..."))).otherwise(t)


def recode(c: Column, to: dict[str, str]) -> Column:
    """Values replaced by a map, others kept (SCL-42, 48)."""
    if not to:
        return c
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in to.items() for x in kv]), c), c)


def ordered_pair(a: Column, b: Column, first: str) -> tuple[Column, Column]:
    """Both columns, swapped where only the second holds ``first`` (SCL-43)."""
    swap = (b == first) & (a != first)
    return F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)


def up_to_cents(c: Column) -> Column:
    """Rounded up to two decimals (SCL-44)."""
    return F.ceil(c * 100) / 100


def pretty_label(name: str) -> str:
    """Column label from its name (SCL-45)."""
    return name.replace("_", " ").strip().capitalize()


def score_band(c: Column) -> Column:
    """high from 4, medium from 2, else low (SCL-46)."""
    n = c.cast("string").try_cast("double")
    return F.when(n >= 4, "high").when(n >= 2, "medium").otherwise("low")


def as_json(*cs: Column) -> Column:
    """JSON with nulls kept (SCL-47)."""
    return F.to_json(F.struct(*cs), {"ignoreNullFields": "false"})


def record_key(*cs: Column) -> Column:
    """Key of trimmed texts (SCL-49)."""
    return F.concat_ws("\x1f", *[F.trim(F.coalesce(c.cast("string"), F.lit(""))) for c in cs])


#: pandas type names and the Spark types that hold them (SCL-50).
COLUMN_TYPES = {"int64": "bigint", "float64": "double", "datetime64[ns]": "timestamp_ntz", "bool": "boolean", "timedelta64[ns]": "interval day to second", "object": "string"}


def ordinal_of(c: Column, levels: list[str]) -> Column:
    """Position of a value among sorted levels, -1 for an unknown one (SCL-53)."""
    at = F.array_position(F.array(*[F.lit(x) for x in sorted(levels)]), c)
    return F.coalesce(F.when(at > 0, at - 1), F.lit(-1)).cast("long")
