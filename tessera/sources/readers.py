"""Sources: files landed for the engine, read with explicit schemas (SRC)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.filters import existing


def table(spark: SparkSession, folder: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """SRC-1..4: a Parquet table; unknown column names are left out."""
    return existing(spark.read.parquet(f"{folder}/{name}.parquet"), columns)


def paged(df: DataFrame, column: str | None, value: object, order: Column, number: int, size: int) -> tuple[DataFrame, DataFrame]:
    """SRC-5: (page, one-row total); the same filter holds for both."""
    rows = df.where(F.col(column) == value) if column is not None and value is not None else df
    return rows.orderBy(order).offset((max(1, number) - 1) * size).limit(size), rows.agg(F.count("*").alias("total"))


def projection(spec: Sequence[str]) -> list[Column]:
    """SRC-6: columns of texts like ``t.*``, ``a as b``, ``t.c`` or ``c``."""
    out = []
    for s in spec:
        m = re.fullmatch(r"\s*([\w.*]+)(?:\s+as\s+(\w+))?\s*", s, re.IGNORECASE)
        if not m:
            raise ValueError(f"can't read column {s!r}")
        out.append(F.col(m.group(1)).alias(m.group(2)) if m.group(2) else F.col(m.group(1)))
    return out


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def csv(spark: SparkSession, path: str, schema: T.StructType | str, **options: str) -> DataFrame:
    """SRC-7, 8, 34: CSV with a header; a missing file is an empty frame."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).options(header="true", **options).csv(path)


def latest_dated(spark: SparkSession, folder: str, base: str) -> str | None:
    """SRC-9: path of ``base_YYYY-MM-DD.csv`` with the latest date, undated ones first."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    dated = [(m.group(1) or "", n) for n in names if (m := re.fullmatch(rf"{re.escape(base)}(?:_(\d{{4}}-\d\d-\d\d))?\.csv", n))]
    return f"{folder}/{max(dated)[1]}" if dated else None


PROTEIN = "pdbCode string, name string, species string, resolution string, memberProteins struct<memberProtein:array<struct<pdbCode:string,name:string,species:string,resolution:string>>>"
TREE = f"name string, subgroups struct<subgroup:array<struct<name:string,proteins:struct<protein:array<struct<{PROTEIN.replace(' string', ':string').replace(' struct', ':struct').replace(', ', ',')}>>>>>>"


def curated_xml(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10, 11: groups, subgroups and proteins of a tree as rows; a protein
    and each of its members is a row of its own."""
    groups = spark.read.format("xml").option("rowTag", "group").schema(TREE).load(path)
    proteins = groups.select(F.col("name").alias("group"), F.explode("subgroups.subgroup").alias("s")).select("group", F.col("s.name").alias("subgroup"), F.explode("s.proteins.protein").alias("p"))
    fields = ("pdbCode", "name", "species", "resolution")
    own = F.struct(*[F.col(f"p.{f}").alias(f) for f in fields], F.lit(True).alias("is_master"))
    members = F.transform(F.coalesce(F.col("p.memberProteins.memberProtein"), F.array()), lambda m: F.struct(*[m[f].alias(f) for f in fields], F.lit(False).alias("is_master")))
    return proteins.select("group", "subgroup", F.inline(F.concat(F.array(own), members)))


def json_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """SRC-12..14: landed JSON documents, one a line."""
    return spark.read.schema(schema).json(path)


def first_of(*landed: tuple[DataFrame, str]) -> DataFrame:
    """SRC-14, 19: records of the first source, and of the next ones for keys it lacks."""
    out, key = landed[0]
    for df, _ in landed[1:]:
        out = out.unionByName(df.join(out.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)
    return out


def annotation_terms(df: DataFrame, references: str) -> DataFrame:
    """SRC-15: ontology terms by their one-letter prefix into three text columns."""
    def routed(letter: str) -> Column:
        hit = F.filter(F.col(references), lambda r: r["term"].startswith(f"{letter}:"))
        return F.array_join(F.transform(hit, lambda r: F.substring(r["term"], 3, 1_000_000)), "; ")

    return df.withColumns({"molecular_function": routed("F"), "cellular_component": routed("C"), "biological_process": routed("P")})


def mapping(df: DataFrame, entity: str, accession: str) -> DataFrame:
    """SRC-18: distinct pairs without nulls."""
    return df.select(F.upper(F.trim(entity)).alias(entity), F.trim(accession).alias(accession)).where(f"{entity} <> '' and {accession} <> ''").dropna().distinct()


def first_filled(*sources: DataFrame) -> DataFrame:
    """SRC-19: the first source with a row (each is checked by one row)."""
    for s in sources[:-1]:
        if not s.isEmpty():
            return s
    return sources[-1]


def loose_csv(spark: SparkSession, path: str, columns: Sequence[str], json_column: str, tail: int) -> DataFrame:
    """SRC-20, 21: lines whose JSON column holds unescaped commas and quotes.

    The columns before it and the ``tail`` columns after it are split off at
    commas; all between is the JSON column.
    """
    at = list(columns).index(json_column)
    parts = F.split("value", ",", -1)
    n = F.size(parts)
    middle = F.array_join(F.slice(parts, F.lit(at + 1), n - at - tail), ",")
    picked = [F.get(parts, F.lit(i)) if i < at else middle if i == at else F.get(parts, n - (len(columns) - i)) for i in range(len(columns))]
    lines = spark.read.text(path).where(~F.col("value").startswith(columns[0] + ","))
    clean = lambda c: F.regexp_replace(F.trim(c), r'^"|"$', "")
    return lines.where(n >= len(columns)).select(*[clean(p).alias(c) for p, c in zip(picked, columns, strict=True)])


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """SRC-26: (id, sequence) of records that begin with ``>``."""
    blocks = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    lines = F.split("value", r"\r?\n")
    return blocks.select(F.trim(F.get(lines, F.lit(0))).alias("id"), F.regexp_replace(F.array_join(F.slice(lines, 2, 1_000_000), ""), r"\s", "").alias("sequence"))


def three_line(spark: SparkSession, path: str) -> DataFrame:
    """SRC-27: (id, sequence, topology) of header, sequence and label lines."""
    blocks = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    good = F.when(F.size(lines) == 3, lines).otherwise(F.raise_error(F.lit("a record is not three lines long")))
    return blocks.select(good.alias("l")).select(*[F.trim(F.get("l", F.lit(i))).alias(n) for i, n in enumerate(("id", "sequence", "topology"))])


def gff(spark: SparkSession, path: str) -> DataFrame:
    """SRC-28: (id, type, start, end) of tab-separated features, in either of
    two layouts: nine columns, or id, type, start, end."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    p = F.split("value", "\t")
    nine = F.size(p) >= 8
    at = lambda a, b: F.when(nine, F.get(p, F.lit(a))).otherwise(F.get(p, F.lit(b)))
    return rows.select(F.trim(at(0, 0)).alias("id"), F.trim(at(2, 1)).alias("type"), at(3, 2).try_cast("int").alias("start"), at(4, 3).try_cast("int").alias("end"))


def gff_counts(spark: SparkSession, path: str) -> DataFrame:
    """SRC-29: regions per id: the stated number, else the number of TMhelix rows."""
    said = spark.read.text(path).select(F.regexp_extract("value", r"^#\s*(\S+)\s+Number of predicted TMRs:\s*(\d+)", 1).alias("id"), F.regexp_extract("value", r"Number of predicted TMRs:\s*(\d+)", 1).try_cast("long").alias("stated")).where("id <> '' and stated is not null")
    rows = gff(spark, path).groupBy("id").agg(F.count_if(F.lower("type") == "tmhelix").alias("counted"))
    return rows.join(said, "id", "full").select("id", F.coalesce("stated", "counted").alias("tm_count"))


def countries(spark: SparkSession, path: str | None = None) -> DataFrame:
    """SRC-32: code and name of countries from a file; some built in without one."""
    if path and exists(spark, path):
        return csv(spark, path, "code string, name string")
    # The fallback's countries.
    built_in = "US United States|GB United Kingdom|DE Germany|FR France|ES Spain|IT Italy|JP Japan|CN China|KR South Korea|IN India|CA Canada|AU Australia|CH Switzerland|SE Sweden|NL Netherlands|DK Denmark|IL Israel|BR Brazil"
    return spark.createDataFrame([tuple(x.split(" ", 1)) for x in built_in.split("|")], "code string, name string")
