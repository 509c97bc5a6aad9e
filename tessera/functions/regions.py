"""Arrays of regions: parsing, normalising, comparing (SCL-27..40, RNG).

A region is struct(start int, end int, label string); all operators are
higher-order functions on one row, so no join or explode is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REGION = "struct<start:int,end:int,label:string>"
TOLERANCE = 5
LARGE = 80
#: Sources compared at their boundaries, and labels by class.
COMPARABLE = ("opm", "tmbed", "deeptmhmm", "tmhmm", "topcons", "phobius", "scampi", "ccctop")
MEMBRANE_LABELS = ("m", "h", "b", "tm", "tmhelix", "membrane", "transmembrane", "beta", "helix")
INSIDE_LABELS = ("i", "inside", "cytoplasmic", "in")
OUTSIDE_LABELS = ("o", "outside", "extracellular", "out")
SIGNAL_LABELS = ("s", "signal", "signal peptide", "sp")


def from_text(c: Column) -> Column:
    """Regions of a JSON list, single quotes repaired; null if it is none (SCL-27)."""
    plain = F.from_json(c, f"array<{REGION}>")
    return F.coalesce(plain, F.from_json(F.replace(c, F.lit("'"), F.lit('"')), f"array<{REGION}>"))


def normalise(a: Column, least: int | None = None) -> Column:
    """Valid regions in order: ends swapped where reversed, length and index
    added, optionally clamped from below (SCL-28, 29)."""
    low = lambda r: F.least(r["start"], r["end"])
    valid = F.filter(a, lambda r: r["start"].isNotNull() & r["end"].isNotNull())
    start = (lambda r: F.greatest(low(r), F.lit(least))) if least is not None else low
    return F.transform(
        valid,
        lambda r, i: F.struct(
            (i + 1).alias("index"), start(r).alias("start"), F.greatest(r["start"], r["end"]).alias("end"), (F.greatest(r["start"], r["end"]) - start(r) + 1).alias("length"), r["label"].alias("label")
        ),
    )


def to_text(a: Column) -> Column:
    return F.to_json(a)


def from_segments(c: Column) -> Column:
    """Regions of tokens like ``1( 10- 30)`` (SCL-31)."""
    pattern = F.lit(r"\d+\(\s*(\d+)\s*-\s*(\d+)\s*\)")
    starts, ends = F.regexp_extract_all(c, pattern, F.lit(1)), F.regexp_extract_all(c, pattern, F.lit(2))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.try_cast("int").alias("start"), e.try_cast("int").alias("end"), F.lit("M").alias("label")))


def runs(c: Column) -> Column:
    """Run-length encoding of a label string: label, start, end, length (SCL-32).

    Each run is matched once; its start is the sum of the lengths before it.
    """
    parts = F.regexp_extract_all(c, F.lit(r"(?s)((.)\2*)"), F.lit(1))
    placed = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<label:string,start:int,end:int,length:int>>").alias("out")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p)).alias("at"),
            F.concat(s["out"], F.array(F.struct(F.substring(p, 1, 1).alias("label"), (s["at"] + 1).alias("start"), (s["at"] + F.length(p)).alias("end"), F.length(p).alias("length")))).alias("out"),
        ),
    )
    return placed["out"]


def with_label(a: Column, *labels: str) -> Column:
    """Runs or regions with one of the labels (SCL-33)."""
    return F.filter(a, lambda r: F.lower(r["label"]).isin(*[x.lower() for x in labels]))


def pathological(topology: Column, membrane: Column, share: float = 0.9) -> Column:
    """A topology of one label, or covered by its membrane regions (SCL-34)."""
    covered = F.aggregate(membrane, F.lit(0), lambda s, r: s + r["end"] - r["start"] + 1)
    one = F.size(F.array_distinct(F.split(topology, ""))) <= 1
    return F.coalesce(one | (covered >= F.length(topology) * share), F.lit(False))


def label_class(c: Column) -> Column:
    """membrane / inside / outside / signal / other (SCL-35)."""
    t = F.lower(F.trim(c))
    return (
        F.when(is_membrane(c), "membrane").when(t.isin(*INSIDE_LABELS) | t.startswith("in"), "inside").when(t.isin(*OUTSIDE_LABELS) | t.startswith("out"), "outside")
        .when(t.isin(*SIGNAL_LABELS) | t.contains("signal"), "signal").otherwise("other")
    )


def is_membrane(c: Column) -> Column:
    """SCL-36: exact labels, or any that speak of a membrane."""
    t = F.lower(F.trim(c))
    return F.coalesce(t.isin(*MEMBRANE_LABELS) | t.contains("membrane") | t.startswith("tm"), F.lit(False))


def count_membrane(a: Column) -> Column:
    """SCL-37."""
    return F.size(F.filter(a, lambda r: is_membrane(r["label"])))


def from_payload(c: Column) -> Column:
    """Regions of ``{"Regions": {"Region": [...]}}`` where the list may be a
    single object (SCL-38)."""
    at = F.get_json_object(c, "$.Regions.Region")
    listed = F.when(F.substring(at, 1, 1) == "[", at).otherwise(F.concat(F.lit("["), at, F.lit("]")))
    items = F.from_json(listed, "array<struct<_attributes:struct<Start:string,End:string,Loc:string>>>")
    return F.transform(items, lambda x: F.struct(x["_attributes"]["Start"].try_cast("int").alias("start"), x["_attributes"]["End"].try_cast("int").alias("end"), x["_attributes"]["Loc"].alias("label")))


def from_chain_payload(c: Column) -> Column:
    """Membrane regions of ``{"chain": [{"region": [{"seq_beg", "seq_end", "type"}]}]}`` (SCL-39)."""
    chains = F.from_json(c, "struct<chain:array<struct<region:array<struct<seq_beg:string,seq_end:string,type:string>>>>>")["chain"]
    every = F.flatten(F.transform(chains, lambda x: F.coalesce(x["region"], F.array())))
    return F.transform(F.filter(every, lambda r: r["type"] == "M"), lambda r: F.struct(r["seq_beg"].try_cast("int").alias("start"), r["seq_end"].try_cast("int").alias("end"), r["type"].alias("label")))


def sequence_of(c: Column) -> Column:
    """Sequence from either place of a payload (SCL-40)."""
    return F.coalesce(F.get_json_object(c, "$.sequence"), F.get_json_object(c, "$.Sequence.Seq"))


def signature(a: Column) -> Column:
    """Sorted (start, end) pairs (RNG-1)."""
    return F.array_sort(F.transform(a, lambda r: F.struct(F.least(r["start"], r["end"]).alias("s"), F.greatest(r["start"], r["end"]).alias("e"))))


def comparable(rows: DataFrame, source: str = "source") -> DataFrame:
    """Rows of sources that are compared at their boundaries (RNG-2)."""
    return rows.where(F.lower(F.col(source)).isin(*COMPARABLE))


def shifted(a: Column, b: Column, tolerance: int = TOLERANCE) -> Column:
    """Equally many regions and any border apart by more than the tolerance (RNG-3)."""
    far = F.exists(F.zip_with(a, b, lambda x, y: (F.abs(x["s"] - y["s"]) > tolerance) | (F.abs(x["e"] - y["e"]) > tolerance)), lambda x: x)
    return F.coalesce((F.size(a) > 0) & (F.size(a) == F.size(b)) & far, F.lit(False))


def reference_disagreement(rows: DataFrame, entity: str, source: str, regions: str, reference: str = "opm", tolerance: int = TOLERANCE) -> DataFrame:
    """Per entity with a reference: whether any predictor is shifted (RNG-4).

    One grouping with the reference as a conditional aggregate; predictors are
    compared with it by a window over the entity, no self-join.
    """
    df = comparable(rows, source).select(F.col(entity), F.lower(F.col(source)).alias("src"), signature(F.col(regions)).alias("sig"))
    ref = F.max(F.when(F.col("src") == reference, F.col("sig"))).over(Window.partitionBy(entity))
    flagged = df.withColumn("ref", ref).where(F.col("ref").isNotNull())
    return flagged.groupBy(entity).agg(F.coalesce(F.bool_or(F.when(F.col("src") != reference, shifted(F.col("ref"), F.col("sig"), tolerance))), F.lit(False)).alias("boundary_disagreement"))


def around(a: Column) -> Column:
    """Per region: index of the membrane region before and after it (RNG-5)."""
    n = F.transform(a, lambda r, i: F.when(is_membrane(r["label"]), i + 1))
    return F.transform(
        a,
        lambda r, i: F.struct(
            r["start"].alias("start"), r["end"].alias("end"), r["label"].alias("label"),
            F.array_max(F.filter(n, lambda x: x < i + 1)).alias("before"), F.array_min(F.filter(n, lambda x: x > i + 1)).alias("after"),
        ),
    )


def large(a: Column, least: int = LARGE) -> Column:
    """Regions of at least that length (RNG-6)."""
    return F.filter(a, lambda r: r["end"] - r["start"] + 1 >= least)


def stated_count(count: Column, a: Column) -> Column:
    """SCL-51: the stated number, else the number of regions."""
    return F.coalesce(F.trim(count.cast("string")).try_cast("int"), F.when(a.isNotNull(), F.size(a)))
