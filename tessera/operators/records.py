"""Composite records of the curated sources (DOM-5, 10, 14, 18, 22, 26; E1, E2).

Everything about an entity is one struct column per topic, so a filter or sort
on a part of it prunes the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import regions as G
from ..functions import rules as D
from ..functions.scalars import code, first_present, literal_list, related_codes


def structure_context(chains: Column, entities: Column, assemblies: Column) -> Column:
    """DOM-5: parsed chain, entity and assembly lists with their counts."""
    parsed = {n: F.coalesce(literal_list(c), F.array().cast("array<string>")) for n, c in (("chains", chains), ("entities", entities), ("assemblies", assemblies))}
    return F.struct(*[v.alias(n) for n, v in parsed.items()], *[F.size(v).alias(f"n_{n}") for n, v in parsed.items()], (F.size(parsed["chains"]) > 1).alias("multichain"))


def topology_summary(regions: Column) -> Column:
    """DOM-14: membrane regions counted, sides of both ends, path text and long loops."""
    kinds = F.transform(regions, lambda r: G.label_class(r["label"]))
    n = G.count_membrane(regions)
    side = lambda at: F.get(F.filter(at, lambda k: k.isin("inside", "outside")), F.lit(0))
    return F.struct(
        n.alias("tm_count"), side(kinds).alias("n_side"), side(F.reverse(kinds)).alias("c_side"),
        F.when(n == 0, "none").when(n == 1, "bitopic").otherwise("polytopic").alias("kind"),
        F.array_join(kinds, " > ").alias("path"), F.size(F.filter(G.large(regions), lambda r: ~G.is_membrane(r["label"]))).alias("long_loops"),
    )


def with_identity(df: DataFrame, own: str, mapping: str, new: str, canonical: str, related: str) -> DataFrame:
    """DOM-22: normalised codes, replacement fields and related codes of a record."""
    return df.withColumns({
        own: code(F.col(own)),
        "canonical": D.canonical_code(F.col(own), first_present(F.col(new), F.get(F.split(mapping, "->", 2), F.lit(1))), F.col(canonical)),
        "related": F.coalesce(related_codes(F.col(related)), F.array().cast("array<string>")),
    })


def with_old_names(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """DOM-26: fields repeated under their old names."""
    return df.select("*", *[F.col(c).alias(old) for old, c in names.items() if old not in df.columns])


def candidates(records: DataFrame, reviews: DataFrame, notes: DataFrame, key: str, labels: list[str], counts: list[str], words: str, replaced: str, boundary: str) -> DataFrame:
    """DOM-18, E2: a record with its disagreement, assessment, review, notes,
    decision and status.  Reviews and notes hold one row per entity."""
    rows = records.join(reviews, key, "left").join(notes, key, "left")
    none = F.lit(False)
    rows = rows.withColumns({
        "disagreement": D.disagreement([F.col(c) for c in labels], [F.col(c) for c in counts], F.col(boundary)),
        "assessment": D.assessment(F.col(key), F.col(words), F.col(replaced)),
    })
    flagged = F.col("assessment.state_dependent") | F.col("assessment.soluble_to_membrane_transition") | F.col("assessment.not_membrane_protein_candidate")
    agrees = F.coalesce(D.disagreement_bucket(F.col(labels[0])) == D.disagreement_bucket(F.col(labels[1])), none)
    same = F.coalesce(F.col(counts[0]) == F.col(counts[1]), F.col(counts[0]).isNull())
    rows = rows.withColumn("decision", D.decision(F.col("disagreement.any"), F.col("review_status"), F.col(labels[0]).isNull() & F.col(counts[0]).isNull(), F.col(replaced), flagged, F.col(boundary), agrees, same))
    rejected = F.coalesce(F.lower(F.trim("review_status")) == "rejected", none)
    return rows.withColumn("status", D.status(F.col("decision.include"), F.col("decision.high_confidence"), F.col("assessment.recommended"), rejected))


def export_rows(candidates: DataFrame, key: str) -> DataFrame:
    """DOM-10: the candidate's structs as flat columns, lists as JSON."""
    out = [F.col(key), F.col("status"), F.col("review_status")]
    for topic in ("disagreement", "assessment", "decision"):
        for f in candidates.schema[topic].dataType.fields:
            c = F.col(f"{topic}.{f.name}")
            out.append((F.to_json(c) if f.dataType.typeName() == "array" else c).alias(f"{topic}_{f.name}"))
    return candidates.select(*out)


def predicted(df: DataFrame, ident: str, sequence: str, predictors: dict[str, Callable[[list[str]], list[str]]], batch: int = 64) -> DataFrame:
    """UDF-6, 7: (id, method, topology) of every predictor on every sequence.

    A predictor maps a list of sequences to their topologies; sequences go to it
    in batches, in the tasks that hold them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), batch):
                part = b.iloc[i : i + batch]
                for name, predict in predictors.items():
                    yield pd.DataFrame({"id": part["id"], "method": name, "topology": predict(part["seq"].tolist())})

    return df.select(F.col(ident).cast("string").alias("id"), F.col(sequence).alias("seq")).where("seq is not null").mapInPandas(run, "id string, method string, topology string")


#: Residues counted as hydrophobic, and the charged atoms of salt bridges.
HYDROPHOBIC = ("ALA", "VAL", "LEU", "ILE", "MET", "PHE", "TRP", "PRO")
POSITIVE = (("LYS", "NZ"), ("ARG", "NH1"), ("ARG", "NH2"), ("HIS", "ND1"), ("HIS", "NE2"))
NEGATIVE = (("ASP", "OD1"), ("ASP", "OD2"), ("GLU", "OE1"), ("GLU", "OE2"))


def atoms(lines: DataFrame, entity: str, value: str = "value") -> DataFrame:
    """Atom records of fixed-width structure lines: entity, atom, residue, number, x, y, z."""
    at = lambda a, n: F.trim(F.substring(value, a, n))
    rows = lines.where(F.substring(value, 1, 6) == "ATOM  ")
    return rows.select(entity, at(13, 4).alias("atom"), at(18, 3).alias("residue"), F.concat(at(22, 1), at(23, 4)).alias("number"), *[at(31 + 8 * i, 8).try_cast("double").alias(c) for i, c in enumerate("xyz")])


def geometry(rows: DataFrame, entity: str) -> DataFrame:
    """ML-44: radius of gyration, extent, hydrophobic share and salt bridges of
    each structure.  Extent is the diagonal of the bounding box; bridges come
    from an equality join on grid cells of 4 length units."""
    side = lambda c: F.pow(F.max(c) - F.min(c), F.lit(2))
    ca = F.col("atom") == "CA"
    shape = rows.groupBy(entity).agg(
        F.count("*").alias("atoms"), F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("gyration"), F.sqrt(side("x") + side("y") + side("z")).alias("extent"),
        F.coalesce(F.try_divide(F.count_if(ca & F.col("residue").isin(*HYDROPHOBIC)).cast("double"), F.count_if(ca)), F.lit(0.0)).alias("hydrophobic"),
    )
    cell = F.array(*[F.floor(F.col(c) / 4).cast("long") for c in "xyz"])
    charged = lambda which: rows.where(F.struct("residue", "atom").isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in which]))
    shifts = F.array(*[F.array(*[F.lit(s).cast("long") for s in (i, j, k)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    p = charged(POSITIVE).select(entity, cell.alias("cell"), F.col("number").alias("p"), *[F.col(c).alias(f"p{c}") for c in "xyz"])
    n = charged(NEGATIVE).select(entity, F.explode(F.transform(shifts, lambda s: F.zip_with(cell, s, lambda a, b: a + b))).alias("cell"), F.col("number").alias("n"), *[F.col(c).alias(f"n{c}") for c in "xyz"])
    d = sum((F.pow(F.col(f"p{c}") - F.col(f"n{c}"), F.lit(2)) for c in "yz"), F.pow(F.col("px") - F.col("nx"), F.lit(2)))
    bridges = p.join(n, [entity, "cell"]).where(d <= 16.0).groupBy(entity).agg(F.count_distinct("p", "n").alias("salt_bridges"))
    return shape.join(bridges, entity, "left").withColumn("salt_bridges", F.coalesce("salt_bridges", F.lit(0)))
