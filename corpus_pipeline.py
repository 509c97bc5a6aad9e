"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next stage's ``docs``.  All but the last return the
columns of ``documents``.

Defined cases: a null text is the empty text; further columns are carried along
by all stages but the last, whatever their names; repeated rows are scored
alike, and exact dedup keeps one of them (of a null and another doc_id the
other); very long texts are whole in every stage; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, mixing, piece_bpe, simhash, toxicity
from tessera.llm.common import Scratch
from tessera.llm.queries import mix_tree, piece_model_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts alike at 0.8 or more in five-word shingles one stays."""
    return simhash.drop_near_copies(docs, width=5, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens, by the tree's weights, each document once at most."""
    domain, weights = mix_tree()
    return mixing.mix_documents(docs, domain, weights, budget_share=0.8, max_epochs=1, seed=17)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the hash of the text they decode to."""
    out = piece_bpe.encode_documents(docs, piece_model_file())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing", mix),
    ("SentencePiece", encode),
]

#: The trained scores, XXH64 fingerprints and merges have no SQL form; the
#: stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for k, (_, stage) in enumerate(STAGES):
            out = stage(spark, docs, sf_dir)
            if k + 1 == len(STAGES):
                scratch.keep(docs)  # the result still reads it
                return out
            written = scratch.write(out, "stage")
            if k:
                scratch.drop(docs)
            docs = written
    return docs
