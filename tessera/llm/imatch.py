"""I-Match document fingerprints over randomised lexicon subsets.

The lexicon keeps the terms whose inverse document frequency, as a share of
that of a term in one document only, lies in a chosen band: neither the words
of every text nor those of one or two.  Document frequencies are exact and
counted over all documents.  A text's distinct lexicon terms are sorted and the
sequence is hashed, once for the whole lexicon and once for each randomised
subset of it.  Subsets come in levels of falling density, since a subset's hash
only survives an edit if none of its terms changes: dense levels tell
near-identical texts, sparse ones distant relatives.

A lexicon of up to ``BROADCAST_TERMS`` terms is sent to the executors.  Of a
larger one the commonest terms are; the texts' other terms, rare ones, are joined
with it, and those found travel to the texts' buckets with the texts.  Both ways
give the same fingerprints.  Texts are compressed where they are shuffled.

Likeness of two fingerprints: the share of equal hashes among the subsets that
are not empty in both, over the levels sparse enough to have empty subsets (all
levels, if none has).  Equal fingerprints have likeness 1.

Defined cases: a null text is the empty text; a text without lexicon terms uses
all its terms; a text without terms has the empty fingerprint, alike only to
itself; a very long text is one row's work; equal doc_ids are ordered by their
text's hash; a null doc_id comes first; columns besides id and text are not
read, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LEAST, Scratch, freed, text_of

#: The band: idf divided by the logarithm of the number of documents.
MIN_IDF, MAX_IDF = 0.3, 0.95
BROADCAST_TERMS = 1 << 22
COMMON = 1 << 12  # document frequencies from here on are not told apart when the terms to send are chosen
LEVELS = (2, 4, 6, 8, 10, 12, 14)  # a level's subsets hold a term with probability 2**-level
PER_LEVEL = 16
WIDTH = 1 + len(LEVELS) * PER_LEVEL
CHUNK_CHARS = 2_000_000
SLICE = 256  # rows of a batch that are packed or unpacked at a time
_U = np.uint64


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x ^ _U(seed * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def term_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct terms, sorted, and the text of each."""
    digest, sets = xxhash.xxh64_intdigest, [set(t.lower().split()) for t in texts]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    h = np.fromiter((digest(w.encode("utf-8", "surrogatepass")) for own in sets for w in own), np.uint64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)
    order = np.lexsort((h, doc))
    return h[order], doc


def among(h: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Which of the hashes occur in ``terms``, which is sorted."""
    return terms[np.minimum(np.searchsorted(terms, h), len(terms) - 1)] == h if len(terms) else np.zeros(len(h), bool)


def fingerprints(texts: list[str], *lexicon: np.ndarray) -> np.ndarray:
    """One row of WIDTH numbers a text; ``lexicon``: its terms' hashes, in sorted parts."""
    h, doc = term_hashes(texts)
    if not len(h):
        return np.zeros((len(texts), WIDTH), np.uint64)
    inside = np.zeros(len(h), bool)
    for part in lexicon:
        inside |= among(h, part)
    some = np.zeros(len(texts), bool)
    some[doc[inside]] = True
    inside |= ~some[doc]
    return hashed(h[inside], doc[inside], len(texts))


def hashed(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Of n texts' sorted terms: the hash of all (64 bits), then of each
    subset's (16 bits, above 0; 0 for no term)."""
    out = np.zeros((n, WIDTH), np.uint64)

    def fold(take: np.ndarray, column: int, short: bool) -> None:
        """Hash the sequence of the terms taken of each text into one number."""
        at = np.flatnonzero(take)
        if len(at):
            own = doc[at]
            begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            place = np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)]))
            total = _mix(np.add.reduceat(_mix(h[at] + place.astype(np.uint64) * _U(0x9E3779B97F4A7C15), 7), begin), column)
            out[own[begin], column] = total % _U(65535) + _U(1) if short else total | _U(1)

    fold(np.ones(len(h), bool), 0, False)
    column = 1
    for level in LEVELS:
        fields = 64 // level  # independent fields of one mixed word
        mask = _U((1 << level) - 1)
        for s in range(PER_LEVEL):
            if s % fields == 0:
                bits = _mix(h, 100 * level + s)
            fold((bits >> _U(level * (s % fields))) & mask == 0, column, True)
            column += 1
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of the fingerprints in the rows of ``a`` and ``b``, 0 to 1."""
    shape = (len(a), len(LEVELS), PER_LEVEL)
    x, y = a[:, 1:].reshape(shape), b[:, 1:].reshape(shape)
    used = (x > 0) | (y > 0)
    sparse = ~used.all(axis=2, keepdims=True) & np.ones(PER_LEVEL, bool)
    lacking = ~(used & sparse).any(axis=(1, 2))
    sparse[lacking] = True
    n = (used & sparse).sum(axis=(1, 2))
    same = ((x == y) & used & sparse).sum(axis=(1, 2))
    return np.where((a == b).all(axis=1), 1.0, same / np.maximum(n, 1))


def as_text(row: np.ndarray) -> str:
    return f"{int(row[0]):016x}" + row[1:].astype(">u2").tobytes().hex()


def frequencies(docs: DataFrame, text: str = "text", min_idf: float = MIN_IDF, max_idf: float = MAX_IDF) -> DataFrame:
    """(term, n, inside): 64-bit hashes of the terms that are not too rare, their
    document frequency and whether it lies in the band, or is too high.
    Frequencies are combined in each task before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for part in _chunks(batch["t"].tolist()):
                term, n = np.unique(term_hashes(part)[0], return_counts=True)
                held.append((term, n))
                size += len(term)
                if size > 2_000_000:
                    held = [summed(held)]
                    size = len(held[0][0])
                    if size > 1_000_000:
                        yield frame(*held.pop())
                        size = 0
        if held:
            yield frame(*summed(held))

    def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        term, at = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
        return term, np.bincount(at, np.concatenate([n for _, n in held]), minlength=len(term)).astype(np.int64)

    def frame(term: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"term": term.view(np.int64), "n": n})

    rows = max(docs.count(), 1)
    counts = docs.select(text_of(docs, text).alias("t")).mapInPandas(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    idf = (math.log(rows) - F.log("n")) / max(math.log(rows), 1e-9)
    return counts.where(idf <= max_idf).withColumn("inside", idf >= min_idf)


def lexicon(docs: DataFrame, text: str = "text", min_idf: float = MIN_IDF, max_idf: float = MAX_IDF) -> DataFrame:
    """(term): hashes of the terms whose document frequency lies in the band."""
    return frequencies(docs, text, min_idf, max_idf).where("inside").select("term")


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= CHUNK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _packed(texts: list[bytes]) -> list[bytes]:
    """Of each text's UTF-8 bytes: their number and, compressed, themselves."""
    codec = pa.Codec("zstd")
    return [len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True) for t in texts]


def _unpacked(packed: list[bytes]) -> list[str]:
    codec = pa.Codec("zstd")
    return [codec.decompress(p[8:], int.from_bytes(p[:8], "little"), asbytes=True).decode() for p in packed]


def dealt(docs: DataFrame, doc_id: str, text: str, parts: int) -> DataFrame:
    """Rows (bucket, late, id, hash, packed): texts with the buckets they go to.

    Buckets are ranges of doc_id between quantiles.  The first row of each
    bucket also goes, with ``late`` 1, to the end of the bucket before (the
    very first one to the end of the last), so that every row finds its
    successor in its own bucket.
    """
    ident = F.coalesce(docs[doc_id].cast("long"), F.lit(LEAST))
    base = docs.select(ident.alias("id"), text_of(docs, text).alias("text"))
    cut = base.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] or []
    bounds = np.unique(np.array(cut, np.int64))

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="left").astype(np.int32))

    least = base.select("id", bucket("id").alias("bucket")).groupBy("bucket").agg(F.min("id").alias("id")).orderBy("bucket").collect()  # one row a bucket
    before = {r["id"]: least[i - 1]["bucket"] for i, r in enumerate(least)}  # of the first: the last
    starts = np.array(sorted(before), np.int64)
    ends = np.array([before[s] for s in starts.tolist()], np.int32)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (whole.iloc[i : i + SLICE] for whole in batches for i in range(0, len(whole), SLICE)):
            v = batch["id"].to_numpy()
            at = np.minimum(np.searchsorted(starts, v), len(starts) - 1)
            first = np.flatnonzero(starts[at] == v)
            out = batch.assign(bucket=np.searchsorted(bounds, v, side="left"), late=0, packed=_packed(batch["text"].tolist())).drop(columns="text")
            yield pd.concat([out, out.iloc[first].assign(bucket=ends[at[first]], late=1)])[["bucket", "late", "id", "hash", "packed"]]

    # One step, so that a task has one Python worker.
    rows = base.select("id", F.xxhash64("text").alias("hash"), F.col("text").cast("binary").alias("text"))
    return rows.mapInPandas(deal, "bucket int, late int, id bigint, hash bigint, packed binary")


def in_order(rows: DataFrame, parts: int) -> DataFrame:
    """Each bucket in one partition and sorted.  This shuffles the texts, once."""
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "late", "id", "hash").select("bucket", "late", "id", "packed")


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """doc_id, n_chars, text's and edited text's fingerprints and likenesses.

    The edited text is the text with its last floor(n / 2) code points replaced
    by the first as many of the next document in the order of doc_id (of the
    first after the last).
    """
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    with Scratch(spark) as scratch:
        terms = scratch.write(frequencies(docs, text), "terms")
        freed(spark)
        rows = dealt(docs, doc_id, text, parts)
        if terms.where("inside").count() <= broadcast_terms:
            return _fingerprinted(in_order(rows, parts), _sent(terms.where("inside")))
        least = _least_sent(terms, broadcast_terms)
        common = _sent(terms.where(F.col("n") >= least))
        rare = terms.where(F.col("inside") & (F.col("n") < least)).select("term")
        found = scratch.keep(scratch.write(_rare_terms(in_order(rows, parts), common).join(rare, "term", "left_semi"), "found"))
        freed(spark)  # the texts are shuffled again, with what was found
        found = found.select("bucket", F.lit(-1).alias("late"), F.col("term").alias("id"), F.lit(0).cast("long").alias("hash"), F.lit(None).cast("binary").alias("packed"))
        return _fingerprinted(in_order(rows.unionByName(found), parts), common)


def _least_sent(terms: DataFrame, most: int) -> int:
    """The least document frequency that at most ``most`` terms reach."""
    shown = terms.groupBy(F.least("n", F.lit(COMMON)).alias("n")).agg(F.count("*").alias("terms")).orderBy(F.desc("n")).collect()  # COMMON rows at most
    least = COMMON + 1  # none
    for r in shown:
        most -= r["terms"]
        if most < 0:
            break
        least = r["n"]
    return least


def _sent(terms: DataFrame) -> Broadcast:
    """The terms of the lexicon and the others, both sorted, on every executor."""
    table = terms.select("term", "inside").toArrow()  # no row objects
    hashes, inside = table["term"].to_numpy().astype(np.int64).view(np.uint64), table["inside"].to_numpy().astype(bool)
    return terms.sparkSession.sparkContext.broadcast((np.sort(hashes[inside]), np.sort(hashes[~inside])))


RESULT = "doc_id bigint, n_chars bigint, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class _Block(NamedTuple):
    """Texts in order and their buckets, the places of the rows among them (each
    one's successor comes next), their ids and edited texts, and the rare terms
    of the lexicon known to occur in these buckets."""

    texts: list[str]
    buckets: np.ndarray
    at: list[int]
    ids: list[int]
    edited: list[str]
    rare: np.ndarray


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[_Block]:
    found: dict[int, list[np.ndarray]] = {}

    def block(rows: list[tuple]) -> _Block:
        at = [i for i in range(len(rows) - 1) if rows[i][1] == 0 and rows[i][0] == rows[i + 1][0]]
        texts = [r[3] for r in rows]
        edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in at]
        for b in [b for b in found if b < rows[0][0]]:
            del found[b]
        rare = [x for b in found if b <= rows[-1][0] for x in found[b]]
        return _Block(texts, np.array([r[0] for r in rows], np.int32), at, [rows[i][2] for i in at], edited, np.unique(np.concatenate(rare)) if rare else np.zeros(0, np.uint64))

    held: list[tuple] = []
    size = 0
    for batch in batches:
        late = batch["late"].to_numpy() < 0  # such rows are terms
        if late.any():
            for b, x in batch[late].groupby("bucket")["id"]:
                found.setdefault(b, []).append(x.to_numpy().view(np.uint64))
            batch = batch[~late]
        for some in (batch.iloc[i : i + SLICE] for i in range(0, len(batch), SLICE)):
            for row in zip(some["bucket"].tolist(), some["late"].tolist(), some["id"].tolist(), _unpacked(some["packed"].tolist()), strict=True):
                held.append(row)
                size += len(row[3])
                if size >= CHUNK_CHARS and len(held) > 1:
                    yield block(held)
                    held, size = held[-1:], len(row[3])
    if len(held) > 1:
        yield block(held)


def _fingerprinted(rows: DataFrame, known: Broadcast) -> DataFrame:
    """Rows in order, with the rare terms of the lexicon that ``known`` lacks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in _blocks(batches):
            inside, at = known.value[0], np.array(x.at, np.int64)
            every, edited = fingerprints(x.texts, inside, x.rare), fingerprints(x.edited, inside, x.rare)
            own, following = (every[at], every[at + 1]) if len(at) else (every[:0], every[:0])
            ids = pd.array([None if i == LEAST else i for i in x.ids], "Int64")
            frame = pd.DataFrame({"doc_id": ids, "n_chars": np.array([len(x.texts[i]) for i in x.at], np.int64), "edited_text": x.edited})
            yield frame.assign(fingerprint=[as_text(r) for r in own], edited_fingerprint=[as_text(r) for r in edited], near_edited=likeness(own, edited), near_next=likeness(own, following))

    return rows.mapInPandas(run, RESULT)


def seams(x: str, y: str) -> str:
    """The words that an edited text may have besides those of ``x`` and of the
    text that ``y`` begins: the one across the border and the last."""
    left = x.rsplit(None, 1)[-1] if x and not x[-1].isspace() else ""
    right = y.split(None, 1)[0] if y and not y[0].isspace() else ""
    return f"{left}{right} {y.rsplit(None, 1)[-1] if y and not y[-1].isspace() else ''}"


def _rare_terms(rows: DataFrame, known: Broadcast) -> DataFrame:
    """(bucket, term): the terms of texts and edited texts that ``known`` lacks,
    each once a block and bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in _blocks(batches):
            after = [len(x.texts[i]) // 2 for i in x.at]
            new = [seams(x.texts[i][: len(x.texts[i]) - n], x.texts[i + 1][:n]) for i, n in zip(x.at, after, strict=True)]
            buckets = np.r_[x.buckets, x.buckets[x.at]]
            h, doc = term_hashes(x.texts + new)
            rest = ~(among(h, known.value[0]) | among(h, known.value[1]))
            yield pd.DataFrame({"bucket": buckets[doc[rest]], "term": h[rest].view(np.int64)}).drop_duplicates()

    return rows.mapInPandas(run, "bucket int, term bigint")
