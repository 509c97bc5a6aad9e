"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint of 64 (or a multiple of 64) bits is cut into so few segments that
two fingerprints within the radius have a segment where they differ by one bit
at most.  Each segment is indexed once for every bit, with that bit left out;
two such segments share a variant.  Fingerprints meet by an equality join on
the variant and are verified by counting differing bits.

Links are not emitted pair by pair inside a variant's bucket.  First each
fingerprint is compared with its bucket's smallest one, which joins dense
groups in linear work; the components so far are computed, and buckets that
hold a single component are done.  In the others only fingerprints of different
components are compared, all of them, so that no link is lost.  Equal
fingerprints are one node from the start, and each has a number of its own:
doc_ids may be null or repeated, and only name a component at the end.

With ``radius`` <= 2 * segments - 1 every link is found.  A similarity of
shingle sets is not decided by bits at all: at 0.8 about 15 % of them differ,
so no radius keeps the pairs above apart from those below.  The fingerprints
there only propose candidates among close copies, and a second index proposes
the rest: ordered in one way for all texts, a set of n shingles shares one of
its first n - ceil(0.8 n) + 1 with every set alike at 0.8 (prefix filter), so no
pair is missed.  Candidates are first held against what two sets must differ in
at least (bit maps of the parity of their hashes differ in no more bits than the
sets in shingles; long texts have a second map as long as their set, since the
first is full), then decided by their exact Jaccard similarity.

Defined cases: a null text is the empty text; a text without words has the
fingerprint zero and is linked like any other; fewer words than a shingle make
one shingle; a null doc_id links nothing, and a component is named by the
smallest doc_id it has (null if it has none); an empty table gives an empty
table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LEAST, Scratch, fresh, sought, text_of
from .components import components

SEED = 42
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
#: Shingles frequent in every SAMPLE-th document are ordered last; at most
#: MAX_FREQUENT of them.  Any order finds every pair, this one keeps buckets small.
SAMPLE, FREQUENT, MAX_FREQUENT = 8, 4, 1 << 17
FEW = 32  # rows of a bucket that are compared without their bit maps


def shingles(text: str, width: int) -> list[bytes]:
    """Word shingles as bytes.  ``bytes.split`` parts at [\\x20\\x09-\\x0D]."""
    w = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if len(w) <= width:
        return [b" ".join(w)] if w else []
    return [b" ".join(x) for x in zip(*(w[i:] for i in range(width)))]


def _spread(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64-bit hash made from the first (k = 0: itself)."""
    if k == 0:
        return h
    x = h ^ np.uint64((0x9E3779B97F4A7C15 * k) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str, width: int, words: int = 1) -> list[int]:
    """``words`` 64-bit parts, as signed integers: bit set in over half the hashes."""
    parts = shingles(text, width)
    if not parts:
        return [0] * words
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(p, SEED) for p in parts), np.uint64, len(parts))
    out = []
    for k in range(words):
        columns = _spread(h, k).view(np.uint8).reshape(-1, 8).astype(np.int64) + np.arange(8) * 256
        seen = np.bincount(columns.ravel(), minlength=2048).reshape(8, 256)
        ones = (seen @ _BITS).ravel()
        out.append(int.from_bytes(np.packbits(2 * ones > len(parts), bitorder="little").tobytes(), "little", signed=True))
    return out


def with_fingerprint(docs: DataFrame, to: list[str], width: int, text: str = "text") -> DataFrame:
    """``docs`` with the fingerprint's 64-bit parts as long columns ``to``."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def parts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, width, len(to)) for t in texts], dtype=object)

    at = fresh(docs, "parts")[0]
    df = docs.withColumn(at, parts(text_of(docs, text)))
    return df.withColumns({c: F.get(F.col(at), F.lit(i)) for i, c in enumerate(to)}).drop(at)


def _variants(nodes: DataFrame, fp: list[str], segments: int, also: tuple[str, ...] = ()) -> DataFrame:
    """(key, node, *also) for each bit: the bit's segment without the bit.

    ``segments`` per 64-bit part; a segment's borders are 64 * i / segments.
    """
    edges = [64 * i // segments for i in range(segments + 1)]
    masks = [((1 << edges[s + 1]) - (1 << edges[s])) & ~(1 << b) for s in range(segments) for b in range(edges[s], edges[s + 1])]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    bits = F.explode(F.sequence(F.lit(0), F.lit(64 * len(fp) - 1))).alias("bit")
    df = nodes.select("node", *also, *fp, bits)
    part = F.get(F.array(*fp), F.floor(F.col("bit") / 64).cast("int"))
    mask = F.get(F.array(*[F.lit(m).cast("long") for m in masks]), F.col("bit") % 64)
    return df.select(F.xxhash64("bit", part.bitwiseAND(mask)).alias("key"), "node", *also)


def _apart(a: list[Column], b: list[Column]) -> Column:
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a[1:], b[1:], strict=True)), F.bit_count(a[0].bitwiseXOR(b[0])))


def labelled(rows: DataFrame, fp: list[str], segments: int, radius: int, indexed: int, ident: str = "id") -> DataFrame:
    """``rows`` (a written table) with ``component``: the smallest ``ident``
    reachable over fingerprints that differ in ``radius`` bits at most, and
    ``group``: a number of the component's own, whatever ``ident`` holds.  The
    first ``indexed`` of the parts ``fp`` are cut into segments."""
    with Scratch(rows.sparkSession) as scratch:
        return _labelled(rows, fp, segments, radius, indexed, ident, scratch)


def _labelled(rows: DataFrame, fp: list[str], segments: int, radius: int, indexed: int, ident: str, scratch: Scratch) -> DataFrame:
    materialize = scratch.write
    nodes = materialize(rows.groupBy(*fp).agg(F.min(ident).alias("least")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    # Dealt by key once; the grouping and the join read the same shuffle.
    variants = _variants(nodes, fp[:indexed], segments).repartition("key")
    shared = variants.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("key", "hub")
    buckets = materialize(variants.join(shared, "key").select("key", "node", "hub"), "buckets")

    def told(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of nodes within the radius."""
        left = nodes.select(F.col("node").alias("a"), *[F.col(c).alias(f"l{c}") for c in fp])
        right = nodes.select(F.col("node").alias("b"), *[F.col(c).alias(f"r{c}") for c in fp])
        near = _apart([F.col(f"l{c}") for c in fp], [F.col(f"r{c}") for c in fp]) <= radius
        return pairs.join(left, "a").join(right, "b").where(near).select("a", "b")

    stars = materialize(told(buckets.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()), "stars")
    first = materialize(components(stars, scratch), "first")
    # Buckets that still hold more than one component: compare across them.
    mine = buckets.select("key", "node").join(first, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    mixed = mine.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key")
    rest = materialize(mine.join(mixed, "key", "left_semi").join(nodes, "node"), "rest")
    l, r = rest.alias("l"), rest.alias("r")
    cross = l.join(
        r,
        (F.col("l.key") == F.col("r.key")) & (F.col("l.label") < F.col("r.label")) & (_apart([F.col(f"l.{c}") for c in fp], [F.col(f"r.{c}") for c in fp]) <= radius),
    ).select(F.col("l.label").alias("a"), F.col("r.label").alias("b"))
    links = first.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(cross.distinct())
    last = components(links, scratch)
    of_node = scratch.keep(materialize(nodes.join(last, "node", "left").select(*fp, "least", F.coalesce("label", "node").alias("group")), "groups"))
    named = of_node.groupBy("group").agg(F.min("least").alias("component"))
    return rows.join(of_node.join(named, "group").select(*fp, "group", "component"), fp)


def near_groups(docs: DataFrame, width: int = 3, radius: int = 3, segments: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row."""
    base = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    rows = Scratch(docs.sparkSession).write(with_fingerprint(base, ["f0"], width).select("id", "f0"), "fingerprints")
    out = labelled(rows, ["f0"], segments, radius, 1)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def shingle_set(text: str, width: int) -> np.ndarray:
    """The sorted 64-bit hashes of the different shingles; a text without words
    has the hash of the empty text."""
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(p, SEED) for p in shingles(text, width) or [b""]], np.uint64).view(np.int64))


def prefix_size(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1


def parity_map(h: np.ndarray, bits: int = 1024) -> np.ndarray:
    """1024 bits (or another power of two) as signed numbers: whether an odd number
    of hashes has the bit."""
    odd = np.bincount(h & (bits - 1), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8")


def wide_map(h: np.ndarray) -> bytes | None:
    """A parity map of at least as many bits as there are hashes; None if 1024 do."""
    return parity_map(h, 1 << (len(h) - 1).bit_length()).tobytes() if len(h) > 1024 else None


def maps_apart(x: bytes, y: bytes) -> int:
    """In how many bits two wide maps differ, at the length of the shorter one: no
    more than the sets differ in hashes."""
    a, b = sorted((np.frombuffer(m, np.uint64) for m in (x, y)), key=len)
    b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def _frequent(base: DataFrame, width: int) -> np.ndarray:
    """Sorted hashes of shingles that many sampled documents hold."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def all_of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, width) for t in texts], dtype=object)

    seen = base.where(F.pmod("mark", F.lit(SAMPLE)) == 0).select(F.explode(all_of("text")).alias("h")).groupBy("h").count()
    top = seen.where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "h").limit(MAX_FREQUENT).toPandas()  # at most MAX_FREQUENT rows
    return np.sort(top["h"].to_numpy(np.int64))


def _index(base: DataFrame, width: int, similarity: float, late: np.ndarray) -> DataFrame:
    """(id, mark, node, n, f0, prefix, parity, wide) of every row: the number of
    shingles, the fingerprint, the rarest shingles, of which alike sets share
    one, the bit map, and a long text's wider one."""

    @F.pandas_udf("n int, f0 long, prefix array<long>, parity array<long>, wide binary")
    def index(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                h = shingle_set(t, width)
                last = late[np.minimum(np.searchsorted(late, h), len(late) - 1)] == h if len(late) else np.zeros(len(h), bool)
                rows.append((len(h), fingerprint(t, width)[0], np.concatenate([h[~last], h[last]])[: prefix_size(len(h), similarity)], parity_map(h), wide_map(h)))
            yield pd.DataFrame({"n": np.array([r[0] for r in rows], np.int32), "f0": np.array([r[1] for r in rows], np.int64), "prefix": pd.Series([r[2] for r in rows], dtype=object), "parity": pd.Series([r[3] for r in rows], dtype=object), "wide": pd.Series([r[4] for r in rows], dtype=object)})

    return base.withColumn("x", index("text")).select("id", "mark", F.monotonically_increasing_id().alias("node"), "x.*")


def drop_near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document, the smallest doc_id, of each group of texts
    linked by shingle sets with at least the Jaccard ``similarity``.

    Rows with equal doc_id and text count as one document and stay or go
    together; drop exact copies first.
    """
    ident, mark = fresh(docs, "id", "mark")
    given = lambda df: {ident: F.coalesce(df[doc_id].cast("long"), F.lit(LEAST)), mark: F.xxhash64(text_of(df, text))}
    base = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LEAST)).alias("id"), F.xxhash64(text_of(docs, text)).alias("mark"), text_of(docs, text).alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        lost = scratch.keep(_lost(base, width, similarity, scratch))
    return docs.withColumns({ident: given(docs)[ident], mark: given(docs)[mark]}).join(sought(lost).toDF(ident, mark), [ident, mark], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def _lost(base: DataFrame, width: int, similarity: float, scratch: Scratch) -> DataFrame:
    """(id, mark) of the rows of ``base`` that go: a written table."""
    nodes = scratch.write(_index(base, width, similarity, _frequent(base, width)), "index")
    ratio = similarity / (1 + similarity)  # of two sizes: what alike sets share at least

    def possible(a: str, b: str) -> Column:
        """Whether sets of these sizes can be alike, and, if this is the first shingle that they share, what follows it can still make the overlap."""
        n, m = F.col(f"{a}n"), F.col(f"{b}n")
        follow = F.least(n - F.col(f"{a}place"), m - F.col(f"{b}place"))
        return (F.least(n, m) >= F.greatest(n, m) * similarity - 1e-6) & (follow >= (n + m) * ratio - 1e-6)

    def bucketed(keys: DataFrame) -> DataFrame:
        """The rows of keys with two nodes or more, and the bucket's hub."""
        at = F.struct("node", "n", "place").alias("hub")
        # Dealt by key once; the grouping and the join read the same shuffle.
        dealt = keys.repartition("key")
        shared = dealt.groupBy("key").agg(F.min(at).alias("hub"), F.max("node").alias("last")).where("hub.node < last").select("key", "hub")
        return scratch.write(dealt.join(shared, "key").select("key", "node", "n", "place", "hub"), "buckets")

    spread = (1 - similarity) / (1 + similarity)  # of two sizes: what alike sets differ in at most

    def near(n: tuple[str, str], maps: tuple[str, str]) -> Column:
        """Whether the bit maps differ in no more bits than alike sets may in shingles."""
        return _apart(*[[F.get(m, F.lit(i)) for i in range(16)] for m in maps]) <= (F.col(n[0]) + F.col(n[1])) * spread + 1e-6

    def let_through(pairs: DataFrame) -> DataFrame:
        maps = [nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("parity").alias(f"m{c}")) for c in "ab"]
        return pairs.join(maps[0], "a").join(maps[1], "b").where(near(("na", "nb"), ("ma", "mb"))).select(*pairs.columns)

    def alike(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, ...) of nodes whose shingle sets have the similarity.
        Only texts that are in a pair are read again."""
        told = scratch.write(pairs, "told")
        long = nodes.where(F.col("wide").isNotNull())
        maps = [long.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("wide").alias(f"w{c}")) for c in "ab"]
        pairs = scratch.write(told.join(maps[0], "a", "left").join(maps[1], "b", "left").where(may_be("wa", "wb", (F.col("na") + F.col("nb")) * spread)).select(*told.columns), "pairs")
        scratch.drop(told)
        if pairs.isEmpty():
            return pairs
        need = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "id", "mark"), "node")
        need = scratch.write(need, "need")
        sets = base.join(sought(need), ["id", "mark"]).select("node", hashes("text").alias("s"))
        sets = scratch.write(sets.dropDuplicates(["node"]), "sets")
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
        links = scratch.write(both.where(jaccard("x", "y") >= similarity).select(*pairs.columns), "links")
        both = None  # Spark frees the shuffles that nothing refers to
        scratch.drop(pairs, need, sets)
        return links

    def apart(groups: DataFrame) -> DataFrame:
        """Rows of the prefix buckets that hold more than one group, with
        ``label``, the row's group, and the bucket's ``least`` one and ``size``."""
        mine = buckets.join(groups, "node", "left").select("key", "node", "n", "place", F.coalesce("label", "node").alias("label"))
        mixed = mine.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("size")).where("least < most").select("key", "least", "size")
        return scratch.write(mine.join(mixed, "key"), "apart")

    def joined(groups: DataFrame, links: DataFrame) -> DataFrame:
        return components(groups.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(links), scratch)

    @F.pandas_udf("boolean")
    def may_be(x: pd.Series, y: pd.Series, most: pd.Series) -> pd.Series:
        return pd.Series([a is None or b is None or maps_apart(a, b) <= m + 1e-6 for a, b, m in zip(x, y, most, strict=True)], dtype=bool)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, width) for t in texts], dtype=object)

    close = bucketed(_variants(nodes, ["f0"], 2, ("n",)).withColumn("place", F.lit(0)))
    buckets = bucketed(nodes.select(F.posexplode("prefix").alias("place", "key"), "node", "n"))
    hubs = close.unionByName(buckets).where((F.col("node") != F.col("hub.node")) & possible("", "hub."))
    stars = alike(let_through(hubs.select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct()))
    hubs = None
    scratch.drop(close)
    groups = components(stars, scratch)
    # What is not alike to its hub is compared with one more member of the
    # hub's group, another one in every bucket that they share.
    rest = apart(groups)
    member = F.struct(F.xxhash64("key", "node").alias("h"), "node", "n", "place")
    hubs = rest.where("label = least").groupBy("key").agg(F.min(member).alias("hub"))
    hubs = rest.where("label <> least").join(hubs, "key").where(possible("", "hub."))
    more = alike(let_through(hubs.select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct()))
    groups = joined(groups, more)
    hubs = None
    scratch.drop(rest)
    # Buckets that still hold more than one group: compare across them.  In
    # large ones the bit maps are compared before a pair leaves the bucket.
    rest = apart(groups)
    meet = (F.col("l.key") == F.col("r.key")) & (F.col("l.label") < F.col("r.label")) & possible("l.", "r.")
    ends = [F.col("l.node").alias("a"), F.col("r.node").alias("b"), F.col("l.label").alias("c"), F.col("r.label").alias("d")]
    few, many = rest.where(F.col("size") <= FEW), scratch.write(rest.where(F.col("size") > FEW).join(nodes.select("node", "parity"), "node"), "many")
    pairs = let_through(few.alias("l").join(few.alias("r"), meet).select(*ends).distinct())
    pairs = pairs.unionByName(many.alias("l").join(many.alias("r"), meet & near(("l.n", "r.n"), ("l.parity", "r.parity"))).select(*ends).distinct())
    last = joined(groups, alike(pairs.distinct()).select(F.col("c").alias("a"), F.col("d").alias("b")).distinct())
    out = scratch.write(nodes.select("id", "mark", "node").join(last, "node").select("id", "mark", "node", F.col("label").alias("group")), "near")
    # Of rows with the component's id (repeated ids) the smallest mark stays.
    out = out.unionByName(nodes.join(out.select(F.col("group").alias("node")).distinct(), "node").select("id", "mark", "node", F.col("node").alias("group")))
    stays = scratch.write(out.groupBy("group").agg(F.min(F.struct("id", "mark")).alias("s")), "stays")
    lost = out.join(stays, "group").where((F.col("id") != F.col("s.id")) | (F.col("mark") != F.col("s.mark"))).select("id", "mark").distinct()
    return scratch.write(lost, "lost")


def jaccard(x: str, y: str) -> Column:
    shared = F.size(F.array_intersect(x, y))
    return shared / (F.size(x) + F.size(y) - shared)
