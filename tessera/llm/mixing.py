"""Mixing sources to target weights by hierarchical budgeting.

A token budget is handed down a domain - language - source tree.  On each level
the children of a node share its budget by weight; a child never gets more
than it can give (its tokens times ``max_epochs``), and what it cannot take is
shared among its siblings by weight.  Only what all children together cannot
take stays with the node, so a shortage reaches siblings before ancestors: a
node's own capacity is the sum of its leaves', and its parent has already
offered the rest to the node's siblings.

Each leaf then takes whole epochs of its documents while its budget lasts, and
of the last epoch the longest prefix, in that epoch's seeded order, whose
tokens fit.  A prefix of an order is told by its last key alone, so only that
key is looked for: the order key's first hex digits deal a leaf into 4096
buckets, bucket totals (summed before the shuffle) say which bucket the budget
ends in, and only that bucket's rows are put in order.  The documents are then
read once more and compared with their leaf's last key; no text is shuffled.

Only DataFrame functions are used.

Defined cases: a null domain, language or source is the leaf value ''; a null
text has no tokens, a very long one many, and a document longer than what is
left of its leaf's budget ends the prefix; a weight below zero or null counts
as zero, and a branch of weight zero gets nothing and has no capacity; equal order keys (repeated ids) are taken together or not at all;
columns of any name are carried along; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, Scratch, fresh, text_of

BUCKET_DIGITS = 3
LEAF = ["dom", "lng", "src"]
#: Above every hex digit: the last key of a leaf that is taken whole.
ALL = "g"


def n_tokens(body: Column) -> Column:
    """Tokens for budgets: runs of anything but ASCII white space."""
    return F.regexp_count(body, F.lit(WORD_PATTERN)).cast("long")


def share(df: DataFrame, parents: list[str], budget: str, cap: str, weight: str, order: list[str], to: str) -> DataFrame:
    """Water-filling among siblings: ``to`` = min(cap, level * weight) with the
    level that uses up the budget, or the cap where the budget exceeds all caps.

    Siblings are taken by cap per weight; the first that is not filled to its
    cap fixes the level: (budget - caps before) / (weights from here on).
    """
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    ratio = F.when(F.col(weight) > 0, F.col(cap) / F.col(weight))
    run = by.orderBy(F.col("__r").asc_nulls_last(), *order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__r", ratio).withColumn("__w", F.when(F.col("__r").isNull(), 0.0).otherwise(F.col(weight).cast("double")))
    df = df.withColumn("__before", F.coalesce(F.sum(F.when(F.col("__w") > 0, F.col(cap))).over(run), F.lit(0)).cast("double"))
    df = df.withColumn("__left", F.sum("__w").over(by) - F.coalesce(F.sum("__w").over(run), F.lit(0.0)))
    df = df.withColumn("__level", F.when((F.col("__w") > 0) & (F.col("__left") > 0), (F.col(budget) - F.col("__before")) / F.col("__left")))
    df = df.withColumn("__cut", F.max(F.when(F.col("__level") <= F.col("__r"), F.col("__level"))).over(by))
    got = F.when(F.col("__w") == 0, F.lit(0.0)).when(F.col("__cut").isNull(), F.col(cap).cast("double")).otherwise(F.least(F.col(cap).cast("double"), F.greatest(F.col("__cut"), F.lit(0.0)) * F.col("__w")))
    return df.withColumn(to, got).drop("__r", "__w", "__before", "__left", "__level", "__cut")


def budgets(leaves: DataFrame, budget_share: float, max_epochs: int) -> DataFrame:
    """Leaf budgets.  ``leaves``: dom, lng, src, tokens, w_dom, w_lng, w_src."""
    # What has weight zero takes nothing, so it has no capacity for its parent either.
    able = lambda weight, cap: F.when(weight > 0, cap).otherwise(F.lit(0))
    df = leaves.withColumn("cap", able(F.col("w_src"), F.col("tokens") * max_epochs))
    lng = df.groupBy("dom", "lng").agg(able(F.max("w_lng"), F.sum("cap")).alias("cap"), F.max("w_dom").alias("w_dom"), F.max("w_lng").alias("w_lng"), F.sum("tokens").alias("tokens"))
    dom = lng.groupBy("dom").agg(F.sum("cap").alias("cap"), F.max("w_dom").alias("w_dom"), F.sum("tokens").alias("tokens"))
    everything = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    dom = share(dom.withColumn("b_all", F.floor(everything * F.lit(float(budget_share)))), [], "b_all", "cap", "w_dom", ["dom"], "b_dom")
    lng = share(lng.join(dom.select("dom", "b_dom"), "dom"), ["dom"], "b_dom", "cap", "w_lng", ["lng"], "b_lng")
    return share(df.join(lng.select("dom", "lng", "b_lng"), ["dom", "lng"]), ["dom", "lng"], "b_lng", "cap", "w_src", ["src"], "b_src")


def _key(ident: Column, seed: int) -> Column:
    """Place in the order of the leaf's last, partly used epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(ident.cast("string"), F.lit(""))))


def plan(rows: DataFrame, ident: str, budget_share: float, max_epochs: int, seed: int, scratch: Scratch) -> DataFrame:
    """(dom, lng, src, whole, last) for each leaf: whole epochs, and the last
    order key taken of the epoch after them (null: none).

    ``rows``: a written table with ``ident`` (the order key's subject), dom,
    lng, src, tokens and the weights w_dom, w_lng, w_src of its tree nodes
    (the same for all rows of a node).
    """
    tidy = lambda c: F.max(F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))).alias(c)
    leaves = rows.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens"), tidy("w_dom"), tidy("w_lng"), tidy("w_src"))
    grant = F.floor(F.col("b_src")).cast("long")
    whole = F.when(F.col("tokens") > 0, F.floor(grant / F.col("tokens"))).otherwise(0).cast("long")
    granted = budgets(leaves, budget_share, max_epochs).select(*LEAF, whole.alias("whole"), (grant - whole * F.col("tokens")).alias("rest"))
    granted = scratch.write(granted, "budgets")
    # Leaves without a rest take no part of a further epoch.
    dealt = rows.join(granted.where("rest > 0"), LEAF).withColumn("key", _key(F.col(ident), seed)).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sums = dealt.groupBy(*LEAF, "rest", "bucket").agg(F.sum("tokens").alias("t"))
    upto = Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("upto", F.sum("t").over(upto)).where(F.col("upto") > F.col("rest"))
    ends = sums.groupBy(*LEAF).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("t")).alias("before"))).alias("end"))
    ends = scratch.write(ends.select(*LEAF, "end.bucket", "end.before"), "ends")
    inside = Window.partitionBy(*LEAF).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fits = dealt.join(ends, [*LEAF, "bucket"]).withColumn("upto", F.col("before") + F.sum("tokens").over(inside)).where(F.col("upto") <= F.col("rest"))
    fits = fits.groupBy(*LEAF).agg(F.max("key").alias("fit"))
    # A bucket's label is below its own keys and above those of earlier buckets.
    last = F.when(F.col("rest") > 0, F.coalesce("fit", "bucket", F.lit(ALL)))
    return scratch.keep(scratch.write(granted.join(ends, LEAF, "left").join(fits, LEAF, "left").select(*LEAF, "whole", last.alias("last")), "plan"))


def copies(ident: Column, seed: int) -> Column:
    """How often a row joined with its leaf's plan is taken."""
    return (F.col("whole") + F.coalesce(_key(ident, seed) <= F.col("last"), F.lit(False)).cast("long")).cast("long")


def _leaf(df: DataFrame, lang: str, source: str, domain: Column) -> list[Column]:
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return [blank(domain), blank(df[lang]), blank(df[source])]


def _rows(docs: DataFrame, domain: Column, weights: tuple[Column, Column, Column], doc_id: str, text: str, lang: str, source: str) -> DataFrame:
    leaf = [c.alias(n) for c, n in zip(_leaf(docs, lang, source, domain), LEAF, strict=True)]
    return docs.select(docs[doc_id].alias("doc_id"), *leaf, n_tokens(text_of(docs, text)).alias("tokens"), *[w.alias(f"w_{n}") for w, n in zip(weights, LEAF, strict=True)])


def mix_report(docs: DataFrame, domain: Column, weights: tuple[Column, Column, Column], budget_share: float, max_epochs: int, seed: int, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per document: its leaf, its tokens and the copies taken of it."""
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.keep(scratch.write(_rows(docs, domain, weights, doc_id, text, lang, source), "leaves"))
        out = rows.join(plan(rows, "doc_id", budget_share, max_epochs, seed, scratch), LEAF)
    return out.select("doc_id", F.col("dom").alias("domain"), F.col("lng").alias("lang"), F.col("src").alias("source"), F.col("tokens").alias("n_tokens"), copies(F.col("doc_id"), seed).alias("copies"))


def mix_documents(docs: DataFrame, domain: Column, weights: tuple[Column, Column, Column], budget_share: float, max_epochs: int, seed: int, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` taken, each as often as its copies say."""
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.write(_rows(docs, domain, weights, doc_id, text, lang, source), "leaves")
        leaves = plan(rows, "doc_id", budget_share, max_epochs, seed, scratch)
    mine = fresh(docs, *LEAF, "copies")
    # Own names on both sides, so that columns of docs can't clash with the plan's.
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    held = docs.withColumns(dict(zip(mine[:3], _leaf(docs, lang, source, domain), strict=True)))
    held = held.select(*[F.col(f"`{c}`").alias(n) for c, n in at.items()], *[F.col(m).alias(n) for m, n in zip(mine, LEAF, strict=False)])
    taken = held.join(leaves, LEAF).withColumn("n", copies(F.col(at[doc_id]), seed)).where("n > 0")
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
    return taken.select(*[F.col(n).alias(c) for c, n in at.items()], again.alias("n")).select(*[F.col(f"`{c}`") for c in docs.columns])
