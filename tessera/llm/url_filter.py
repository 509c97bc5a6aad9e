"""URL filter: host rules first, then gradient-boosted trees.

The trees see lexical features only: lengths, depth, digit ratio, entropy,
parameter counts and statistics of the host's suffix.  They are trained on
labelled urls, given as a table, at most ``MAX_FIT`` of them in the order of
their hashes, by Spark's GBTClassifier.  A suffix's rate of bad urls is counted
out of fold: hosts are dealt into ``FOLDS`` folds, and a url gets the rate of
the other folds, so that no url's own label is among its features.

A rule is a host and a path.  It fits the host and all its subdomains if the
url's path starts with the rule's; the longest rule that fits wins, of equally
long ones the last in the alphabet.

Defined cases: a null url, or one without ``://``, has the empty host and path
and no rule fits it; of repeated labels of a url the largest counts, null labels
say nothing; with labels of one class only, that class is everybody's verdict,
with no labels it is ``allow``; repeated urls get equal verdicts; very long urls
only take longer; columns besides id and url are not read, whatever their names;
an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh
from .url_parts import host_of, path_of

MAX_FIT = 20_000
FOLDS = 4
TREES, DEPTH = 12, 4
_WORDS = re.compile(r"[a-zA-Z]+")
FEATURES = (
    "length", "host_length", "path_length", "host_labels", "depth", "digits", "host_digits", "hyphens", "host_hyphens", "entropy", "host_entropy",
    "parameters", "query_length", "fragment", "secure", "longest_word", "host_vowels",
)


def entropy(s: str) -> float:
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in Counter(s).values()) if n else 0.0


def lexical(url: str, host: str, path: str) -> list[float]:
    tail = url.split("://", 1)[-1]
    query = tail.split("?", 1)[1].split("#", 1)[0] if "?" in tail.split("#", 1)[0] else ""
    labels = host.split(".")
    name = labels[-3] if len(labels) > 2 else labels[0]
    digits = sum(c.isdigit() for c in url)
    return [
        len(url), len(host), len(path), len(labels), sum(1 for p in path.split("/") if p), digits / max(len(url), 1), sum(c.isdigit() for c in host) / max(len(host), 1),
        url.count("-"), host.count("-"), entropy(url), entropy(host),
        query.count("&") + bool(query), len(query), float("#" in tail), float(url[:5].lower() == "https"), max(map(len, _WORDS.findall(url)), default=0),
        sum(c in "aeiou" for c in name) / max(len(name), 1),
    ]


def suffix_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null.  ``rules``:
    (verdict, rule) with a rule like ``example.com/en/``; a short list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _features(df: DataFrame, url: str) -> DataFrame:
    @F.pandas_udf("array<double>")
    def make(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for u, h, p in batches:
            yield pd.Series([[float(x) for x in lexical(*row)] for row in zip(u.tolist(), h.tolist(), p.tolist(), strict=True)], dtype=object)

    return df.withColumn("lexical", make(F.coalesce(F.col(url).cast("string"), F.lit("")), F.col("host"), F.col("path")))


def _prepared(pages: DataFrame, labels: DataFrame, ident: str, url: str, scratch: Scratch) -> DataFrame:
    """A written table: ident, host, path, fold, label, lexical, often, rate, h."""
    said = labels.select(labels["url"].alias("said"), labels["label"].cast("double").alias("label")).where("label in (0, 1) and said is not null").groupBy("said").agg(F.max("label").alias("label"))
    base = pages.select(pages[ident].alias("ident"), pages[url].cast("string").alias("url"), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    base = base.join(said, F.col("url") == F.col("said"), "left").drop("said")
    base = base.withColumns({"suffix": suffix_of(F.col("host")), "fold": F.pmod(F.xxhash64("host"), F.lit(FOLDS)), "h": F.xxhash64("url")})
    full = scratch.write(_features(base, "url").drop("url"), "urls")
    known = full.groupBy("suffix", "fold").agg(F.count("*").alias("n"), F.sum(F.coalesce("label", F.lit(0.0))).alias("bad"), F.count("label").alias("told"))
    over = Window.partitionBy("suffix")
    rate = (F.sum("bad").over(over) - F.col("bad") + 1.0) / (F.sum("told").over(over) - F.col("told") + 2.0)
    stats = scratch.write(known.select("suffix", "fold", F.log1p(F.sum("n").over(over).cast("double")).alias("often"), rate.alias("rate")), "suffixes")
    return full.join(stats, ["suffix", "fold"]).withColumn("features", array_to_vector(F.concat("lexical", F.array("often", "rate"))))


def _fitted(rows: DataFrame, scratch: Scratch) -> tuple[GBTClassificationModel | None, float]:
    """The trees, or the only class there is (0 without labels)."""
    fit = rows.where("label is not null").orderBy("h", "ident").limit(MAX_FIT).select("label", vector_to_array("features").alias("features"))
    fit = scratch.write(fit, "labelled").withColumn("features", array_to_vector("features"))
    classes = [r["label"] for r in fit.select("label").distinct().collect()]
    if len(classes) < 2:
        return None, float(classes[0]) if classes else 0.0
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=3, subsamplingRate=1.0).fit(fit), 0.0


def _scored(rows: DataFrame, model: GBTClassificationModel | None, constant: float) -> DataFrame:
    return model.transform(rows).withColumn("score", F.get(vector_to_array("probability"), F.lit(1))) if model else rows.withColumn("score", F.lit(constant))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], labels: DataFrame, ident: str = "page_id", url: str = "url") -> DataFrame:
    """``ident``, host, path, rule, verdict and the trees' score for every row.
    ``labels``: url, label (1 block, 0 allow)."""
    with Scratch(pages.sparkSession) as scratch:
        full = _prepared(pages, labels, ident, url, scratch)
        scored = _scored(full, *_fitted(full, scratch))
        scratch.keep_tagged("urls")
        scratch.keep_tagged("suffixes")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_trees = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select(F.col("ident").alias(ident), "host", "path", rule.alias("rule"), F.coalesce(verdict, by_trees).alias("verdict"), "score")


def held_out(pages: DataFrame, labels: DataFrame, ident: str = "page_id", url: str = "url") -> DataFrame:
    """(label, score) of the labelled urls on the hosts of fold 0, scored by
    trees fitted on the other hosts."""
    scratch = Scratch(pages.sparkSession)
    full = _prepared(pages, labels, ident, url, scratch)
    return _scored(full.where("fold = 0 and label is not null"), *_fitted(full.where("fold <> 0"), scratch)).select("label", "score")


def filter_pages(pages: DataFrame, rules: Sequence[tuple[str, str]], labels: DataFrame, ident: str = "page_id", url: str = "url") -> DataFrame:
    """The rows of ``pages`` that are allowed; repeated ids share a verdict if
    they share a url."""
    mine, at = fresh(pages, "url", "id")
    out = judge(pages.select(F.col(ident), F.col(url)), rules, labels, ident, url).where("verdict = 'block'")
    bad = out.select(F.col(ident).alias(at)).distinct()
    return pages.join(bad, pages[ident] == bad[at], "left_anti")
