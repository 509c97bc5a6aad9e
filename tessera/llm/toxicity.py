"""Toxicity by class-conditional Kneser-Ney models over characters.

Toxic and ordinary texts each get a character model of order ``ORDER`` inside
words.  A class's discounted counts are interpolated, with ``STRENGTH`` counts
of prior weight, with a backoff that both classes share: the pooled Kneser-Ney
model, whose lower orders are continuation counts (in how many contexts a
shorter gram occurs).  What a class has hardly seen is thus judged by the
shared counts and weighs neither way.  The log-likelihood ratio of a gram that
was seen is stored; of an unseen one the shared probability cancels out and
only the two backoff weights of its context remain.

A toxic text is an ordinary text with toxic words in it, so its likelihood is
normalised by length as a mixture: each of its n words is equally likely the
toxic one, the others are ordinary.  The comparison with the ordinary
likelihood is then the mean of the words' likelihood ratios.  A text's median
word ratio tells its language and subject and is taken off first (with
``CENTRE`` words of ratio 0, for short texts).  The logarithm of that mean is
the only evidence; a monotone logistic curve turns it into a score.  The curve
is fitted on at most ``MAX_FIT`` held-back training rows (``crc32 % 4 == 3``)
scored by a model that has not seen them; the model in use is then counted over
all training rows.

Counting covers every labelled training text and is distributed, and no gram is
dropped.  Up to ``BROADCAST_GRAMS`` of them the table of ratios is sent to the
executors; beyond, the corpus's distinct words are joined with it.  Both ways
give the same scores.

Defined cases: a null text is the empty text; a text without words has the
evidence 0; a very long text is one row's work; repeated documents count each;
rows without a label or with a label other than 0 and 1 teach nothing; of
repeated labels the largest counts; if either class has no training row, every
score is 0; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, text_of

ORDER = 5
DISCOUNT = 0.75
STRENGTH = 10.0
BROADCAST_GRAMS = 1 << 21
MAX_FIT = 20_000
THRESHOLD = 0.3
CENTRE = 5
CACHE = 100_000
FLUSH = 100_000
PART = 10_000
PART_CHARS = 1 << 20
START, END = "\x02", "\x03"
_WORD = re.compile(r"\w+")
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3][:ORDER], np.uint64)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _parts(texts: Sequence[str]) -> Iterator[Sequence[str]]:
    """Runs of texts of about ``PART_CHARS`` characters, one text at least.  A
    batch has up to 10,000 texts, whose words as objects take many times their
    bytes."""
    first, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= PART_CHARS:
            yield texts[first : k + 1]
            first, size = k + 1, 0
    if first < len(texts):
        yield texts[first:]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _windows(ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of every gram, one row each, and the word of each row.  A
    word has a start mark before each missing character and an end mark."""
    pad = START * (ORDER - 1)
    flat = np.frombuffer("".join(f"{pad}{w}{END}" for w in ws).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter((len(w) + 1 for w in ws), np.int64, len(ws))
    ends = np.cumsum(sizes + ORDER - 1)
    owner = np.repeat(np.arange(len(ws)), sizes)
    first = np.repeat(ends - sizes - (ORDER - 1), sizes) + np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return flat[first[:, None] + np.arange(ORDER)], owner


def _keys(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of whole grams and of their contexts."""
    parts = (grams + np.uint64(1)) * _MULTIPLIERS
    context = parts[:, :-1].sum(axis=1, dtype=np.uint64)
    return _mix(context + parts[:, -1]), _mix(context ^ np.uint64(0x5555555555555555))


class Ratios:
    """Log-likelihood ratios of grams and contexts as sorted arrays."""

    def __init__(self, gram_keys: np.ndarray, gram_values: np.ndarray, context_keys: np.ndarray, context_values: np.ndarray):
        self.grams, self.contexts = self._sorted(gram_keys, gram_values), self._sorted(context_keys, context_values)
        self.known: dict[str, float] = {}

    @staticmethod
    def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, first = np.unique(keys, return_index=True)
        return keys, values[first].astype(np.float64)

    @staticmethod
    def _look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table[0]):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        return table[0][at] == keys, table[1][at]

    def of_words(self, ws: list[str]) -> np.ndarray:
        grams, owner = _windows(ws)
        whole, context = _keys(grams)
        seen, value = self._look(self.grams, whole)
        known, other = self._look(self.contexts, context)
        return np.bincount(owner, np.where(seen, value, np.where(known, other, 0.0)), minlength=len(ws))

    def evidence(self, texts: list[str]) -> np.ndarray:
        return np.concatenate([np.zeros(0), *map(self._of_part, _parts(texts))])

    def _of_part(self, texts: list[str]) -> np.ndarray:
        split = [words(t) for t in texts]
        used = dict.fromkeys(chain.from_iterable(split))
        if len(self.known) > CACHE:
            self.known = {w: self.known[w] for w in used if w in self.known}
        new = [w for w in used if w not in self.known]
        for i in range(0, len(new), PART):
            part = new[i : i + PART]
            self.known.update(zip(part, self.of_words(part).tolist(), strict=True))
        get = self.known.__getitem__
        return np.array([evidence(np.fromiter(map(get, ws), np.float64, len(ws))) for ws in split])


def evidence(ratios: np.ndarray) -> float:
    """Logarithm of the mean likelihood ratio of a text's words, centred."""
    if not len(ratios):
        return 0.0
    centred = ratios - np.median(np.r_[ratios, np.zeros(CENTRE)])
    most = centred.max()
    return float(most + np.log(np.exp(centred - most).mean()))


def _labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(toxic, fold, text) of the training rows."""
    said = labels.select(labels["doc_id"].alias("__l"), labels["toxic"].cast("int").alias("toxic")).where("toxic in (0, 1) and __l is not null")
    said = said.groupBy("__l").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(docs[doc_id].alias("__d"), fold(docs[doc_id]).alias("fold"), text_of(docs, text).alias("text")).where("fold <> 2")
    # Always a shuffled join: labels grow with the corpus, and one way of
    # joining at every size keeps the job's cost in proportion.
    return rows.join(said.hint("merge"), rows["__d"] == said["__l"]).select("toxic", "fold", "text")


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 4; rows with 2 are held out."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4).cast("int")


def count_grams(train: DataFrame) -> DataFrame:
    """(gram, t, o, t3, o3): occurrences in toxic and ordinary training texts,
    and of these in the held-back quarter."""

    def flush(seen: dict[str, int], n: np.ndarray) -> pd.DataFrame:
        """Grams of the words in ``seen`` (word to row of ``n``), each once.
        Words go through in parts, so that memory stays small."""
        ws, codes, sums = list(seen), [], []
        for i in range(0, len(ws), PART):
            grams, owner = _windows(ws[i : i + PART])
            _, first, inverse = np.unique(_keys(grams)[0], return_index=True, return_inverse=True)
            codes.append(grams[first].astype("<u4"))
            sums.append(np.stack([np.bincount(inverse, n[i + owner, k], minlength=len(first)).astype(np.int64) for k in range(4)], axis=1))
        grams, each = np.concatenate(codes), np.concatenate(sums)
        _, first, inverse = np.unique(_keys(grams.astype(np.uint64))[0], return_index=True, return_inverse=True)
        total = [np.bincount(inverse, each[:, k], minlength=len(first)).astype(np.int64) for k in range(4)]
        text = grams[first].tobytes().decode("utf-32-le", "surrogatepass")
        return pd.DataFrame({"gram": [text[i : i + ORDER] for i in range(0, len(text), ORDER)], "t": total[0], "o": total[1], "t3": total[2], "o3": total[3]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        n = np.zeros((FLUSH, 4), np.int64)
        for batch in batches:
            for (toxic, fold_), own in batch.groupby(["toxic", "fold"]):
                add = np.array([toxic == 1, toxic == 0, toxic == 1 and fold_ == 3, toxic == 0 and fold_ == 3], np.int64)
                for part in _parts(own["text"].tolist()):
                    count: Counter[str] = Counter()
                    for t in part:
                        count.update(words(t))
                    at = np.fromiter((seen.setdefault(w, len(seen)) for w in count), np.int64, len(count))
                    while len(seen) > len(n):
                        n = np.concatenate([n, np.zeros_like(n)])
                    n[at] += np.fromiter(count.values(), np.int64, len(count))[:, None] * add
                    if len(seen) > FLUSH:
                        yield flush(seen, n)
                        seen, n = {}, np.zeros((FLUSH, 4), np.int64)
        if seen:
            yield flush(seen, n)

    grams = train.mapInPandas(run, "gram string, t bigint, o bigint, t3 bigint, o3 bigint")
    return grams.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("t", "o", "t3", "o3")])


def _shared(grams: DataFrame) -> DataFrame:
    """(tail, p): shared probability of a gram's last character after the
    characters between, by interpolated continuation counts."""
    types = [grams.groupBy(F.expr(f"substring(gram, 2, {ORDER - 1})").alias("g")).agg(F.count("*").alias("n"))]
    for size in range(ORDER - 2, 0, -1):
        types.append(types[-1].groupBy(F.expr(f"substring(g, 2, {size})").alias("g")).agg(F.count("*").alias("n")))
    everything = Window.partitionBy(F.lit(0))
    low = types[-1].select("g", (F.col("n") / F.sum("n").over(everything)).alias("p"))
    for size in range(2, ORDER):
        by = Window.partitionBy(F.expr(f"substring(g, 1, {size - 1})"))
        own = types[ORDER - 1 - size].select("g", "n", F.sum("n").over(by).alias("s"), F.count("*").over(by).alias("k"), F.expr(f"substring(g, 2, {size - 1})").alias("tail"))
        low = own.join(low.select(F.col("g").alias("tail"), F.col("p").alias("q")), "tail").select(
            "g", (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("s") + DISCOUNT * F.col("k") / F.col("s") * F.col("q")).alias("p")
        )
    return low.select(F.col("g").alias("tail"), "p")


def gram_ratios(grams: DataFrame) -> DataFrame:
    """(gram, all, all_c, part, part_c): log-likelihood ratios of the gram and
    of its context's unseen grams, from all training rows and from those that
    are not held back."""
    by = Window.partitionBy(F.expr(f"substring(gram, 1, {ORDER - 1})"))
    df = grams.withColumn("tail", F.expr(f"substring(gram, 2, {ORDER - 1})")).join(_shared(grams), "tail")
    both = F.col("t") + F.col("o")
    pooled = F.greatest(both - DISCOUNT, F.lit(0.0)) / F.sum(both).over(by) + DISCOUNT * F.count("*").over(by) / F.sum(both).over(by) * F.col("p")
    df = df.withColumn("q", pooled)
    columns = {}
    for name, t, o in (("all", F.col("t"), F.col("o")), ("part", F.col("t") - F.col("t3"), F.col("o") - F.col("o3"))):
        whole, open_ = [], []
        for c in (t, o):
            total, kinds = F.sum(c).over(by), F.sum((c > 0).cast("int")).over(by)
            whole.append((F.greatest(c - DISCOUNT, F.lit(0.0)) + (STRENGTH + DISCOUNT * kinds) * F.col("q")) / (total + STRENGTH))
            open_.append((STRENGTH + DISCOUNT * kinds) / (total + STRENGTH))
        columns |= {name: F.log(whole[0]) - F.log(whole[1]), f"{name}_c": F.log(open_[0]) - F.log(open_[1])}
    return df.select("gram", *[c.alias(k) for k, c in columns.items()])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> tuple[float, float]:
    """Slope, zero at least, and intercept of a logistic curve."""
    mean, scale = x.mean(), max(x.std(), 1e-9)
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * np.eye(2)
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    slope = max(w[0], 0.0) / scale
    return float(slope), float(w[1] - slope * mean)


#: Curve used where no held-back row has a label.
DEFAULT_CURVE = (2.0, -2.0)


class Scorer:
    """The ratios (a written table, none without both classes) and the curve."""

    def __init__(self, ratios: DataFrame | None, curve: tuple[float, float] = DEFAULT_CURVE, broadcast_grams: int = BROADCAST_GRAMS):
        self.ratios, self.curve, self.broadcast_grams = ratios, curve, broadcast_grams

    def with_evidence(self, docs: DataFrame, to: str, text: str = "text", which: str = "all") -> DataFrame:
        small = self.ratios.limit(self.broadcast_grams + 1).count() <= self.broadcast_grams
        return self._looked_up(docs, to, text, which) if small else self._joined(docs, to, text, which)

    def _looked_up(self, docs: DataFrame, to: str, text: str, which: str) -> DataFrame:
        """The table of at most ``broadcast_grams`` rows goes to every executor."""

        def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                codes = np.frombuffer("".join(batch["gram"]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64).reshape(-1, ORDER)
                whole, context = _keys(codes)
                yield pd.DataFrame({"k": whole.view(np.int64), "c": context.view(np.int64), "x": batch[which], "y": batch[f"{which}_c"]})

        table = self.ratios.select("gram", which, f"{which}_c").mapInPandas(keyed, "k long, c long, x double, y double").toPandas()
        ratios = Ratios(table["k"].to_numpy().view(np.uint64), table["x"].to_numpy(), table["c"].to_numpy().view(np.uint64), table["y"].to_numpy())
        shared = docs.sparkSession.sparkContext.broadcast(ratios)

        @F.pandas_udf("double")
        def of_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series(shared.value.evidence(texts.tolist()))

        return docs.withColumn(to, of_text(text_of(docs, text)))

    def _joined(self, docs: DataFrame, to: str, text: str, which: str) -> DataFrame:
        """Distinct words are joined with the table, and texts with their words."""
        sha, key = fresh(docs, "sha", "of")
        held = docs.withColumn(sha, F.sha2(text_of(docs, text), 256))

        def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(s, w, n) for s, t in zip(batch["s"], batch["t"], strict=True) for w, n in Counter(words(t)).items()]
                yield pd.DataFrame(rows, columns=["s", "w", "n"])

        def spelt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pad = START * (ORDER - 1)
            for batch in batches:
                rows = [(w, p[i : i + ORDER]) for w in batch["w"] for p in [f"{pad}{w}{END}"] for i in range(len(w) + 1)]
                yield pd.DataFrame(rows, columns=["w", "gram"])

        used = held.select(F.col(sha).alias("s"), text_of(held, text).alias("t")).mapInPandas(counted, "s string, w string, n int").groupBy("s", "w").agg(F.max("n").alias("n"))
        context = lambda c: F.expr(f"substring({c}, 1, {ORDER - 1})")
        open_ = self.ratios.groupBy(context("gram").alias("c")).agg(F.first(f"{which}_c").alias("y"))
        grams = used.select("w").distinct().mapInPandas(spelt, "w string, gram string").withColumn("c", context("gram"))
        grams = grams.join(self.ratios.select("gram", F.col(which).alias("x")), "gram", "left").join(open_, "c", "left")
        ratio = grams.groupBy("w").agg(F.sum(F.coalesce("x", "y", F.lit(0.0))).alias("r"))

        @F.pandas_udf("double")
        def of_words(ratios: pd.Series, times: pd.Series) -> pd.Series:
            return pd.Series([evidence(np.repeat(np.array(r, np.float64), np.array(n))) for r, n in zip(ratios, times, strict=True)])

        texts = used.join(ratio, "w").groupBy("s").agg(F.collect_list(F.struct("r", "n")).alias("a")).select(F.col("s").alias(key), of_words(F.col("a.r"), F.col("a.n")).alias("e"))
        return held.join(texts.withColumnRenamed("e", to), held[sha] == texts[key], "left").withColumn(to, F.coalesce(to, F.lit(0.0))).drop(sha, key)

    def with_score(self, docs: DataFrame, to: str, text: str = "text") -> DataFrame:
        if self.ratios is None:
            return docs.withColumn(to, F.lit(0.0))
        slope, shift = self.curve
        return self.with_evidence(docs, to, text).withColumn(to, 1 / (1 + F.exp(-(F.col(to) * slope + shift))))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_grams: int = BROADCAST_GRAMS) -> Scorer:
    """A scorer learnt from the labelled rows that are not held out."""
    with Scratch(docs.sparkSession) as scratch:
        grams = scratch.write(count_grams(_labelled(docs, labels, doc_id, text)), "grams")
        sizes = grams.agg(F.sum("t"), F.sum("o")).first()
        if not sizes[0] or not sizes[1]:
            return Scorer(None)
        scorer = Scorer(scratch.keep(scratch.write(gram_ratios(grams), "ratios")), broadcast_grams=broadcast_grams)
        scorer.curve = _fit(docs, labels, scorer, doc_id, text)
    return scorer


def _fit(docs: DataFrame, labels: DataFrame, scorer: Scorer, doc_id: str, text: str) -> tuple[float, float]:
    """The curve, on at most ``MAX_FIT`` held-back labelled documents."""
    said = labels.select(labels["doc_id"].alias("__l"), labels["toxic"].cast("double").alias("toxic")).where((F.col("toxic").isin(0.0, 1.0)) & (fold(F.col("__l")) == 3))
    said = said.groupBy("__l").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("__l"), "__l").limit(MAX_FIT)
    rows = docs.select(docs[doc_id].alias("__d"), text_of(docs, text).alias("text")).join(F.broadcast(said), F.col("__d") == F.col("__l"))
    rows = scorer.with_evidence(rows, "x", which="part").groupBy("__d").agg(F.min("x").alias("x"), F.max("toxic").alias("y"))
    got = rows.select("x", "y").toPandas().sort_values(["x", "y"]).to_numpy()  # at most MAX_FIT rows
    return fit_logistic(got[:, 0], got[:, 1]) if len(got) else DEFAULT_CURVE


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    scored = train(docs, labels, doc_id, text).with_score(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "score")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold."""
    to = fresh(docs, "score")[0]
    return train(docs, labels, doc_id, text).with_score(docs, to, text).where(F.col(to) < threshold).drop(to)
