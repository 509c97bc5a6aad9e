"""Scoring texts with a gated recurrent language model trained on the corpus.

Tokens are words between ASCII white space, A-Z lower-cased, and one end mark a
text.  The ``HEAD`` commonest words have vectors of their own, all others share
those of their class.  The output softmax is factored by class: ``HEAD_CLASSES``
classes of common words by rank, in which a second softmax chooses the word, and
``RARE_CLASSES`` classes of the other words by their last two bytes, in which a
word has its smoothed share of the class's counts, one share being kept for all
words never seen.  Every text's probabilities therefore add up to one.

The model is one layer of gated units, trained in numpy by truncated
backpropagation (windows of ``WINDOW`` tokens in ``LANES`` parallel lanes; a
lane's state is carried from window to window and cleared where a text begins)
with Adagrad.  Training is by rounds of parameter mixing: in each round every
partition goes through its part of that round's texts from the same start, and
Spark averages weights and step sizes by tokens.  Rounds grow fourfold, so all
training texts are used exactly once and the early models are mixed often.
Scoring carries the state through the whole text.

Counts of all words are exact and stay in a written table.  Tasks hold the
``DICTIONARY`` commonest words of at most ``LONGEST`` bytes; occurrences of
other words are joined with the table.  Where a word is looked up changes no
result.  The driver holds the dictionary, the class sums (two bytes each) and the
model, all of fixed size.

Defined cases: a null text is the empty text, whose only token is the end; a
null id counts as the text '' when texts are dealt to training; repeated rows
teach and are scored each; a very long text is one lane of fixed-size windows; a
table without training rows gives base and model scores of an empty vocabulary,
0; columns besides id and text are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import itertools
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Scratch, text_of

HIDDEN = 24
HEAD, HEAD_CLASSES = 1024, 16
RARE_CLASSES, OWN_CLASSES = 48, 36  # the commonest endings have a class each, the others share the rest
PER_CLASS = HEAD // HEAD_CLASSES
LANES, WINDOW, PASSES = 256, 16, 64
RATE, G0, CLIP = 0.1, 1e-4, 5.0
ROUNDS, GROWTH = 4, 4
DICTIONARY, LONGEST = 1 << 18, 256
FLUSH_WORDS, FLUSH_TOKENS, SCORE_TOKENS = 1 << 18, 1 << 20, 1 << 21
BLOCK = 4096
#: 2^x for x from -1/2 to 1/2 as a polynomial, and what rounds a float32 in its last bits.
POWERS = [np.float32(c) for c in (0.999999261, 0.693121815, 0.240247448, 0.0559178603, 0.00957010143)]
LOG2E, ROUNDER, AT_ONCE = np.float32(np.log2(np.e)), np.float32(1.5 * 2**23), 1 << 15
#: The end mark: no word contains a space.
END = b" "
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_INSIDE = bytes(c not in b" \t\n\v\f\r" for c in range(256))
_END_PLACE = 65536 + END[0]


def folded(text: str) -> bytes:
    """UTF-8 with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD)


def tokens(text: str) -> list[bytes]:
    """The words; ``bytes.split`` splits at ASCII white space."""
    return folded(text).split()


def endings(text: bytes) -> np.ndarray:
    """The last two bytes of every word as a number below 65,792: of one-byte
    words the byte after all pairs."""
    flat = b" " + text + b" "
    codes, inside = np.frombuffer(flat, np.uint8), np.frombuffer(flat.translate(_INSIDE), bool)
    ends = np.flatnonzero(inside[:-1] > inside[1:])
    out = codes[ends - 1].astype(np.int32)
    out[~inside[ends - 1]] = 256
    out <<= 8
    out += codes[ends]
    return out


def is_held_out(ident: Column, folds: int = 7, held: int = 2) -> Column:
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % folds == held


# --- vocabulary ------------------------------------------------------------------
class Vocabulary:
    """What tasks know of the words: symbols of all (a place in the head, or HEAD
    and the rare class of an ending), places and counts of the dictionary's, sums
    of the rare classes."""

    def __init__(self, words: list[bytes], counts: list[int], suffixes: dict[bytes, tuple[int, int]], n: int, distinct: int):
        """``words``, ``counts``: the dictionary, commonest first; ``suffixes``: count
        and number of the training words by their last two bytes."""
        self.n, self.distinct, self.size = n, distinct, min(HEAD, len(words))
        self.head_counts = np.array(counts[: self.size], np.float64)
        left = {s: np.array(x, np.int64) for s, x in suffixes.items()}
        for w, c in zip(words[: self.size], counts, strict=False):
            left[w[-2:]] -= (c, 1)
        order = sorted((s for s, x in left.items() if x[1] > 0), key=lambda s: (-int(left[s][0]), s))
        self.suffix_class = {s: i for i, s in enumerate(order[:OWN_CLASSES])}
        sums = np.zeros((RARE_CLASSES, 2))
        for s in order:
            sums[self.rare_class(s)] += left[s]
        self.rare_counts = sums[:, 0]
        #: log10 of a class's counts with one added for each word and one for all unseen.
        self.totals = np.log10(sums.sum(axis=1) + 1)
        self.place = {w: i for i, w in enumerate(words)}
        self.head = {w: i for i, w in enumerate(words[: self.size])}
        ends = [bytes(divmod(i, 256)) for i in range(65536)] + [bytes([i]) for i in range(256)]
        self.rare_symbol = np.array([HEAD + self.rare_class(s) for s in ends], np.int32)
        self.logs = np.log10(np.array(counts, np.float64) + 1)

    def rare_class(self, word: bytes) -> int:
        s = word[-2:]
        found = self.suffix_class.get(s)
        return OWN_CLASSES + (int.from_bytes(s, "big") * 2654435761 >> 7) % (RARE_CLASSES - OWN_CLASSES) if found is None else found

    def encode(self, text: str) -> tuple[np.ndarray, list[bytes]]:
        """Symbols of the words and of the end mark, and those."""
        return self._looked_up(text, self.head)[:2]

    def encode_with_places(self, text: str) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Also their places in the dictionary, -1 outside; one look at each word."""
        return self._looked_up(text, self.place)

    def _looked_up(self, text: str, among: dict[bytes, int]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        flat = folded(text)
        words = [*flat.split(), END]
        places = np.fromiter(map(among.get, words, itertools.repeat(-1)), np.int32, len(words))
        symbols = np.empty(len(words), np.int32)
        symbols[:-1], symbols[-1] = self.rare_symbol[endings(flat)], self.rare_symbol[_END_PLACE]
        np.copyto(symbols, places, where=(places >= 0) & (places < HEAD))
        return symbols, words, places


# --- the model ---------------------------------------------------------------------
def by_token(a: np.ndarray) -> np.ndarray:
    """(steps, numbers, lanes) as a row of numbers for each step and lane."""
    return a.transpose(0, 2, 1).reshape(-1, a.shape[1])


def exponentials(a: np.ndarray) -> np.ndarray:
    """exp within 3e-06 of itself, in place if ``a`` is float32: a power of two and a
    polynomial for the rest, a few thousand numbers at a time.  Plain operations
    run over whole vectors, numpy's exp takes twice their time."""
    a = np.ascontiguousarray(a, np.float32)
    flat, whole, part = a.reshape(-1), np.empty(AT_ONCE, np.float32), np.empty(AT_ONCE, np.float32)
    for i in range(0, len(flat), AT_ONCE):
        x = flat[i : i + AT_ONCE]
        n, p = whole[: len(x)], part[: len(x)]
        x *= LOG2E
        np.add(x, ROUNDER, out=n)  # the nearest whole number is in its last bits
        np.subtract(n, ROUNDER, out=p)
        x -= p
        np.multiply(x, POWERS[-1], out=p)
        for c in POWERS[-2:0:-1]:
            p += c
            p *= x
        np.add(p, POWERS[0], out=x)
        bits = n.view(np.int32)
        bits <<= 23
        np.add(x.view(np.int32), bits, out=x.view(np.int32))
    return a


class Network:
    """One layer of gated units with a class-factored softmax.  Gates and states
    are bent by x / (1 + |x|), which needs no exponential.

    ``inputs``: a row of three gates for each symbol, and one for the start;
    ``recur``: state to gates; ``to_class``, ``to_word``: state and bias to
    classes, and to the words of each head class.
    """

    SHAPES = {
        "inputs": (HEAD + RARE_CLASSES + 1, 3 * HIDDEN),
        "recur": (HIDDEN, 3 * HIDDEN),
        "to_class": (HIDDEN + 1, HEAD_CLASSES + RARE_CLASSES),
        "to_word": (HEAD_CLASSES, HIDDEN + 1, PER_CLASS),
    }
    START = HEAD + RARE_CLASSES

    def __init__(self, values: np.ndarray, steps: np.ndarray):
        self.w, self.g = self._cut(values), self._cut(steps)

    @classmethod
    def _cut(cls, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in cls.SHAPES.items():
            n = int(np.prod(shape))
            out[name] = np.array(flat[at : at + n], np.float32).reshape(shape)
            at += n
        return out

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        join = lambda d: np.concatenate([d[n].ravel() for n in self.SHAPES])
        return join(self.w), join(self.g)

    @classmethod
    def fresh(cls, vocabulary: Vocabulary, seed: int = 1) -> Network:
        """Small random weights; biases say what the counts alone say."""
        rng, size = np.random.default_rng(seed), sum(int(np.prod(s)) for s in cls.SHAPES.values())
        net = cls(rng.normal(0, 0.1, size).astype(np.float32), np.full(size, G0, np.float32))
        per = PER_CLASS
        counts = np.zeros(HEAD_CLASSES * per)
        counts[: vocabulary.size] = vocabulary.head_counts
        counts = counts.reshape(HEAD_CLASSES, per)
        classes = np.r_[counts.sum(axis=1), vocabulary.rare_counts + 1]
        # Places without a word are never chosen.
        net.w["to_class"][-1] = np.where(classes > 0, np.log(np.maximum(classes, 1) / classes.sum()), -1e4)
        net.w["to_word"][:, -1] = np.where(counts > 0, np.log(np.maximum(counts, 1) / np.maximum(counts.sum(axis=1, keepdims=True), 1)), -1e4)
        return net

    def forward(self, x: np.ndarray, keep: np.ndarray, h: np.ndarray, learn: bool = True) -> dict:
        """Steps of a window: symbols x and keep (0: the text begins here), both
        (steps, lanes); h: (HIDDEN, lanes), the state before it.  The states and, with
        ``learn``, what the way back needs, with lanes last so that every operation
        runs over whole rows."""
        steps, lanes = x.shape
        H, recur = HIDDEN, np.ascontiguousarray(self.w["recur"].T)
        gates = np.ascontiguousarray(self.w["inputs"].take(x, axis=0).transpose(0, 2, 1))
        states, kept = np.empty((steps, H, lanes), np.float32), steps if learn else 1
        before, new, zr, u = (np.empty((kept, n * H, lanes), np.float32) for n in (1, 1, 2, 3))
        size = np.empty((2 * H, lanes), np.float32)
        for step in range(steps):
            t = step if learn else 0
            np.multiply(h, keep[step], out=before[t])
            np.matmul(recur, before[t], out=u[t])
            s = zr[t]
            np.add(gates[step, : 2 * H], u[t, : 2 * H], out=s)
            np.abs(s, out=size)
            size += 1
            s /= size
            s *= 0.5
            s += 0.5
            n = new[t]
            np.multiply(s[H:], u[t, 2 * H :], out=n)
            n += gates[step, 2 * H :]
            np.abs(n, out=size[:H])
            size[:H] += 1
            n /= size[:H]
            h = states[step]
            np.subtract(before[t], n, out=h)
            h *= s[:H]
            h += n
        return {"x": x, "keep": keep, "before": before, "states": states, "zr": zr, "new": new, "inner": u[:, 2 * H :]}

    @staticmethod
    def _likelihoods(logits: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp of the logits and their sums.  States lie within -1 and 1, so logits
        are bounded by the weights; the cut only keeps exp finite."""
        most = np.abs(w[..., :-1, :]).sum(axis=-2)
        if (most + w[..., -1, :]).max() > 80 or (most - w[..., -1, :]).max() > 80:
            np.clip(logits, -80, 80, out=logits)
        e = exponentials(logits)
        return e, e @ np.ones(e.shape[1], np.float32)

    def outputs(self, states: np.ndarray, y: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray | None, dict | None]:
        """Log-probabilities of symbols y after ``states``; with ``learn`` also the
        gradients of their negative sum by states, and by the output weights."""
        per, to_class, to_word = PER_CLASS, self.w["to_class"], self.w["to_word"]
        order = np.argsort(y.astype(np.int16), kind="stable")
        # A last column of ones meets the biases.
        s = np.ones((len(y), HIDDEN + 1), np.float32)
        s[:, :-1] = states.take(order, axis=0)
        y, rows = y[order], np.arange(len(y))
        group = np.where(y < HEAD, y // per, y - (HEAD - HEAD_CLASSES))
        edges = np.searchsorted(y, per * np.arange(HEAD_CLASSES + 1)).tolist()
        head = edges[-1]
        parts = [(c, slice(lo, hi)) for c, (lo, hi) in enumerate(itertools.pairwise(edges)) if lo < hi]
        of_word = np.empty((head, per), np.float32)
        for c, at in parts:
            np.matmul(s[at], to_word[c], out=of_word[at])
        e, total = self._likelihoods(s @ to_class, to_class)
        of_word, sums = self._likelihoods(of_word, to_word)
        chosen, word = (rows, group), (rows[:head], y[:head] % per)
        likely = e[chosen] / total
        likely[:head] *= of_word[word] / sums
        logs = np.empty(len(y))
        logs[order] = np.log(np.maximum(likely, 1e-30))
        if not learn:
            return logs, None, None
        # Rows are divided by their sums where they are narrow, not here.
        e[chosen] -= total
        of_word[word] -= sums
        total, sums = 1 / total[:, None], 1 / sums[:, None]
        grads = {"to_class": (s * total).T @ e, "to_word": {}}
        back = (e @ to_class[:-1].T) * total
        if head:
            scaled, by_word = s[:head] * sums, np.empty((head, HIDDEN), np.float32)
            for c, at in parts:
                grads["to_word"][c] = scaled[at].T @ of_word[at]
                np.matmul(of_word[at], to_word[c, :-1].T, out=by_word[at])
            by_word *= sums
            back[:head] += by_word
        unsorted = np.empty_like(back)
        unsorted[order] = back
        return logs, unsorted, grads

    def backward(self, run: dict, dh_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients by the gates' inputs (steps, 3 HIDDEN, lanes) and by recur, from
        those by the states (steps, HIDDEN, lanes)."""
        H, recur = HIDDEN, self.w["recur"]
        before, zr, new, inner, keep = run["before"], run["zr"], run["new"], run["inner"], run["keep"]
        z, r = zr[:, :H], zr[:, H:]
        d_in = np.empty((len(before), 3 * H, before.shape[2]), np.float32)
        d_recur = np.empty_like(d_in)
        # The slope of x / (1 + |x|) is (1 - |value|) squared; a gate is (1 + value) / 2.
        rest = 1 - zr
        slope = np.minimum(zr, rest)
        slope *= slope
        slope *= 2
        by_z, by_n, by_r = before - new, np.abs(new), inner * slope[:, H:]
        by_z *= slope[:, :H]
        np.subtract(1, by_n, out=by_n)
        by_n *= by_n
        by_n *= rest[:, :H]
        dh = np.zeros(before.shape[1:], np.float32)
        for t in range(len(before) - 1, -1, -1):
            dh += dh_out[t]
            d = d_in[t]
            np.multiply(dh, by_z[t], out=d[:H])
            np.multiply(dh, by_n[t], out=d[2 * H :])
            np.multiply(d[2 * H :], by_r[t], out=d[H : 2 * H])
            d_recur[t, : 2 * H] = d[: 2 * H]
            np.multiply(d[2 * H :], r[t], out=d_recur[t, 2 * H :])
            dh *= z[t]
            dh += recur @ d_recur[t]
            dh *= keep[t]
        return d_in, np.matmul(before, d_recur.transpose(0, 2, 1)).sum(axis=0)

    def step(self, name: str, grad: np.ndarray, rows: np.ndarray | int | None = None) -> None:
        """Adagrad on a whole array or on some rows of it."""
        w, g = self.w[name], self.g[name]
        if rows is None:
            g += grad * grad
            w -= RATE * grad / np.sqrt(g)
        else:
            g[rows] += grad * grad
            w[rows] -= RATE * grad / np.sqrt(g[rows])

    def learn(self, run: dict, y: np.ndarray, valid: np.ndarray) -> None:
        """One update from a window; gradients are means over its tokens."""
        flat = slice(None) if valid.all() else valid.ravel()
        states = by_token(run["states"])[flat]
        _, back, grads = self.outputs(states, y.ravel()[flat], True)
        scale = np.float32(1 / max(1, len(states)))
        dh = np.zeros((y.size, HIDDEN), np.float32)
        dh[flat] = back
        d_in, d_recur = self.backward(run, np.ascontiguousarray(dh.reshape(*y.shape, HIDDEN).transpose(0, 2, 1)))
        d_in, x = by_token(d_in)[flat], run["x"].ravel()[flat]
        order = np.argsort(x.astype(np.int16), kind="stable")
        x = x[order]
        first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        # Numbers are added in pairs, as complex ones.
        by_symbol, rows = np.add.reduceat(d_in.take(order, axis=0).view(np.complex64), first, axis=0).view(np.float32), x[first]
        found = [("recur", d_recur, None), ("to_class", grads["to_class"], None), ("inputs", by_symbol, rows)]
        found += [("to_word", g, c) for c, g in grads["to_word"].items()]
        norm = float(np.sqrt(sum(float((g * g).sum()) for _, g, _ in found))) * scale
        scale *= min(1.0, CLIP / max(norm, 1e-12))
        for name, g, at in found:
            self.step(name, g * scale, at)


class Lanes:
    """Token streams that run side by side, longest first, so that the lanes still
    running are always the first ones."""

    def __init__(self, texts: list[np.ndarray], lengths: np.ndarray):
        """``texts`` lie end to end; ``lengths``: where that is cut into lanes."""
        self.y = np.concatenate(texts) if texts else np.zeros(0, np.int32)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.lengths, self.starts, self.first = lengths, np.cumsum(lengths) - lengths, np.cumsum(sizes) - sizes
        self.keep = np.ones(len(self.y), np.float32)
        self.keep[self.first] = 0
        self.x = np.concatenate([np.full(1, Network.START, np.int32), self.y[:-1]])[: len(self.y)]
        self.x[self.first] = Network.START

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (steps, lanes) in the flat arrays, and which of them are real."""
        for t in range(0, int(self.lengths[0]) if len(self.lengths) else 0, WINDOW):
            running = int((self.lengths > t).sum())
            at = t + np.arange(min(WINDOW, int(self.lengths[0]) - t))[:, None]
            valid = at < self.lengths[None, :running]
            yield np.where(valid, self.starts[None, :running] + at, self.starts[None, :running]), valid


def learn_texts(net: Network, texts: list[np.ndarray]) -> None:
    """One pass of updates.  The stream of texts is cut into lanes of equal
    length, wherever that is, so that every window is a mixture of many texts."""
    n = sum(map(len, texts))
    lanes = Lanes(texts, np.array([len(part) for part in np.array_split(np.zeros(n, bool), max(1, min(LANES, n // (WINDOW * PASSES))))]))
    h = np.zeros((HIDDEN, len(lanes.lengths)), np.float32)
    for at, valid in lanes.windows():
        run = net.forward(lanes.x[at], lanes.keep[at], h[:, : at.shape[1]])
        net.learn(run, lanes.y[at], valid)
        h = run["states"][-1]


def score_texts(net: Network, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of every whole text.  Lanes get texts of about equal
    length together."""
    loads = [(0, i) for i in range(min(LANES, len(texts)))]
    held: list[list[int]] = [[] for _ in loads]
    for k in sorted(range(len(texts)), key=lambda k: (-len(texts[k]), k)):
        n, lane = heapq.heappop(loads)
        held[lane].append(k)
        heapq.heappush(loads, (n + len(texts[k]), lane))
    loads.sort(key=lambda x: (-x[0], x[1]))
    order = [k for _, i in loads for k in held[i]]
    lanes = Lanes([texts[k] for k in order], np.array([n for n, _ in loads], np.int64))
    logs, h = np.zeros(len(lanes.y), np.float32), np.zeros((HIDDEN, len(loads)), np.float32)
    for at, valid in lanes.windows():
        run = net.forward(lanes.x[at], lanes.keep[at], h[:, : at.shape[1]], learn=False)
        h = run["states"][-1]
        flat = slice(None) if valid.all() else valid.ravel()
        at = at.ravel()[flat]
        logs[at] = net.outputs(by_token(run["states"])[flat], lanes.y[at], False)[0]
    out = np.zeros(len(texts))
    if order:
        out[order] = np.add.reduceat(logs, lanes.first, dtype=np.float64)
    return out


# --- in Spark ------------------------------------------------------------------------
def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over the texts of the only column, end marks included.  Tasks add
    up what they have before it is shuffled."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[bytes] = Counter()
        flush = lambda: pd.DataFrame({"word": list(held.keys()), "n": list(held.values())})
        for batch in batches:
            for text in batch.iloc[:, 0]:
                held.update(tokens(text))
                held[END] += 1
                if len(held) > FLUSH_WORDS:
                    yield flush()
                    held.clear()
        yield flush()

    return texts.mapInPandas(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary_of(counts: DataFrame, dictionary: int) -> Vocabulary:
    """The tasks' vocabulary from the written table of counts."""
    # Counts in steps: exact up to 4096, then 64 a doubling, so at most some 7,000.
    step = F.when(F.col("n") < 4096, F.col("n")).otherwise(4096 + F.floor(64 * F.log2(F.col("n") / 4096))).cast("long")
    short = counts.where(F.octet_length("word") <= LONGEST).withColumn("step", step)
    room, least = dictionary, None
    for step_of, words in sorted(short.groupBy("step").count().collect(), reverse=True):
        room -= words
        if room < 0:
            break
        least = step_of
    known = short.where(F.col("step") >= least).select("word", "n").toArrow().to_pydict() if least is not None else {"word": [], "n": []}
    order = sorted(range(len(known["word"])), key=lambda i: (-known["n"][i], known["word"][i]))
    ends = counts.groupBy(F.expr("substring(word, -2, 2)").alias("s")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # two bytes: 65,792 rows at most
    return Vocabulary([known["word"][i] for i in order], [known["n"][i] for i in order], {bytes(r.s): (r.n, r.v) for r in ends}, sum(r.n for r in ends), sum(r.v for r in ends))


def train(texts: DataFrame, vocabulary: Vocabulary, deal: Column) -> Network:
    """Rounds of parameter mixing.  ``texts``: column text; ``deal``: a whole number
    by which the texts are dealt to the rounds."""
    shares = [GROWTH**i for i in range(ROUNDS)]
    dealt = F.pmod(deal, F.lit(sum(shares)))
    session = texts.sparkSession
    net, low, words = Network.fresh(vocabulary), 0, session.sparkContext.broadcast(vocabulary)
    for share in shares:
        start = session.sparkContext.broadcast(net.flat())

        def shard(batches: Iterator[pd.DataFrame], start=start) -> Iterator[pd.DataFrame]:
            mine, seen, held, size = Network(*start.value), 0, [], 0
            for batch in batches:
                for text in batch["text"]:
                    held.append(words.value.encode(text)[0])
                    size += len(held[-1])
                    if size >= FLUSH_TOKENS:
                        learn_texts(mine, held)
                        seen, held, size = seen + size, [], 0
            if size:
                learn_texts(mine, held)
            if seen + size:
                values, steps = mine.flat()
                at = range(0, len(values), BLOCK)
                yield pd.DataFrame({"block": [i // BLOCK for i in at], "n": float(seen + size), "w": [values[i : i + BLOCK] for i in at], "g": [steps[i : i + BLOCK] for i in at]})

        found = texts.where(dealt.between(low, low + share - 1)).select("text").mapInPandas(shard, "block int, n double, w array<float>, g array<float>")
        mean = lambda c: vector_to_array(Summarizer.mean(array_to_vector(c), F.col("n"))).alias(c)
        blocks = sorted(found.groupBy("block").agg(mean("w"), mean("g")).collect())  # one model
        if blocks:
            net = Network(np.concatenate([b.w for b in blocks]), np.concatenate([b.g for b in blocks]))
        low += share
        start.destroy()
    words.destroy()
    return net


def score_documents(docs: DataFrame, train_where: Callable[[Column], Column] = lambda ident: ~is_held_out(ident), dictionary: int = DICTIONARY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: every
    text's log10 probability by counts alone and by the model, both learnt from
    the rows that ``train_where`` picks."""
    session = docs.sparkSession
    base = docs.select(docs[doc_id].alias("doc_id"), (~train_where(docs[doc_id])).alias("held_out"), text_of(docs, text).alias("text"))
    taught = base.where(~F.col("held_out"))
    with Scratch(session) as scratch:
        counts = scratch.write(count_words(taught.select("text")), "words")
        vocabulary = vocabulary_of(counts, dictionary)
        net = train(taught, vocabulary, F.xxhash64("doc_id"))
        words, weights = session.sparkContext.broadcast(vocabulary), session.sparkContext.broadcast(net.flat())

        def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            voc, net, held, size = words.value, Network(*weights.value), [], 0
            # The last place, -1, is that of words outside the dictionary.
            logs, totals = np.r_[voc.logs, 0.0], np.r_[np.zeros(HEAD), voc.totals]
            rare_logs = np.where(np.arange(len(logs)) < HEAD, 0.0, logs)

            def flush() -> pd.DataFrame:
                found = score_texts(net, [h[-1] for h in held]) / np.log(10)
                rows = [(*h[:5], h[5] + x, list(h[6]), list(h[6].values())) for h, x in zip(held, found, strict=True)]
                return pd.DataFrame(rows, columns=["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "others", "times"])

            for batch in batches:
                for ident, out, body in zip(batch["doc_id"].astype(object), batch["held_out"], batch["text"], strict=True):
                    symbols, ws, places = voc.encode_with_places(body)
                    unknown = places < 0
                    others = Counter(itertools.compress(ws, unknown.tolist()))
                    base, rare = logs[places].sum(), rare_logs[places].sum() - totals[symbols].sum()
                    held.append((None if pd.isna(ident) else ident, out, len(ws), len(ws) - int(unknown.sum()), base, rare, others, symbols))
                    size += len(ws)
                    if size >= SCORE_TOKENS:
                        yield flush()
                        held, size = [], 0
            if held:
                yield flush()

        schema = f"doc_id {base.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base double, score double, others array<binary>, times array<long>"
        rows = scratch.keep(scratch.write(base.mapInPandas(scored, schema).withColumn("row", F.monotonically_increasing_id()), "scored"))
        words.destroy()
        weights.destroy()
        asked = rows.select("row", F.explode(F.arrays_zip(F.col("others").alias("word"), F.col("times").alias("times"))).alias("o")).select("row", "o.word", "o.times")
        found = asked.join(counts, "word").groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"))
        found = scratch.keep(scratch.write(found, "others"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    least = float(np.log10(float(vocabulary.n) + vocabulary.distinct + 1))
    return rows.join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("known")).alias("n_known"), F.lit(vocabulary.n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("logs") - F.col("n_tokens") * least).alias("base_score"), (F.col("score") + zero("logs")).alias("score"),
    )
