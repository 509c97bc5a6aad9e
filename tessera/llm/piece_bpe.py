"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A batch of texts is cut into words at spaces (no piece has a space mark behind
another character, which ``PieceModel`` checks), and only words not seen
before are encoded.  Their characters form one flat array of symbol ids with
word borders.  Each round looks up the rank of every adjacent pair, takes the
minimum rank of each word with a segmented minimum, merges its leftmost
occurrences in all words at once and compacts the arrays; words without a pair
leave.  It ends when no pair remains.

The library merges one pair at a time, best score first, leftmost first.
Merging several occurrences of a word's best pair at once gives the same result
as long as no merged piece forms a pair of an equal or better score with its
neighbours as they are at that moment: merged ones on the left, unmerged ones
on the right.  A round therefore takes a word's occurrences from the left up to
and including the first that does.

Two kinds of text would still need a round for nearly every symbol.  Long runs
of spaces are cut into runs of the longest space piece, if the model merges all
its space pieces at one score from the left, which is checked by encoding; a
segment of over ``LONG`` symbols without a border goes through a queue of pairs,
as the library does it, in time n log n.

Defined cases: a null text is the empty text, with no ids; any characters
outside the vocabulary become their UTF-8 bytes' pieces (or <unk> if the model
has none); very long texts, with or without spaces, take time in proportion to
n log n at most; repeated rows are encoded alike; an empty table gives an empty
table.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
NONE = np.int64(1 << 40)
CACHE_WORDS, LONG = 300_000, 2048
CHUNK_CHARS, MERGE_CHARS = 1_000_000, 250_000  # texts and new words taken at once; a merge needs some hundred bytes a character
_MARKED = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; fixed32 values as bytes."""
    at, end = 0, len(buf)

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = buf[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind in (1, 2, 5):
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, buf[at : at + size]
            at += size
        else:
            raise ValueError(f"unexpected wire type {kind}")


class PieceModel:
    """Vocabulary and merge table of a SentencePiece BPE model file's bytes."""

    def __init__(self, data: bytes):
        pieces, scores, kinds = [], [], []
        norm: dict[int, int | bytes] = {}
        trainer: dict[int, int | bytes] = {}
        for field, value in _fields(data):
            if field == 1:
                one = dict(_fields(value))
                pieces.append(one.get(1, b"").decode())
                scores.append(np.frombuffer(one.get(2, b"\0\0\0\0"), "<f4")[0])
                kinds.append(one.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                norm = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("not a BPE model")
        if norm.get(2) or norm.get(4, 1) or not norm.get(5, 1):
            raise ValueError("only identity normalisation with escaped and unmerged white space is supported")
        if USER_DEFINED in kinds:
            raise ValueError("user-defined symbols are not supported")
        self.pieces, self.size = pieces, len(pieces)
        self.by_pair: dict[int, tuple[int, int]] = {}
        self.prefix = bool(norm.get(3, 1))
        own = {p: i for i, p in enumerate(pieces) if kinds[i] == NORMAL}
        if any(p[k] != MARK and p[k + 1] == MARK for p in own for k in range(len(p) - 1)):
            raise ValueError("a piece has a space mark behind another character")
        if any(c not in own for p in own for c in p):
            raise ValueError("a piece has a character that is no piece")
        self.unk = kinds.index(UNKNOWN)
        by_byte = {int(p[1:-1], 16): i for i, p in enumerate(pieces) if kinds[i] == BYTE}
        self.byte_ids = [by_byte.get(b, self.unk) for b in range(256)]
        self.has_bytes = len(by_byte) == 256
        #: What each id adds to a decoded text; the byte pieces' own values.
        self.out = [b"" if kinds[i] == CONTROL else " ⁇ ".encode() if kinds[i] == UNKNOWN else bytes([int(p[1:-1], 16)]) if kinds[i] == BYTE else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.is_byte = np.array([k == BYTE for k in kinds])
        self.is_control = np.array([k == CONTROL for k in kinds])
        ranks = {s: r for r, s in enumerate(sorted({scores[i] for i in own.values()}, reverse=True))}
        rank = {p: ranks[scores[i]] for p, i in own.items()}
        shared = {r for r, n in zip(*np.unique(list(rank.values()), return_counts=True), strict=True) if n > 1}
        pairs, alone, inside = {}, set(), set()
        for p, i in own.items():
            for k in range(1, len(p)):
                a, b = own.get(p[:k]), own.get(p[k:])
                inside.add(ord(p[k - 1]) << 21 | ord(p[k]))
                if a is not None and b is not None:
                    pairs[a * self.size + b] = (rank[p], i)
                    alone |= {q for q in (p[:k], p[k:]) if rank[p] <= rank[q]}
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.to = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        self.alone = np.zeros(self.size, bool)  # pieces that may form an equal or better pair
        self.alone[[own[p] for p in own if p in alone or rank[p] in shared]] = True
        self.inside = np.array(sorted(inside), np.int64)  # character pairs within pieces
        single = {ord(p): i for p, i in own.items() if len(p) == 1}
        self.of_char = np.full(max(single) + 1, -1, np.int64)
        self.of_char[list(single)] = list(single.values())
        self.run = self._space_run()

    def _space_run(self) -> int:
        """Length of the space piece that a long run of spaces consists of from
        its left, whatever follows; 0 if that doesn't hold for this model."""
        marks = [p for p in self.pieces if p and set(p) == {MARK}]
        n = max(map(len, marks), default=0)
        if n < 2:
            return 0
        piece, tails = self.pieces.index(MARK * n), ["", "a", "the", "\n", "."]
        runs = [MARK * k + t for k in range(n, 4 * n) for t in tails]
        ids, sizes = self.merged(runs)
        ends = np.cumsum(sizes)
        of = {r: ids[e - k : e].tolist() for r, k, e in zip(runs, sizes.tolist(), ends.tolist(), strict=True)}
        same = all(of[MARK * k + t] == [piece, *of[MARK * (k - n) + t]] for k in range(2 * n, 4 * n) for t in tails)
        return n if same else 0

    def _one_by_one(self, sym: list[int]) -> list[int]:
        """A segment's symbols merged in the library's order: best rank first,
        leftmost first, by a queue of pairs."""
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        alive = [True] * len(sym)
        table = {k: (r, t) for k, r, t in zip(self.keys.tolist(), self.rank.tolist(), self.to.tolist(), strict=True)} if not self.by_pair else self.by_pair
        self.by_pair = table
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(sym) and sym[i] < self.size and sym[j] < self.size and (got := table.get(sym[i] * self.size + sym[j])):
                heapq.heappush(heap, (got[0], i, sym[i], sym[j], got[1]))

        for i in range(len(sym) - 1):
            offer(i)
        while heap:
            _, i, x, y, to = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or sym[i] != x or j >= len(sym) or sym[j] != y:
                continue  # one of the two was merged meanwhile
            sym[i], alive[j], after[i] = to, False, after[j]
            if after[i] < len(sym):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [s for s, a in zip(sym, alive, strict=True) if a]

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index into the merge table of each pair, -1 where there is none."""
        key = np.where((left < self.size) & (right < self.size), left * self.size + right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the number of ids of each."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        known = np.where(chars < len(self.of_char), self.of_char[np.minimum(chars, len(self.of_char) - 1)], -1)
        sym = np.where(known >= 0, known, self.size + chars)
        # A segment is a part of a word that no piece reaches across.
        cut = np.ones(len(sym), bool)
        if len(sym) > 1:
            both = chars[:-1] << 21 | chars[1:]
            at = np.minimum(np.searchsorted(self.inside, both), len(self.inside) - 1)
            cut[1:] = (word[1:] != word[:-1]) | (self.inside[at] != both)
        seg = np.cumsum(cut) - 1
        home = word[cut]  # the word of each segment
        done_sym, done_seg = [], []
        lengths = np.bincount(seg) if len(seg) else np.zeros(0, np.int64)
        for k in np.flatnonzero(lengths > LONG).tolist():
            own = np.array(self._one_by_one(sym[seg == k].tolist()), np.int64)
            done_sym.append(own)
            done_seg.append(np.full(len(own), k))
        if done_sym:
            short = (lengths <= LONG)[seg]
            sym, seg, cut = sym[short], seg[short], cut[short]
        pair = np.full(len(sym), -1, np.int64)
        if len(sym) > 1:
            pair[:-1] = np.where(cut[1:], -1, self._pairs(sym[:-1], sym[1:]))
        while len(sym):
            begin = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            rank = np.where(pair >= 0, self.rank[pair], NONE)
            least = np.minimum.reduceat(rank, begin)
            count = np.diff(np.r_[begin, len(sym)])
            on = np.repeat(least < NONE, count)
            if not on.all():
                done_sym.append(sym[~on])
                done_seg.append(seg[~on])
                sym, seg, pair, rank = sym[on], seg[on], pair[on], rank[on]
                going = least < NONE
                least, count = least[going], count[going]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, count))
            to = self.to[pair[hit]]
            # Leftmost first: in a run of overlapping hits every second one.
            new_run = np.r_[True, (hit[1:] != hit[:-1] + 1) | (seg[hit[1:]] != seg[hit[:-1]])]
            order = np.arange(len(hit))
            start = np.maximum.accumulate(np.where(new_run, order, 0))
            take = (order - start) % 2 == 0
            hit, to = hit[take], to[take]
            if self.alone[to].any():
                # Up to the first whose piece forms a pair as good at once.
                left = np.where(np.r_[False, hit[1:] == hit[:-1] + 2], np.r_[0, to[:-1]], sym[hit - 1])
                right = np.minimum(hit + 2, len(sym) - 1)
                tied = np.zeros(len(hit), bool)
                for other, there in ((self._pairs(left, to), (hit > 0) & (seg[hit - 1] == seg[hit])), (self._pairs(to, sym[right]), (hit + 2 < len(sym)) & (seg[right] == seg[hit]))):
                    tied |= there & (other >= 0) & (self.rank[other] <= rank[hit])
                first = np.r_[True, seg[hit[1:]] != seg[hit[:-1]]]
                before = np.cumsum(tied) - tied
                take = before == np.maximum.accumulate(np.where(first, before, 0))
                hit, to = hit[take], to[take]
            sym[hit] = to
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            moved = np.cumsum(keep) - 1
            sym, seg, pair = sym[keep], seg[keep], pair[keep]
            at = moved[hit]
            again = np.unique(np.r_[at, np.maximum(at - 1, 0)])
            inner = again[again + 1 < len(sym)]
            inner = inner[seg[inner] == seg[inner + 1]]
            pair[again] = -1
            pair[inner] = self._pairs(sym[inner], sym[inner + 1])
        sym, seg = np.concatenate(done_sym or [sym]), np.concatenate(done_seg or [seg])
        order = np.argsort(seg, kind="stable")
        return self._fallback(sym[order], home[seg[order]], len(words))

    def _fallback(self, sym: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters outside the vocabulary become byte pieces or <unk>."""
        odd = np.flatnonzero(sym >= self.size)
        if len(odd):
            made = [[self.byte_ids[b] for b in chr(c).encode("utf-8", "surrogatepass")] if self.has_bytes else [self.unk] for c in (sym[odd] - self.size).tolist()]
            times = np.ones(len(sym), np.int64)
            times[odd] = [len(m) for m in made]
            sym, word, mask = np.repeat(sym, times), np.repeat(word, times), np.repeat(sym >= self.size, times)
            sym[mask] = np.concatenate(made)
        return sym, np.bincount(word, minlength=n)

    def words(self, text: str) -> list[str]:
        """Parts of the marked text that are encoded each on its own."""
        if not text:
            return []
        if self.prefix and "  " not in text and MARK not in text and "\0" not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")  # the mark before each is understood
        marked = (MARK if self.prefix else "") + text.replace(" ", MARK)
        return [part for w in _MARKED.findall(marked) for part in self._cut_run(w)]

    def _cut_run(self, word: str) -> list[str]:
        """A word after very many spaces as runs of them and the rest."""
        n = self.run
        if not n or not word.startswith(MARK * 3 * n):
            return ["\0" + word]
        k = (len(word) - len(word.lstrip(MARK)) - n) // n
        return ["\0" + MARK * n] * k + ["\0" + word[k * n :]]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``, as the library's decode gives it."""
        if len(ids) == 0:
            return ""
        raw = b"".join(map(self.out.__getitem__, ids.tolist()))
        first = next((i for i in ids.tolist() if not self.is_control[i]), None)
        bare = self.prefix and first is not None and self.pieces[first].startswith(MARK)
        try:
            return raw[bare:].decode()
        except UnicodeDecodeError:
            return self._careful(ids.tolist())[bare:]

    def _careful(self, ids: list[int]) -> str:
        out, run = [], b""
        for i in [*ids, -1]:
            if i >= 0 and self.is_byte[i]:
                run += self.out[i]
                continue
            while run:  # one replacement character for each byte that begins no character
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[:n].decode())
                        run = run[n:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    run = run[1:]
            if i >= 0:
                out.append(self.out[i].decode())
        return "".join(out)


class Encoder:
    """A model with the words encoded so far; both bounded."""

    def __init__(self, model: PieceModel):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.start, self.size, self.used = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _learn(self, new: list[str]) -> None:
        marked = [w[1:] if w[0] == "\0" else MARK + w for w in new]
        ids, sizes = self.model.merged(marked)
        n, need = len(self.at), self.used + len(ids)
        while need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(new) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.flat[self.used : need] = ids
        self.start[n : n + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(new)] = sizes
        self.at |= {w: n + i for i, w in enumerate(new)}
        self.used = need

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of a batch and the offsets of its texts."""
        if len(self.at) > CACHE_WORDS:
            self._forget()
        split = [self.model.words(t) for t in texts]
        new = dict.fromkeys(w for words in split for w in words if w not in self.at)
        for part in _chunks(new, MERGE_CHARS):
            self._learn(part)
        index = np.array([self.at[w] for words in split for w in words], np.int64)
        sizes = self.size[index]
        ends = np.cumsum(sizes)
        take = np.repeat(self.start[index] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        bounds = np.r_[0, ends][np.cumsum([0, *map(len, split)])]
        if any(len(w) > 4096 for w in new):  # don't keep very long words
            flat = self.flat[take]
            self._forget()
            return flat, bounds
        return self.flat[take], bounds


_encoders: dict[int, Encoder] = {}


def _chunks(texts: Iterable[str], chars: int = CHUNK_CHARS) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_documents(docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded string for every row of ``docs``.

    The model file is read on the driver and its half a megabyte travels with
    the function, so executors need not have it.
    """
    with open(model_file, "rb") as f:
        data = f.read()
    PieceModel(data)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("doc_id", base.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    mark = hash(data)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if mark not in _encoders:
            _encoders.clear()
            _encoders[mark] = Encoder(PieceModel(data))
        encoder = _encoders[mark]
        for batch in batches:
            keys, texts, at = batch.column(0), (t.as_py() for t in batch.column(1)), 0
            for part in _chunks(texts):
                flat, bounds = encoder.encode(part)
                decoded = [encoder.model.decode(flat[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([keys.slice(at, len(part)), ids, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])
                at += len(part)

    return base.mapInArrow(run, schema)
