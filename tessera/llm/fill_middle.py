"""Fill-in-the-middle transformation over run-length encoded character classes.

A text is stored as its maximal runs of characters of one class (white space or
not), each with its end and the units that end within it or before.  Units are
tokens (a word with the white space before it; white space at the text's end is
one of its own) or characters.  A cut after u units lies in the first run whose
cumulative units reach u, found by binary search; its offset is the run's end
less the units still to come times their length there.  Nothing is looked at
character by character but to find the runs, and texts are cut, marked and put
together again by Spark's own string functions.

Which documents are transformed, how, and where they are cut comes from a hash of
seed and id: the first four 32-bit words of sha256(``seed:id``).

Defined cases: a null text is the empty text; empty texts and texts that contain
a mark stay plain; a text of white space is one token; a null id hashes as '';
repeated rows are transformed alike; a very long text needs memory for its runs
only; other columns are not read, whatever their names; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class Runs:
    """Maximal runs of white space or other characters: ``ends`` in code points,
    ``units`` completed up to there, ``each``: code points of a unit in a run."""

    def __init__(self, text: str, unit: str = "token"):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        space = (points == 32) | ((points >= 9) & (points <= 13))
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1 if len(points) else np.zeros(0, np.int64)
        self.ends = np.r_[edges, len(points)] if len(points) else edges
        sizes = np.diff(self.ends, prepend=0)
        if unit == "character":
            self.units, self.each = self.ends, np.ones(len(sizes), np.int64)
            return
        word = ~space[self.ends - 1]
        if len(word):
            word[-1] = True  # white space at the end is a token of its own
        self.units, self.each = np.cumsum(word), sizes

    def __len__(self) -> int:
        """Units of the text."""
        return int(self.units[-1]) if len(self.units) else 0

    def offset(self, units: int) -> int:
        """Code points of the first ``units`` units."""
        if units <= 0 or not len(self.units):
            return 0
        run = int(np.searchsorted(self.units, units))
        return int(self.ends[run] - (self.units[run] - units) * self.each[run])


def _words(ident: Column, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text again, from the transformed text and its form alone."""
    until = lambda c, mark: F.substring_index(c, mark, 1)
    after = lambda c, mark: F.substring(c, F.length(until(c, mark)) + len(mark) + 1, F.length(c))
    psm, spm = F.substring(output, F.lit(len(PREFIX) + 1), F.length(output)), F.substring(output, F.lit(len(SUFFIX) + 1), F.length(output))
    middle_psm, middle_spm = after(psm, SUFFIX), after(spm, PREFIX)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(until(psm, SUFFIX), after(middle_psm, MIDDLE), until(middle_psm, MIDDLE)))
        .otherwise(F.concat(until(middle_spm, MIDDLE), after(middle_spm, MIDDLE), until(spm, PREFIX)))
    )


def transform_documents(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, unit: str = "token", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars
    (null: plain), output.  ``rate``: per cent of the documents transformed;
    ``spm_rate``: per cent of those that begin with the suffix."""

    @F.pandas_udf("n long, prefix long, middle long")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, first, second in batches:
            out = np.zeros((len(texts), 3), np.int64)
            for i, (body, a, b) in enumerate(zip(texts, first.tolist(), second.tolist(), strict=True)):
                runs = Runs(body, unit)
                n = len(runs)
                low, high = sorted((a % (n + 1), b % (n + 1)))
                start = runs.offset(low)
                out[i] = n, start, runs.offset(high) - start
            yield pd.DataFrame(out, columns=["n", "prefix", "middle"])

    h1, h2, h3, h4 = _words(docs[doc_id], seed)
    body = F.col("body")
    rows = docs.select(docs[doc_id].alias("doc_id"), text_of(docs, text).alias("body"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    plain = (body == "") | body.contains(PREFIX) | body.contains(SUFFIX) | body.contains(MIDDLE) | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm")
    rows = rows.select("doc_id", "body", form.alias("form"), cut("body", "h1", "h2").alias("cut")).select("doc_id", "body", "form", "cut.n", "cut.prefix", "cut.middle")
    prefix, middle = F.substring(body, F.lit(1), F.col("prefix").cast("int")), F.substring(body, F.col("prefix").cast("int") + 1, F.col("middle").cast("int"))
    suffix = F.substring(body, (F.col("prefix") + F.col("middle")).cast("int") + 1, F.length(body))
    output = (
        F.when(F.col("form") == "plain", body)
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    moved = F.col("form") != "plain"
    return rows.select("doc_id", "n", "form", F.when(moved, F.col("prefix")).alias("prefix_chars"), F.when(moved, F.col("middle")).alias("middle_chars"), output.alias("output"))
