"""Personal data by anchors: an Aho-Corasick automaton finds at-signs, schemes,
signs and digits that can begin a span, and identifier cues; small local
parsers expand each anchor to its boundaries and validate what they find.

Base kinds, each leftmost and non-overlapping within its kind:

* email  from each ``@``: the run of local characters before it, dotted labels after it
* ip     from each digit-dot-digit: a chain of dotted numbers, taken four at a time
* card   from each pair of digits: the chain of digits with single spaces or hyphens
* phone  from each plus sign before a digit

Added kinds:

* url      from ``://``: scheme, host with a dot, and the rest to a blank or quote
* account  from cues such as IBAN: a number of its country's length that passes
  the IBAN checksum, in any case and grouping, or 8 to 18 digits behind a cue
* secret   from cues such as ``token``: an assigned string of 16 characters or more

Defined cases: a null text is the empty text; offsets are code points, ends
exclusive; a span that fails its validation is dropped and the search goes on
behind it; work is linear in the text, however long; repeated rows get equal
spans; a column named like the result is replaced; an empty table gives an empty
table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("url", "account", "secret")
_AT, _DOT, _DIGITS, _PLUS, _SCHEME, _ACCOUNT, _SECRET = range(7)
#: Identifier cues, fixed values; each is looked for in lower, title and upper case.
ACCOUNT_CUES = ("iban", "account number", "account no", "acct", "konto", "kontonummer", "compte", "cuenta")
SECRET_CUES = ("token", "secret", "password", "api_key", "apikey", "api key")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_REST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]{1,5})?(?:[/?#][^\s<>\"'`|]*)?")
_IBAN = re.compile(r"[\s:=#.-]{0,4}(([A-Za-z]{2})[0-9]{2}(?: ?[A-Za-z0-9]){11,30})")
_NUMBER = re.compile(r"[\s:=#.-]{1,4}((?:[0-9][ -]?){7,17}[0-9])(?![0-9])")
_ASSIGNED = re.compile(r"[\"']?\s{0,2}[:=]\s{0,2}[\"']?([A-Za-z0-9+/_=-]{16,})")
#: Length of an account number by country.
IBAN_LENGTHS = dict(
    pair.split(":")
    for pair in (
        "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22"
        " IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 MC:27 MD:24 ME:22 MK:19 MR:27 MT:31 MU:30 NL:18 NO:15 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 SA:24 SC:31 SE:24 SI:19"
        " SK:24 SM:27 ST:25 SV:28 TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20"
    ).split()
)
_SCHEMES = frozenset(("http", "https", "ftp", "ftps", "sftp", "ws", "wss"))


def _automaton() -> ahocorasick.Automaton:
    a, digits = ahocorasick.Automaton(), "0123456789"
    a.add_word("@", (_AT, 1))
    a.add_word("://", (_SCHEME, 3))
    for x in digits:
        a.add_word(f"+{x}", (_PLUS, 2))
        for y in digits:
            a.add_word(f"{x}.{y}", (_DOT, 3))
            for between in ("", " ", "-"):
                a.add_word(f"{x}{between}{y}", (_DIGITS, 2 + len(between)))
    for cues, kind in ((ACCOUNT_CUES, _ACCOUNT), (SECRET_CUES, _SECRET)):
        for cue in cues:
            for form in {cue, cue.title(), cue.capitalize(), cue.upper()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


_finder: ahocorasick.Automaton | None = None


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def iban(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def iban_span(text: str, at: int) -> tuple[int, int] | None:
    """The account number that begins at ``at`` (marks before it are skipped),
    cut to its country's length; what follows may be another word."""
    m = _IBAN.match(text, at)
    size = int(IBAN_LENGTHS.get(m.group(2).upper(), 0)) if m else 0
    if not size:
        return None
    end, held = m.start(1), 0
    while held < size and end < m.end(1):
        held += text[end] != " "
        end += 1
    whole = held == size and (end == len(text) or not (text[end].isascii() and text[end].isalnum()))
    return (m.start(1), end) if whole and iban(text[m.start(1) : end]) else None


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span, by kind and then start."""
    global _finder
    if _finder is None:
        _finder = _automaton()
    email, ip, card, phone, url, account, secret = found = [[] for _ in range(7)]
    email_end = dotted_end = chain_end = phone_end = url_end = account_end = secret_end = 0
    for last, (kind, size) in _finder.iter(text):
        at = last + 1 - size
        if kind == _DIGITS:
            if at >= chain_end:
                chain_end = _CHAIN.match(text, at).end()
                digits = text[at:chain_end].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    card.append((at, chain_end))
        elif kind == _DOT:
            if at >= dotted_end:
                while at > dotted_end and text[at - 1] in "0123456789":
                    at -= 1
                m = _DOTTED.match(text, at)
                dotted_end = m.end()
                parts = m.group().split(".")
                start = at
                for k in range(0, len(parts) - 3, 4):
                    four = parts[k : k + 4]
                    size = sum(map(len, four)) + 3
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                        ip.append((start, start + size))
                    start += size + 1
        elif kind == _AT:
            if at >= email_end:
                start = at
                while start > email_end and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at and (m := _DOMAIN.match(text, at + 1)):
                    email_end = m.end()
                    email.append((start, email_end))
        elif kind == _PLUS:
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    phone.append((at, phone_end))
        elif kind == _SCHEME:
            start = at
            while start > max(url_end, at - 5) and text[start - 1].isascii() and text[start - 1].isalpha():
                start -= 1
            if text[start:at].lower() in _SCHEMES and (m := _REST.match(text, at + 3)):
                url_end = at + 3 + len(m.group().rstrip(".,;:!?)]}"))
                url.append((start, url_end))
        elif kind == _ACCOUNT:
            if at >= account_end:
                if own := iban_span(text, last + 1):
                    account.append(own)
                    account_end = own[1]
                elif m := _NUMBER.match(text, last + 1):
                    account.append(m.span(1))
                    account_end = m.end(1)
        elif at >= secret_end and (m := _ASSIGNED.match(text, last + 1)):
            secret.append(m.span(1))
            secret_end = m.end(1)
    return [(name, a, b) for name, own in zip(BASE_KINDS + MORE_KINDS, found, strict=True) for a, b in own]


def find_personal_data(docs: DataFrame, text: str = "text", to: str = "found") -> DataFrame:
    """``docs`` with the column ``to``: array of (kind, start, end)."""
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

    @F.pandas_udf(kind)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in spans(t)] for t in texts], dtype=object)

    return docs.withColumn(to, find(text_of(docs, text)))
