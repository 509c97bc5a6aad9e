"""Host and path of a url, as the filters define them.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased.  Path: from there up to ``?``, ``#`` or the end.  Both are empty
for a null url or one without ``://``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import ascii_lower

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), _URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), _URL, 2)
