"""Bodies as text, by the charset that their type declares."""

from __future__ import annotations

import codecs
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(1000)
def _codec(name: str) -> str:
    try:
        c = codecs.lookup(name)
        return c.name if getattr(c, "_is_text_encoding", True) else "utf-8"
    except (LookupError, ValueError):
        return "utf-8"


@F.pandas_udf(T.StringType())
def _decoded(body: pd.Series, charset: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else b.decode(_codec(c), "replace") for b, c in zip(body, charset)], dtype=object)


def charset_of(content_type: Column) -> Column:
    """The charset that a type names, in lower case; utf-8 where it names none."""
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(content_type, r"(?i)charset\s*=\s*[\"']?([^\s;\"']+)", 1), F.lit("")), F.lit("utf-8")))


def body_text(body: Column, content_type: Column) -> Column:
    """The body in the charset that its type names, UTF-8 for none or an unknown one; bad bytes become U+FFFD. UTF-8 stays
    native, only the rest passes through Python."""
    c = charset_of(content_type)
    other = ~c.isin("utf-8", "utf8")
    return F.when(other, _decoded(F.when(other, body), c)).otherwise(F.make_valid_utf8(body.cast("string")))
