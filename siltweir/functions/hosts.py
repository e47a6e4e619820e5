"""Hosts and registrable domains as Column expressions."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import unquote, unquote_to_bytes

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: RFC 3986, appendix B, with a scheme that starts with a letter.
URL_RE = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

#: Values of a domain column that name nothing.
PLACEHOLDERS = ("", "-", "--", "n/a", "na", "none", "null", "nil", "unknown", "undefined", "localhost", "nan", "?", ".")

#: A public suffix table is a dimension; beyond this many rows it isn't one and is refused.
MAX_SUFFIXES = 50_000


def url_part(url: Column, group: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, 5 fragment; '' where absent."""
    return F.regexp_extract(url, URL_RE, group)


def url_host(url: Column) -> Column:
    """Host without user info and port; brackets of IPv6 stripped. NULL for NULL."""
    auth = F.regexp_replace(url_part(F.trim(url), 2), r"^.*@", "")
    return F.regexp_replace(F.regexp_replace(auth, r":[^:\]]*$", ""), r"^\[|\]$", "")


def _utf8(h: str) -> bool:
    try:
        return bool(unquote_to_bytes(h).decode("utf-8"))
    except UnicodeDecodeError:
        return False


@F.pandas_udf(T.StringType())
def _decoded(s: pd.Series) -> pd.Series:
    def label(x: str) -> str:
        if x[:4] == "xn--":
            try:
                return x[4:].encode("ascii").decode("punycode")
            except (UnicodeError, ValueError):
                pass
        return x

    def one(h):
        if h is None:
            return None
        h = unquote(h, errors="strict") if "%" in h and _utf8(h) else h
        h = re.sub("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]", "", unicodedata.normalize("NFKC", h)).replace("。", ".").lower()
        return unicodedata.normalize("NFC", ".".join(label(x) for x in h.split(".")))

    return s.map(one)


def spelled(host: Column) -> Column:
    """One spelling of a host: no blanks or dots at the ends, lower case, percent and punycode decoded. Only hosts
    with other than plain characters pass through Python; the rest reach it as NULL."""
    odd = host.rlike(r"(?i)xn--|%|[^ -~]")
    h = F.coalesce(_decoded(F.when(odd, host)), F.lower(host))
    return F.regexp_replace(h, r"^[.\s]+|[.\s]+$", "")


def suffix_list(suffixes: DataFrame, sections: tuple[str, ...] = ("icann", "private")) -> list[str]:
    """The listed suffixes of the sections, lower-cased. A dimension: refused beyond MAX_SUFFIXES rows."""
    rows = suffixes.where(F.col("section").isin(*sections)).select(F.lower("suffix").alias("s")).distinct().limit(MAX_SUFFIXES + 1).collect()
    if len(rows) > MAX_SUFFIXES:
        raise ValueError(f"more than {MAX_SUFFIXES} public suffixes")
    return sorted(r.s for r in rows if r.s)


def listed_suffix(host: Column, suffixes: list[str]) -> Column:
    """The longest listed suffix that the host ends in or is; '' where there is none. One lookup for each number of
    labels, however long the list."""
    by_labels: dict[int, list[str]] = {}
    for s in suffixes:
        by_labels.setdefault(s.count(".") + 1, []).append(s)
    tails = [F.substring_index(host, ".", -n) for n in sorted(by_labels, reverse=True)]
    return F.coalesce(*[F.when(t.isin(*by_labels[n]), t) for n, t in zip(sorted(by_labels, reverse=True), tails)], F.when(host.isNotNull(), F.lit("")))


def registrable(host: Column, suffixes: list[str]) -> Column:
    """Registrable domain of a spelled host: longest listed suffix plus one label. NULL for addresses, hosts that are
    a suffix, single labels and hosts with blanks. Under no listed suffix the last label counts as one."""

    def known(v: Column) -> Column:
        h, s = v["h"], v["s"]
        dots = F.length(s) - F.length(F.replace(s, F.lit("."), F.lit("")))
        unfit = h.rlike(r"\s|\.\.|:|^\.|\.$|^\d{1,3}(\.\d{1,3}){3}$") | (h == s) | ~F.contains(h, F.lit("."))
        return F.when(~unfit, F.call_function("substring_index", h, F.lit("."), -(F.when(s == "", 0).otherwise(dots) + 2)))

    # host and suffix are bound to names, so that each is computed once and not wherever it is read
    bound = F.transform(F.array(host), lambda h: F.struct(h.alias("h"), listed_suffix(h, suffixes).alias("s")))
    return F.get(F.transform(bound, known), F.lit(0))


def with_entity(df: DataFrame, domain: str, url: str, out: str, suffixes: list[str]) -> DataFrame:
    """df with the registrable domain that `domain` names, or that `url` names where `domain` names none."""
    x = df.withColumn("__d", spelled(F.col(domain)))
    x = x.withColumn("__e", F.when(~F.col("__d").isin(*PLACEHOLDERS), registrable(F.col("__d"), suffixes)))
    x = x.withColumn("__u", spelled(F.when(F.col("__e").isNull(), url_host(F.col(url)))))
    return x.withColumn(out, F.coalesce("__e", registrable(F.col("__u"), suffixes))).drop("__d", "__e", "__u")
