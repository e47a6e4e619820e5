"""The 36 lexical columns of an address, as native expressions but for entropy, which is counted in Arrow batches. One
narrow pass: no shuffle."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltweir.functions import tokens as K
from siltweir.functions.hosts import listed_suffix, url_part

FEATURES = (
    "url_length hostname_length path_length query_length fragment_length num_dots num_hyphens num_underscores num_slashes num_digits num_equal num_at num_ampersand num_percent num_question num_params num_subdomains entropy_url entropy_hostname digit_ratio letter_ratio special_ratio has_ip_literal has_https has_port is_shortener num_suspicious_tokens num_brand_tokens num_brand_tokens_fuzzy num_brand_tokens_extended num_suspicious_tokens_extended brand_in_subdomain tld_length tld_is_common longest_word_length avg_token_length"
).split()
#: The columns that were added after the first 33.
LATER = ("num_brand_tokens_fuzzy", "num_brand_tokens_extended", "num_suspicious_tokens_extended")
FIRST_33 = [f for f in FEATURES if f not in LATER]


def count_of(text: Column, c: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))


def count_class(text: Column, pattern: str) -> Column:
    """Number of characters in a class: the length less that of the text without them."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


@F.pandas_udf(T.DoubleType())
def _entropy(texts: pd.Series) -> pd.Series:
    """All characters of a batch are sorted at once, numbers of equal ones summed by text."""
    known = texts.dropna()
    points = np.frombuffer("".join(known).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = known.str.len().to_numpy(np.int64)
    key = (np.repeat(np.arange(len(known), dtype=np.int64), size) << 21) | points
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(key)))
    bits = np.bincount(key[first] >> 21, n * np.log2(n), minlength=len(known))
    whole = np.maximum(size, 1)
    return pd.Series(np.where(size > 0, np.maximum(np.log2(whole) - bits / whole, 0.0), 0.0), known.index).reindex(texts.index)


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for ''."""
    return _entropy(text)


def tokens_in(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words occur, each counted once."""
    out = F.lit(0)
    for w in words:
        out = out + F.contains(text, F.lit(w)).cast("int")
    return out


_PLAIN = str.maketrans(K.LOOKALIKE_FROM, K.LOOKALIKE_TO)
_LONG = 8  # brands of more letters may be two edits away


def _without(word: str, letters: int) -> set[str]:
    """The word and what is left of it without up to so many letters."""
    out = last = {word}
    for _ in range(letters):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


@lru_cache(1)
def _brand_forms() -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """Words within n edits of each other have a form in common among those without up to n letters: form -> brands for
    one edit, and for two of the long brands."""
    one: dict[str, list[str]] = {}
    two: dict[str, list[str]] = {}
    for b in K.BRANDS_EXTENDED:
        if b not in K.ACRONYMS:
            for f in _without(b, 1):
                one.setdefault(f, []).append(b)
            for f in _without(b, 2) if len(b) > _LONG else ():
                two.setdefault(f, []).append(b)
    return one, two


def _within(a: str, b: str, edits: int) -> bool:
    if abs(len(a) - len(b)) > edits:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= edits


def near_brands(label: str) -> tuple[str, ...]:
    """Brands that a lower-cased label nearly spells: within one edit (two of a long brand), or within one edit once
    look-alike sequences and characters have given way to what they look like."""
    if len(label) < 4:
        return ()
    plain = label
    for a, b in K.LOOKALIKE_SEQUENCES:
        plain = plain.replace(a, b)
    plain = plain.translate(_PLAIN)
    one, two = _brand_forms()
    longest = max(map(len, K.BRANDS_EXTENDED))
    maybe = {b for w in {label, plain} if len(w) <= longest + 1 for f in _without(w, 1) for b in one.get(f, ())}
    if _LONG < len(label) + 2 <= longest + 4:
        maybe |= {b for f in _without(label, 2) for b in two.get(f, ())}
    return tuple(b for b in maybe if b != label and (_within(label, b, 1 if len(b) <= _LONG else 2) or _within(plain, b, 1)))


#: Labels met before; they recur widely. Emptied when full.
_NEAR: dict[str, tuple[str, ...]] = {}


@F.pandas_udf(T.IntegerType())
def _fuzzy(labels: pd.Series, urls: pd.Series) -> pd.Series:
    out = []
    for ls, u in zip(labels, urls):
        n = 0
        for v in ls if ls is not None else ():
            near = _NEAR.get(v)
            if near is None:
                if len(_NEAR) >= 500_000:
                    _NEAR.clear()
                near = _NEAR[v] = near_brands(v.lower())
            n += bool(near) and any(b not in K.BRANDS or b not in u for b in near)
        out.append(n if ls is not None and u is not None else None)
    return pd.Series(out, dtype="Int32")


def fuzzy_brands(labels: Column, lowered_url: Column) -> Column:
    """How many labels are a near miss of a brand that the address doesn't spell out. Each label is looked up once by a
    worker, in Arrow batches."""
    return _fuzzy(labels, lowered_url)


def with_parts(df: DataFrame, url: str, suffixes: list[str]) -> DataFrame:
    """df with __scheme, __netloc, __path, __query, __fragment, __host, __suffix, __label, __sub of the address."""
    u = F.col(url)
    whole = F.when(F.contains(u, F.lit("//")), u).otherwise(F.concat(F.lit("//"), u))
    x = df.withColumns({f"__{n}": url_part(whole, i) for i, n in enumerate(("scheme", "netloc", "path", "query", "fragment"), 1)})
    after = F.regexp_replace(F.col("__netloc"), r"^.*@", "")
    x = x.withColumn("__port", F.regexp_extract(after, r":([^:\]]*)$", 1))
    host = F.lower(F.regexp_replace(F.regexp_replace(after, r":[^:\]]*$", ""), r"^\[|\]$", ""))
    x = x.withColumn("__host", host)
    x = x.withColumn("__suffix", F.when(F.col("__host").rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.lit("")).otherwise(listed_suffix(F.col("__host"), suffixes)))
    rest = F.when(F.col("__suffix") == "", F.col("__host")).otherwise(F.substr(F.col("__host"), F.lit(1), F.greatest(F.length("__host") - F.length("__suffix") - 1, F.lit(0))))
    x = x.withColumn("__rest", F.when(F.col("__host").rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.col("__host")).otherwise(rest))
    ip = F.col("__host").rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    x = x.withColumn("__label", F.when(ip, F.col("__host")).otherwise(F.regexp_extract("__rest", r"([^.]*)$", 1)))
    return x.withColumn("__sub", F.when(ip, F.lit("")).otherwise(F.regexp_extract("__rest", r"^(.*)\.[^.]*$", 1)))


def lexical(df: DataFrame, url: str, suffixes: list[str], fuzzy: bool = True) -> DataFrame:
    """df with the lexical columns of `url`. A NULL address gives NULL columns."""
    u, lower = F.col(url), F.col("__lower")
    host, sub = F.col("__host"), F.col("__sub")
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    digits = count_class(u, r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]")
    letters = count_class(u, r"[\p{L}]")
    words = F.filter(F.split(u, r"[/.\-_?=&]+"), lambda t: t != "")
    sizes = F.transform(words, lambda t: F.length(t))
    labels = F.filter(F.split(sub, r"\."), lambda s: s != "")
    base = F.concat(F.array(F.col("__label")), labels)
    parts = F.flatten(F.transform(base, lambda b: F.filter(F.split(b, "-"), lambda p: (p != "") & (p != b))))
    port = F.col("__port")
    cols: dict[str, Column] = {
        "url_length": F.length(u), "hostname_length": F.length(host), "path_length": F.length("__path"), "query_length": F.length("__query"), "fragment_length": F.length("__fragment"),
        "num_dots": count_of(u, "."), "num_hyphens": count_of(u, "-"), "num_underscores": count_of(u, "_"), "num_slashes": count_of(u, "/"), "num_digits": digits,
        "num_equal": count_of(u, "="), "num_at": count_of(u, "@"), "num_ampersand": count_of(u, "&"), "num_percent": count_of(u, "%"), "num_question": count_of(u, "?"),
        "num_params": F.size(F.filter(F.split("__query", "&"), lambda p: p != "")), "num_subdomains": F.size(labels),
        "entropy_url": entropy(u), "entropy_hostname": entropy(host),
        "digit_ratio": digits / n, "letter_ratio": letters / n, "special_ratio": (n - digits - letters) / n,
        "has_ip_literal": host.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$").cast("int"), "has_https": (F.lower("__scheme") == "https").cast("int"), "has_port": (port != "").cast("int"),
        "is_shortener": F.concat_ws(".", "__label", "__suffix").isin(*K.SHORTENERS).cast("int"),
        "num_suspicious_tokens": tokens_in(lower, K.SUSPICIOUS), "num_brand_tokens": tokens_in(lower, K.BRANDS),
        "num_brand_tokens_extended": F.size(F.filter(F.col("__labels"), lambda x: F.lower(x).isin(*K.BRANDS_EXTENDED))),
        "num_suspicious_tokens_extended": tokens_in(lower, K.SUSPICIOUS_EXTENDED),
        "brand_in_subdomain": (tokens_in(F.lower(sub), K.BRANDS) > 0).cast("int"),
        "tld_length": F.length("__suffix"), "tld_is_common": F.col("__suffix").isin(*K.COMMON_TLDS).cast("int"),
        "longest_word_length": F.coalesce(F.array_max(sizes), F.lit(0)),
        "avg_token_length": F.when(F.size(words) > 0, F.aggregate(sizes, F.lit(0), lambda a, k: a + k) / F.size(words)).otherwise(0.0),
    }
    if fuzzy:
        cols["num_brand_tokens_fuzzy"] = fuzzy_brands(F.col("__labels"), lower)
    # shared parts are columns of a projection of their own, so that each is computed once a row; conditions around the
    # columns would keep them from being shared, so only those that don't pass a NULL on are wrapped
    x = with_parts(df, url, suffixes).withColumns({"__labels": F.concat(base, parts), "__lower": F.lower(u)})
    keep = df.columns
    order = [f for f in FEATURES if f in cols]
    for f in ("longest_word_length", "avg_token_length", "entropy_url", "entropy_hostname", "is_shortener"):
        cols[f] = F.when(u.isNotNull(), cols[f])
    return x.select(*[F.col(c) for c in keep if c not in order], *[cols[f].alias(f) for f in order])


def squatting(df: DataFrame) -> DataFrame:
    """df with squat: brand evidence weighted by bait words and context. Missing columns count as 0."""
    c = lambda n: F.coalesce(F.col(n), F.lit(0)).cast("double") if n in df.columns else F.lit(0.0)
    hit = lambda n: (c(n) > 0).cast("double")
    brand = F.greatest(1.0 * c("brand_in_subdomain"), 1.0 * hit("num_brand_tokens_fuzzy"), 0.7 * hit("num_brand_tokens"), 0.65 * hit("num_brand_tokens_extended"))
    bait = F.least(F.lit(1.0), 0.35 * c("num_suspicious_tokens") + 0.25 * c("num_suspicious_tokens_extended"))
    ctx = F.least(F.lit(1.0), 0.30 * c("is_shortener") + 0.12 * F.least(c("num_hyphens"), F.lit(4.0)))
    return df.withColumn("squat", brand * (0.35 + 0.35 * bait + 0.30 * ctx))
