"""Input repair and string transforms of addresses. Choices are drawn from a hash of the key, so runs agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltweir.functions import tokens as K
from siltweir.functions.hosts import url_part

OPAQUE = r"(?i)^(mailto|javascript|data|tel|file|about|chrome|ftp):"


def repair(df: DataFrame, raw: str, out: str = "repaired", error: str = "error") -> DataFrame:
    """df with the address that was meant, or NULL and an error code: empty, opaque, scheme, no_host, incomplete.
    Only repairs that can't change the server: junk around it, defanging, a missing scheme, case of scheme and host, a
    bare root slash."""
    s = F.trim(F.regexp_replace(F.coalesce(F.col(raw), F.lit("")), "[​‌‍⁠﻿]", ""))
    s = F.trim(F.regexp_replace(F.regexp_replace(s, "^\\s+|\\s+$", ""), "^[<>“”\"']+|[<>“”\"']+$", ""))
    s = F.regexp_replace(s, r"(?i)^hxxp(s?)(?:\[:\]|:)//", "http$1://")
    s = F.regexp_replace(F.regexp_replace(s, r"\[\.\]|\(\.\)|\{\.\}", "."), r"\[:\]", ":")
    x = df.withColumn("__s", s)
    full = F.when(F.col("__s").rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"), F.col("__s")).otherwise(F.concat(F.lit("https://"), F.regexp_replace("__s", "^/+", "")))
    x = x.withColumn("__f", full)
    part = {n: url_part(F.col("__f"), i) for i, n in enumerate(("scheme", "netloc", "path", "query", "fragment"), 1)}
    x = x.withColumns({f"__{n}": c for n, c in part.items()})
    hp = F.regexp_replace("__netloc", r"^.*@", "")
    host = F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(hp, r":[^:\]]*$", ""), r"^\[|\]$", "")), r"\.+$", "")
    x = x.withColumns({"__hp": F.regexp_replace(F.lower(hp), r"\.+$", ""), "__host": host, "__user": F.regexp_extract("__netloc", r"^(.*@)", 1)})
    err = (
        F.when(F.col("__s") == "", "empty").when(F.col("__s").rlike(OPAQUE), "opaque").when(~F.lower("__scheme").isin("http", "https"), "scheme")
        .when(F.col("__netloc") == "", "no_host").when((F.col("__host") == "") | F.col("__host").contains(" ") | F.col("__host").contains("%20"), "no_host")
        .when(~F.col("__host").contains(".") & (F.col("__host") != "localhost"), "incomplete")
    )
    path = F.when((F.col("__path") == "/") & (F.col("__query") == "") & (F.col("__fragment") == ""), "").otherwise(F.col("__path"))
    whole = F.concat(F.lower("__scheme"), F.lit("://"), "__user", "__hp", path, F.when(F.col("__query") != "", F.concat(F.lit("?"), "__query")).otherwise(""), F.when(F.col("__fragment") != "", F.concat(F.lit("#"), "__fragment")).otherwise(""))
    x = x.withColumn(error, err).withColumn(out, F.when(err.isNull(), whole))
    return x.drop(*[c for c in x.columns if c.startswith("__")])


def plain_letters(text: Column) -> Column:
    """Letters that look like an ASCII one give way to it; other characters stay."""
    return F.translate(text, K.CONFUSABLE_FROM, K.CONFUSABLE_TO)


def feed_key(url: Column) -> Column:
    return F.lower(F.rtrim(F.trim(url), F.lit("/")))


def _pick(options: tuple[str, ...], key: Column, salt: int) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(F.xxhash64(F.lit(salt), key), F.lit(len(options))) + 1).cast("int"))


def _rebuilt(url: Column, netloc: Callable[[Column], Column] | None = None, path: Callable[[Column], Column] | None = None) -> Column:
    whole = F.when(F.contains(url, F.lit("//")), url).otherwise(F.concat(F.lit("//"), url))
    p = {n: url_part(whole, i) for i, n in enumerate(("scheme", "netloc", "path", "query", "fragment"), 1)}
    scheme = F.when(p["scheme"] == "", "http").otherwise(F.lower(p["scheme"]))
    new_path = path(p["path"]) if path else p["path"]
    new_path = F.when((new_path != "") & ~new_path.startswith("/"), F.concat(F.lit("/"), new_path)).otherwise(new_path)
    return F.concat(scheme, F.lit("://"), netloc(p["netloc"]) if netloc else p["netloc"], new_path, F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(""), F.when(p["fragment"] != "", F.concat(F.lit("#"), p["fragment"])).otherwise(""))


def homoglyph(url: Column, key: Column, rate: float = 0.3) -> Column:
    chars = F.filter(F.split(url, ""), lambda c: c != "")
    drawn = F.transform(chars, lambda c, i: F.when((F.pmod(F.xxhash64(F.lit(11), key, i), F.lit(1000)) < int(rate * 1000)) & F.contains(F.lit(K.HOMOGLYPH_FROM + K.HOMOGLYPH_FROM.upper()), c), F.translate(c, K.HOMOGLYPH_FROM + K.HOMOGLYPH_FROM.upper(), K.HOMOGLYPH_TO + K.HOMOGLYPH_TO.upper())).otherwise(c))
    return F.array_join(drawn, "")


def percent_encoding(url: Column, key: Column, rate: float = 0.5) -> Column:
    head = F.regexp_extract(url, r"^((?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?)", 1)
    tail = F.regexp_extract(F.substr(url, F.length(head) + 1), r"^([^#]*)", 1)
    frag = F.substr(url, F.length(head) + F.length(tail) + 1)
    chars = F.filter(F.split(tail, ""), lambda c: c != "")
    coded = F.transform(chars, lambda c, i: F.when((F.pmod(F.xxhash64(F.lit(12), key, i), F.lit(1000)) < int(rate * 1000)) & c.rlike("^[A-Za-z0-9]$"), F.concat(F.lit("%"), F.hex(F.ascii(c)))).otherwise(c))
    return F.concat(head, F.array_join(coded, ""), frag)


def subdomain_padding(url: Column, key: Column, n: int = 3) -> Column:
    pad = F.concat_ws(".", *[_pick(K.EVASION_LABELS, key, 20 + i) for i in range(n)])
    return _rebuilt(url, netloc=lambda h: F.concat(pad, F.lit("."), h))


def path_padding(url: Column, key: Column, length: int = 40) -> Column:
    pad = F.substr(F.lower(F.concat(F.md5(F.concat(F.lit("p"), key.cast("string"))), F.md5(F.concat(F.lit("q"), key.cast("string"))))), F.lit(1), F.lit(length))
    return _rebuilt(url, path=lambda p: F.concat(F.regexp_replace(p, "/+$", ""), F.lit("/"), pad))


def shortener_wrap(url: Column, key: Column) -> Column:
    return F.when(url.isNotNull(), F.concat(F.lit("https://"), _pick(K.EVASION_SHORTENERS, key, 30), F.lit("/"), F.substr(F.md5(F.concat(F.lit("s"), key.cast("string"))), F.lit(1), F.lit(7))))


def tld_swap(url: Column, key: Column) -> Column:
    """com, org and net only; other addresses stay."""
    whole = F.when(F.contains(url, F.lit("//")), url).otherwise(F.concat(F.lit("//"), url))
    tld = F.lower(F.regexp_extract(url_part(whole, 2), r"\.([a-zA-Z]{2,})$", 1))
    out = url
    for t, options in K.EVASION_TLDS.items():
        out = F.when(tld == t, _rebuilt(url, netloc=lambda h, o=options: F.concat(F.regexp_replace(h, r"\.[a-zA-Z]{2,}$", "."), _pick(o, key, 40)))).otherwise(out)
    return out


def hyphenated_brand_insertion(url: Column, key: Column) -> Column:
    return _rebuilt(url, netloc=lambda h: F.concat(_pick(K.EVASION_BRANDS, key, 50), F.lit("-secure-"), h))


TRANSFORMS: dict[str, Callable[[Column, Column], Column]] = {f.__name__: f for f in (homoglyph, subdomain_padding, path_padding, percent_encoding, shortener_wrap, tld_swap, hyphenated_brand_insertion)}


def transform(url: Column, key: Column, name: str) -> Column:
    if name not in TRANSFORMS:
        raise ValueError(f"unknown transform {name!r}; known: {', '.join(TRANSFORMS)}")
    return TRANSFORMS[name](url, key)
