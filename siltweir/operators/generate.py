"""Data of known make, drawn from hashes of a key, so runs and engines agree: address variants, paths, a small corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltweir.operators.relational import hashed

BAIT = ("login", "secure", "verify", "account")
ENDINGS = ("net", "org", "info", "online")
SEGMENTS = ("news", "about", "help", "items", "docs", "blog", "team", "photos")


def _pick(options: tuple[str, ...], h: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (h % len(options) + 1).cast("int"))


def typo_variants(df: DataFrame, key: str, domain: str) -> DataFrame:
    """(key, kind, variant): every domain with letters of its first label swapped for look-alikes, left out, doubled and
    transposed, with another ending and with a bait word. The place is drawn from the key."""
    name, rest = F.substring_index(F.col(domain), ".", 1), F.regexp_extract(F.col(domain), r"^[^.]*(\..*)?$", 1)
    n = F.length(name)
    at = (hashed(F.col(key), 1) % F.greatest(n - 1, F.lit(1)) + 1).cast("int")
    cut = lambda a, b: F.substr(name, a, b)
    one, two = F.lit(1), F.lit(1 << 20)
    forms = {
        "swap": F.translate(name, "oile", "0113"), "omit": F.concat(cut(one, at - 1), cut(at + 1, two)), "double": F.concat(cut(one, at), cut(at, two)),
        "transpose": F.concat(cut(one, at - 1), cut(at + 1, one), cut(at, one), cut(at + 2, two)), "ending": name, "bait": F.concat(name, F.lit("-"), _pick(BAIT, hashed(F.col(key), 2))),
    }
    tail = lambda k: F.concat(F.lit("."), _pick(ENDINGS, hashed(F.col(key), 3))) if k == "ending" else rest
    x = df.where((n > 1) & F.col(domain).isNotNull()).select(key, domain, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.concat(v, tail(k)).alias("variant")) for k, v in forms.items()])).alias("v"))
    return x.select(key, domain, "v.kind", "v.variant").where(F.col("variant") != F.col(domain)).drop(domain)


def with_paths(df: DataFrame, key: str, url: str, share: float = 0.65, http_share: float = 0.15, out: str = "augmented") -> DataFrame:
    """df with an address to which, for a share of the rows, a path of one to three segments is added and, for another
    share, plain http is given."""
    h = lambda s: hashed(F.col(key), s)
    path = F.concat(*[F.when(h(12) % 3 >= i, F.concat(F.lit("/"), _pick(SEGMENTS, h(20 + i)))).otherwise(F.lit("")) for i in range(3)])
    longer = F.when(h(10) % 1000 < int(share * 1000), F.concat(F.regexp_replace(F.col(url), r"/+$", ""), path)).otherwise(F.col(url))
    return df.withColumn(out, F.when(h(11) % 1000 < int(http_share * 1000), F.regexp_replace(longer, "^https:", "http:")).otherwise(longer))


def smoke_corpus(spark: SparkSession, n: int = 1500) -> DataFrame:
    """row_id, url, label, source, timestamp, domain_age_days, rank: wiring only; harmful rows are younger, unranked and hold
    a bait word."""
    i = F.col("id")
    h = lambda s: hashed(i, s)
    bad = h(1) % 2
    name = F.concat(F.lit("site"), (h(2) % 997).cast("string"))
    url = F.when(bad == 1, F.concat(F.lit("http://"), name, F.lit("-"), _pick(BAIT, h(3)), F.lit(".test/"), (h(4) % 9999).cast("string"))).otherwise(F.concat(F.lit("https://"), name, F.lit(".example")))
    age = F.when(bad == 1, h(5) % 90).otherwise(400 + h(5) % 4000)
    stamp = F.timestamp_seconds(F.lit(1_704_067_200) + h(6) % (365 * 86400)).cast("timestamp_ntz")
    rank = F.when((bad == 0) & (h(7) % 4 > 0), (h(7) % 100_000).cast("double"))
    return spark.range(n).select(i.alias("row_id"), url.alias("url"), bad.cast("int").alias("label"), _pick(("A", "B", "C"), h(8)).alias("source"), stamp.alias("timestamp"), age.cast("double").alias("domain_age_days"), rank.alias("rank"))
