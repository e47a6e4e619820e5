"""Relational verbs as DataFrame functions with total orders, so results don't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltweir.operators.ordered import ranked


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Distinct on keys, keeping the first row by order. Partial aggregation before the shuffle, no window."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)) if rest else F.lit(None)
    return df.groupBy(*keys).agg(first.alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def hashed(key: Column, seed: int, modulus: int = 2147483647) -> Column:
    """An arithmetic hash that other engines can compute, too."""
    return F.pmod(key * F.lit(1103515245 + 2 * seed) + F.lit(12345 + seed), F.lit(modulus))


def sample_per_stratum(df: DataFrame, stratum: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each stratum without replacement: the n smallest hashes."""
    h = hashed(F.col(key), seed)
    return df.withColumn("__r", F.row_number().over(W.partitionBy(stratum).orderBy(h, key))).where(F.col("__r") <= n).drop("__r")


def split_per_stratum(df: DataFrame, stratum: str, key: str, share: float, seed: int = 0, out: str = "part") -> DataFrame:
    """Train and test parts with the share of each stratum in test."""
    w = W.partitionBy(stratum)
    r = F.row_number().over(w.orderBy(hashed(F.col(key), seed), key))
    return df.withColumn(out, F.when(r <= F.floor(F.count("*").over(w) * F.lit(share)), "test").otherwise("train"))


def chunks(df: DataFrame, order: list[str], n: int, out: str = "chunk") -> DataFrame:
    """n chunks of equal count; the first few get the extra rows. The order should end with a key."""
    x = ranked(df, order, "__r").crossJoin(F.broadcast(df.agg(F.count("*").alias("__n"))))  # one row
    q, rest, r = F.floor(F.col("__n") / n), F.col("__n") % n, F.col("__r") - 1
    early = rest * (q + 1)
    return x.withColumn(out, F.when(r < early, F.floor(r / (q + 1))).otherwise(rest + F.floor((r - early) / F.nullif(q, F.lit(0)))).cast("int") + 1).drop("__r", "__n")


def quantile_bins(df: DataFrame, by: str, key: str, q: int, out: str = "bin") -> DataFrame:
    """Bins of the rank: edges at even quantiles of 1..n, right-closed, the lowest included."""
    x = ranked(df, [by, key], "__r").crossJoin(F.broadcast(df.agg(F.count("*").alias("__n"))))  # one row
    n, r = F.col("__n"), F.col("__r")
    return x.withColumn(out, F.when(n == 1, 0).otherwise(F.greatest(F.ceil((r - 1) * q / F.nullif(n - 1, F.lit(0))) - 1, F.lit(0))).cast("int")).drop("__r", "__n")


def merge_by_key(prior: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Prior rows whose key is in the new rows are replaced."""
    return prior.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def days_between(a: Column, b: Column) -> Column:
    """Whole days from a to b; -1 where either is missing."""
    return F.coalesce(F.floor((F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / F.lit(86_400_000_000)), F.lit(-1)).cast("long")
