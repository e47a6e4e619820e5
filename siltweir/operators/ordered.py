"""Total orders without a task that holds them: rows are range-partitioned, summed within their partition, and shifted
by the sums of the partitions before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltweir.session import staged


def prefix_sums(df: DataFrame, order: list[str], sums: dict[str, Column], by: list[str] = [], parts: int | None = None) -> DataFrame:  # noqa: B006
    """df with, for each name of `sums`, the sum of its expression over the rows of the group that come before this one
    in the order. Rows that are equal in `order` come in any order; end it with a key. NULLs come first."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = df.withColumns({f"__v_{k}": c for k, c in sums.items()})
    x = staged(x.repartitionByRange(n, *by, *order).withColumn("__part", F.spark_partition_id()), "ordered")
    total = x.groupBy("__part", *by).agg(*[F.sum(f"__v_{k}").alias(f"__s_{k}") for k in sums])
    # one row a partition and group; a group has at most as many rows as there are partitions
    before = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    shift = total.select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__g_{c}") for c in by], *[F.coalesce(F.sum(f"__s_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in sums])
    own = W.partitionBy("__part", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumns({f"__o_{k}": F.coalesce(F.sum(f"__v_{k}").over(own), F.lit(0)) for k in sums})
    same = F.col("__part") == F.col("__p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    return x.join(shift, same).select(*df.columns, *[(F.col(f"__o_{k}") + F.col(f"__b_{k}")).alias(k) for k in sums])


def ranked(df: DataFrame, order: list[str], out: str = "rank", by: list[str] = []) -> DataFrame:  # noqa: B006
    """df with the place of each row in the order, from 1."""
    return prefix_sums(df, order, {out: F.lit(1)}, by).withColumn(out, F.col(out) + 1)


def percentiles(df: DataFrame, value: str, shares: list[float], by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, percentiles): exact percentiles with linear interpolation, an array in the order of the shares. Values are
    counted first; of each group only the values at the places in question are gathered."""
    x = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c"))
    n = x.groupBy(*by).agg(F.sum("__c").alias("__n")) if by else x.agg(F.sum("__c").alias("__n"))
    at = [(F.col("__n") - 1).cast("double") * q for q in shares]
    n = n.withColumn("__at", F.array(*at))
    places = F.array_distinct(F.flatten(F.transform("__at", lambda p: F.array(F.floor(p), F.ceil(p)))))
    n = n.withColumn("__need", places)
    below = prefix_sums(x, ["__v"], {"__b": F.col("__c")}, by)
    y = below.join(n, by) if by else below.crossJoin(F.broadcast(n))  # one row
    hit = F.filter("__need", lambda p: (p >= F.col("__b")) & (p < F.col("__b") + F.col("__c")))
    found = y.select(*by, F.explode(hit).alias("__p"), "__v").groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("__p", "__v"))).alias("__m")) if by else y.select(F.explode(hit).alias("__p"), "__v").agg(F.map_from_entries(F.collect_list(F.struct("__p", "__v"))).alias("__m"))
    z = found.join(n, by) if by else found.crossJoin(F.broadcast(n))
    of = lambda p: F.try_element_at("__m", p)
    each = F.transform("__at", lambda p: F.when(of(F.floor(p)) == of(F.ceil(p)), of(F.floor(p))).otherwise((F.ceil(p) - p) * of(F.floor(p)) + (p - F.floor(p)) * of(F.ceil(p))))
    return z.select(*by, each.alias("percentiles"))


__all__ = ["percentiles", "prefix_sums", "ranked"]
