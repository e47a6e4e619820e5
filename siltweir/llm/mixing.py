"""Problem 8: mixing sources to target weights.

Each listed source gets target_share of the total size (bytes of UTF-8 of all documents of listed sources), at most
max_repeats times its own size. A document is expected in c = target / size copies: floor(c) of them are certain, the
rest is drawn by Pareto order sampling (Rosen 1997) with unequal inclusion probabilities, in proportion to a weight (the
size, unless another column is named) and summing up to the size that is left: documents are ranked by random odds over
inclusion odds and taken in that order until the source's remaining size is met as nearly as whole documents allow.

Nulls: a NULL text has size 0; documents whose source is NULL or not listed take no part; a target row with a NULL
share counts as 0, with NULL max_repeats as 1. A source listed but without documents is reported with size 0. Ties of
rank are broken by doc_id. Repeated target rows of a source are summed and the largest max_repeats holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltweir.session import staged, table

#: Rank buckets of a source; only documents of the bucket in which the cut falls are ordered exactly.
RANK_BUCKETS = 4096


def byte_size(text: Column) -> Column:
    """Tokens of the byte-level tokenizer: UTF-8 bytes; 0 for NULL."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) drawn from the key."""
    return (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def allocation(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, size, total, target, granted, copies, rest, short for each listed source."""
    t = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    sizes = docs.groupBy("source").agg(F.sum(byte_size(F.col("text"))).alias("size"))
    x = t.join(sizes, "source", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    x = x.withColumn("total", F.sum("size").over(W.partitionBy()))  # one row a listed source
    x = x.withColumn("target", F.col("target_share") * F.col("total")).withColumn("room", F.col("max_repeats") * F.col("size"))
    x = x.withColumn("short", F.col("room") < F.col("target")).withColumn("granted", F.least(F.col("room").cast("double"), F.col("target")))
    copies = F.when(F.col("size") > 0, F.floor(F.col("granted") / F.col("size"))).otherwise(0).cast("long")
    return x.withColumn("copies", copies).withColumn("rest", F.col("granted") - F.col("copies") * F.col("size")).drop("room")


def inclusion(d: DataFrame) -> DataFrame:
    """d (source, size, rest, w) with p: inclusion probabilities in proportion to w whose expected size is `rest` for each
    source. Documents that would exceed 1 are taken for certain and the others share what is left, until none
    exceeds it. The driver holds a factor for each source of the target table."""
    c = {r["source"]: 0.0 for r in d.select("source").distinct().collect()}
    while c:
        per = F.create_map(*[F.lit(x) for kv in c.items() for x in kv])
        over = F.col("w") * F.coalesce(F.try_element_at(per, F.col("source")), F.lit(0.0)) >= 1
        sums = d.groupBy("source").agg(F.first("rest").alias("rest"), F.sum(F.when(over, F.col("size")).otherwise(0)).alias("sure"), F.sum(F.when(over, 0.0).otherwise(F.col("w") * F.col("size"))).alias("open")).collect()
        new = {r["source"]: max(c[r["source"]], (max(r["rest"] - r["sure"], 0.0) / r["open"]) if r["open"] else c[r["source"]]) for r in sums}
        if all(abs(new[k] - c[k]) <= 1e-12 * max(new[k], 1e-300) for k in c):
            break
        c = new
    if not c:
        return d.withColumn("p", F.lit(0.0))
    per = F.create_map(*[F.lit(x) for kv in c.items() for x in kv])
    return d.withColumn("p", F.least(F.col("w") * F.coalesce(F.try_element_at(per, F.col("source")), F.lit(0.0)), F.lit(1.0)))


def mix(docs: DataFrame, targets: DataFrame, seed: int = 7, weight: str | None = "size") -> DataFrame:
    """doc_id, source, size, inclusion, copies: how often each document is used (0: not at all). `inclusion` is the
    probability of a copy beyond the whole ones.

    Inclusion is in proportion to `weight`: the size (longer documents are likelier), another column, or None for
    documents of a source that are all alike. A NULL or negative weight counts as 0."""
    plan = allocation(docs, targets)
    # sources in the target table are few (it is a table of settings)
    plan = plan.select("source", F.col("size").alias("source_size"), F.col("copies").alias("whole"), "rest")
    w = byte_size(F.col("text")).cast("double") if weight == "size" else F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight else F.lit(1.0)
    d = staged(docs.select("doc_id", "source", byte_size(F.col("text")).alias("size"), w.alias("w")).join(plan, "source"), "weighed")
    d = inclusion(d)
    p = F.least(F.greatest(F.col("p"), F.lit(1e-12)), F.lit(1 - 1e-12))
    u = uniform(F.col("doc_id"), seed)
    odds = (u / (1 - u)) / (p / (1 - p))
    d = d.withColumn("rank", F.when(F.col("source_size") > 0, odds).otherwise(odds * 0)).withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * RANK_BUCKETS).cast("int"))
    d = staged(d.select("doc_id", "source", "size", "p", "whole", "rest", "rank", "bucket"), "ranked")
    before = F.sum("bytes").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    per = d.groupBy("source", "bucket").agg(F.sum("size").alias("bytes")).withColumn("before", F.coalesce(before, F.lit(0)))
    x = d.join(per, ["source", "bucket"])
    # whole buckets below the cut are taken, those above are not; the one with the cut is ordered exactly
    inside = x.where(F.col("before") + F.col("bytes") <= F.col("rest")).withColumn("drawn", F.lit(1))
    outside = x.where(F.col("before") > F.col("rest")).withColumn("drawn", F.lit(0))
    cut = x.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("bytes") > F.col("rest")))
    upto = F.sum("size").over(W.partitionBy("source", "bucket").orderBy("rank", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    cut = cut.withColumn("upto", F.col("before") + upto).withColumn("drawn", (F.col("upto") - F.col("size") / 2 <= F.col("rest")).cast("int")).drop("upto")
    out = inside.unionByName(outside).unionByName(cut)
    return out.select("doc_id", "source", "size", F.col("p").alias("inclusion"), (F.col("whole") + F.col("drawn")).alias("copies"))


def shares(docs: DataFrame, targets: DataFrame, **how) -> DataFrame:
    """Target and reached share of each listed source, with its size, use and whether it falls short."""
    m = mix(docs, targets, **how).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("used"), F.max("copies").alias("most_copies"), F.count_if(F.col("copies") > 0).alias("documents"))
    x = allocation(docs, targets).join(m, "source", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return x.select("source", "target_share", (F.col("used") / F.nullif(F.sum("used").over(W.partitionBy()), F.lit(0))).alias("reached_share"), (F.col("used") / F.col("total")).alias("share_of_total"), "size", "used", F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce("documents", F.lit(0)).alias("documents"), "short")


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that can't reach their share: those that the mix leaves short though it takes all it may of them."""
    return shares(*_tables(spark, sf_dir)).where("short").select("source").distinct()


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(*_tables(spark, sf_dir)).where("copies > 0")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(*_tables(spark, sf_dir))


QUERIES = {"p8_found": p8_found, "p8_mix": p8_mix, "p8_shares": p8_shares}

SQL = {
    "p8_found": """
WITH t AS (SELECT source, sum(coalesce(target_share, 0)) AS share, max(coalesce(max_repeats, 1)) AS reps FROM mix_targets WHERE source IS NOT NULL GROUP BY source),
s AS (SELECT source, sum(octet_length(encode(text))) AS size FROM documents GROUP BY source),
x AS (SELECT t.source, share, reps, coalesce(size, 0) AS size FROM t LEFT JOIN s ON t.source = s.source)
SELECT source FROM x WHERE reps * size < share * (SELECT sum(size) FROM x)
""",
}
