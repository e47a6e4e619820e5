"""Weighted findings in long form and their score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = -1.4


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.ln(q / (1 - q))


def severity(weight: Column) -> Column:
    return F.when(weight <= -0.01, "good").when(weight >= 3, "critical").when(weight >= 1.5, "high").when(weight >= 0.6, "medium").when(weight >= 0.01, "low").otherwise("info")


def age_weight(days: Column) -> Column:
    """A range lookup: young names weigh for, old ones against."""
    return F.when(days <= 7, 3.0).when(days <= 30, 2.0).when(days <= 90, 1.2).when(days <= 365, 0.4).when(days >= 3650, -1.5).when(days >= 1825, -1.0).when(days >= 730, -0.5).otherwise(0.0)


def combine(findings: DataFrame, key: str, weight: str, confirmed: str | None = None) -> DataFrame:
    """key, risk (1..99), verdict, n. risk = round half even of 100 times the logistic of BASE + sum of weights;
    confirmed findings lift it to 97 at least."""
    c = F.bool_or(F.coalesce(F.col(confirmed), F.lit(False))) if confirmed else F.lit(False)
    x = findings.groupBy(key).agg(F.sum(weight).alias("w"), F.max(F.lit(0)).alias("z"), c.alias("sure") if confirmed else F.first(F.lit(False)).alias("sure"), F.count("*").alias("n"), F.max(F.abs(F.col(weight))).alias("top"))
    risk = F.bround(100 / (1 + F.exp(-(F.lit(BASE) + F.round("w", 10)))), 0).cast("int")
    risk = F.least(F.greatest(F.when(F.col("sure"), F.greatest(risk, F.lit(97))).otherwise(risk), F.lit(1)), F.lit(99))
    x = x.withColumn("risk", risk)
    evidence = F.when(F.col("sure") | (F.col("n") >= 3), "strong").when(F.col("n") >= 1, "moderate").otherwise("limited")
    return x.select(key, "risk", F.when(F.col("risk") >= 70, "phishing").when(F.col("risk") >= 40, "suspicious").otherwise("safe").alias("verdict"), "n", evidence.alias("evidence"))


#: Order of severities in a report.
RANKS = ("critical", "high", "medium", "low", "info", "good")


def ordered(findings: DataFrame, key: str, weight: str, place: str, out: str = "position") -> DataFrame:
    """findings with their place in the report of each key: by severity, then by size of the weight, then as they came."""
    from pyspark.sql import Window as W

    rank = F.array_position(F.array(*[F.lit(r) for r in RANKS]), severity(F.col(weight)))
    return findings.withColumn(out, F.row_number().over(W.partitionBy(key).orderBy(rank, F.desc(F.abs(F.col(weight))), place)))
