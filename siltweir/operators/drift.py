"""Population stability, feature stability scores, adaptive windowing and the adaptive loop."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltweir.operators.ordered import percentiles
from siltweir.operators.relational import chunks


def _edges(df: DataFrame, feature: str, by: list[str], bins: int) -> DataFrame:
    """Distinct exact quantile edges of the expected sample of each group."""
    p = percentiles(df, feature, [i / bins for i in range(bins + 1)], by)
    return p.select(*by, F.array_sort(F.array_distinct("percentiles")).alias("edges"))


def _bin(value: Column, edges: Column) -> Column:
    """Index of the bin; the outer edges are open to infinity."""
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.size(F.filter(inner, lambda e: e <= value))


def psi_pairs(df: DataFrame, feature: str, group: str, pairs: DataFrame, bins: int = 10) -> DataFrame:
    """pairs (expected, actual) of group values with the PSI of the feature: edges from the expected group, 1e-6 added to
    each share; 0 where the expected group has fewer than three distinct edges."""
    x = df.where(F.col(feature).isNotNull()).select(F.col(group).alias("g"), F.col(feature).cast("double").alias("v"))
    edges = _edges(x, "v", ["g"], bins)
    p = pairs.join(edges.withColumnRenamed("g", "expected"), "expected")
    v = x.groupBy("g", "v").agg(F.count("*").alias("m"))
    n = v.groupBy("g").agg(F.sum("m").alias("n"))

    def shares(side: str) -> DataFrame:
        # values are counted first, then meet the pairs that their group takes part in
        y = v.join(p, F.col("g") == F.col(side)).groupBy("expected", "actual", _bin(F.col("v"), F.col("edges")).alias("bin")).agg(F.sum("m").alias("c"))
        return y.join(n, F.col(side) == F.col("g")).select("expected", "actual", "bin", (F.col("c") / F.col("n")).alias(f"s_{side}"))

    full = p.select("expected", "actual", F.size("edges").alias("k"), F.explode(F.sequence(F.lit(0), F.greatest(F.size("edges") - 2, F.lit(0)))).alias("bin"))
    z = full.join(shares("expected"), ["expected", "actual", "bin"], "left").join(shares("actual"), ["expected", "actual", "bin"], "left")
    e, a = F.coalesce("s_expected", F.lit(0.0)) + 1e-6, F.coalesce("s_actual", F.lit(0.0)) + 1e-6
    return z.groupBy("expected", "actual").agg(F.when(F.max("k") >= 3, F.sum((a - e) * F.ln(a / e))).otherwise(0.0).alias("psi"))


def psi_across_windows(df: DataFrame, feature: str, order: list[str], n_windows: int = 6, bins: int = 10) -> DataFrame:
    """Mean PSI of consecutive windows of equal count."""
    x = chunks(df.select(feature, *[c for c in order if c != feature]), order, n_windows, "__w")
    pairs = df.sparkSession.range(1, n_windows).select(F.col("id").cast("int").alias("expected"), (F.col("id") + 1).cast("int").alias("actual"))
    return psi_pairs(x, feature, "__w", pairs, bins).agg(F.coalesce(F.avg("psi"), F.lit(0.0)).alias("psi_t"))


def psi_across_sources(df: DataFrame, feature: str, source: str, bins: int = 10) -> DataFrame:
    """Mean PSI over pairs of sources; the alphabetically first one is expected."""
    s = df.select(F.col(source).alias("expected")).where("expected is not null").distinct()
    pairs = s.join(s.withColumnRenamed("expected", "actual"), F.col("expected") < F.col("actual"))
    return psi_pairs(df.where(F.col(source).isNotNull()), feature, source, pairs, bins).agg(F.coalesce(F.avg("psi"), F.lit(0.0)).alias("psi_s"))


def stability(parts: DataFrame, alpha: float = 1.0, beta: float = 1.0, gamma: float = 1.0, q: float = 0.25) -> DataFrame:
    """feature, psi_t, psi_s, sigma2 -> stab (its inverse weighted sum; 0 sum: the largest), is_stable, weight."""
    raw = F.lit(alpha) * F.col("psi_t") + F.lit(beta) * F.col("psi_s") + F.lit(gamma) * F.col("sigma2")
    al = W.partitionBy()
    x = parts.withColumn("__s", F.when(raw > 0, 1 / raw))
    x = x.withColumn("stab", F.coalesce("__s", F.max("__s").over(al), F.lit(1.0))).drop("__s")
    t = x.agg(F.expr(f"percentile(stab, {q})").alias("__t"))
    x = x.crossJoin(F.broadcast(t)).withColumn("is_stable", F.col("stab") >= F.col("__t")).drop("__t")
    return x.withColumn("weight", F.coalesce(F.col("stab") / F.nullif(F.sum("stab").over(al), F.lit(0.0)), 1 / F.count("*").over(al)))


def most_uncertain(df: DataFrame, score: str, key: str, share: float, by: tuple[str, ...] = ()) -> DataFrame:
    """max(1, round(n share)) rows of each group whose score is closest to one half."""
    w = W.partitionBy(*by)
    r = F.row_number().over(w.orderBy(F.abs(F.col(score) - 0.5), key))
    n = F.greatest(F.lit(1), F.bround(F.count("*").over(w) * F.lit(share)).cast("int"))
    return df.withColumn("__r", r).withColumn("__n", n).where("__r <= __n").drop("__r", "__n")


class Adwin:
    """Adaptive windowing (Bifet and Gavalda 2007): buckets of exponential size; the window is cut where two parts
    differ by more than the bound. State is plain lists, so it can be stored by a stateful operator."""

    def __init__(self, delta: float = 0.002, per_row: int = 5, grace: int = 10, every: int = 32) -> None:
        self.delta, self.per_row, self.grace, self.every = delta, per_row, grace, every
        self.rows: list[list[list[float]]] = [[]]  # rows[i]: buckets [sum, variance x n] of 2**i values, newest last
        self.n, self.total, self.dev, self.seen = 0, 0.0, 0.0, 0

    def update(self, x: float) -> bool:
        self.seen += 1
        if self.n:
            mean = self.total / self.n
            self.dev += (x - mean) ** 2 * self.n / (self.n + 1)
        self.n += 1
        self.total += x
        self.rows[0].append([x, 0.0])
        for i in range(len(self.rows)):
            if len(self.rows[i]) <= self.per_row:
                break
            a, b = self.rows[i].pop(0), self.rows[i].pop(0)
            size = 1 << i
            u = (a[0] - b[0]) / size
            merged = [a[0] + b[0], a[1] + b[1] + size * size * u * u / (2 * size)]
            if i + 1 == len(self.rows):
                self.rows.append([])
            self.rows[i + 1].append(merged)
        return self.seen % self.every == 0 and self.n > self.grace and self._shrink()

    def _shrink(self) -> bool:
        cut, again = False, True
        while again:
            again = False
            n0, s0 = 0, 0.0
            for i in range(len(self.rows) - 1, -1, -1):
                for b in self.rows[i]:
                    n0 += 1 << i
                    s0 += b[0]
                    n1 = self.n - n0
                    if n0 < 5 or n1 < 5:
                        continue
                    var = self.dev / self.n
                    d = math.log(2 * math.log(max(self.n, 3)) / self.delta)
                    m = 1 / n0 + 1 / n1
                    eps = math.sqrt(2 * m * var * d) + 2 / 3 * m * d
                    if abs(s0 / n0 - (self.total - s0) / n1) > eps:
                        self._drop_oldest()
                        cut = again = True
                        break
                if again:
                    break
        return cut

    def _drop_oldest(self) -> None:
        i = len(self.rows) - 1
        while i >= 0 and not self.rows[i]:
            i -= 1
        s, v = self.rows[i].pop(0)
        size = 1 << i
        rest = self.n - size
        if rest:
            d = s / size - (self.total - s) / rest
            self.dev -= v + d * d * size * rest / self.n
            self.dev = max(self.dev, 0.0)
        else:
            self.dev = 0.0
        self.n, self.total = rest, self.total - s
        while len(self.rows) > 1 and not self.rows[-1]:
            self.rows.pop()


def confidence(score: Column) -> Column:
    return 2 * F.abs(score - 0.5)


def drift_alarms(df: DataFrame, key: str, order: str, value: str, delta: float = 0.002) -> DataFrame:
    """(key, position, order value) of each alarm; the values of a key are one ordered stream. Rows come sorted from the
    shuffle in batches, so a long stream is read piecewise with the detector's small state."""

    def run(batches):
        current, a, pos = None, None, 0
        for pdf in batches:
            out = []
            for k, o, v in zip(pdf["k"], pdf["o"], pdf["v"]):
                if k != current:
                    current, a, pos = k, Adwin(delta), 0
                pos += 1
                if a.update(float(v)):
                    out.append((k, pos, o))
            yield pd.DataFrame(out, columns=["key", "position", "at"])

    x = df.where(F.col(value).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(order).cast("long").alias("o"), F.col(value).cast("double").alias("v"))
    return x.repartition("k").sortWithinPartitions("k", "o").mapInPandas(run, "key string, position long, at long")


def adaptive_loop(scores: list[list[float]], labels: list[list[int]], retrain, share: float = 0.02, delta: float = 0.002) -> dict:
    """Chunks in order: each is scored by the model left by the one before; on an alarm the most uncertain rows are
    labelled and `retrain(chunk, positions)` is called. The caller holds the model; this holds state and counts."""
    a, alarms, used, restarts, seen = Adwin(delta), [], 0, 0, 0
    for c, chunk in enumerate(scores):
        hit = [seen + i for i, s in enumerate(chunk) if a.update(2 * abs(s - 0.5))]
        seen += len(chunk)
        if hit:
            alarms += hit
            k = max(1, round(len(chunk) * share))
            pick = sorted(range(len(chunk)), key=lambda i: (abs(chunk[i] - 0.5), i))[:k]
            used += len(pick)
            restarts += 1
            retrain(c, pick)
    return {"alarms": alarms, "labels_used": used, "warm_restarts": restarts}


__all__ = ["Adwin", "adaptive_loop", "confidence", "drift_alarms", "most_uncertain", "psi_across_sources", "psi_across_windows", "psi_pairs", "stability"]
