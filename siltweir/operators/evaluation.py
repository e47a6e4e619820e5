"""Splits and metrics over (score, label) rows. Everything is an aggregate or one sort; nothing is collected."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltweir.operators.ordered import prefix_sums


def temporal_split(df: DataFrame, ts: str, cut: str, months: tuple[int, ...], disjoint: bool = False) -> DataFrame:
    """Rows with a window column: 0 for train (up to the cut), m for the window that ends m months after it. Windows are
    nested unless disjoint. Rows without a time stamp take no part; check them with undated()."""
    c = F.lit(cut).cast("timestamp_ntz")
    t = F.col(ts).cast("timestamp_ntz")
    parts = [df.where(t <= c).withColumn("window_months", F.lit(0))]
    prev = 0
    for m in sorted(months):
        low = c + F.make_ym_interval(F.lit(0), F.lit(prev)) if disjoint and prev else c
        parts.append(df.where((t > low) & (t <= c + F.make_ym_interval(F.lit(0), F.lit(m)))).withColumn("window_months", F.lit(m)))
        prev = m
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def undated(df: DataFrame, ts: str) -> DataFrame:
    return df.agg(F.count_if(F.col(ts).isNull()).alias("undated"))


def confusion(score: Column, label: Column, threshold: float) -> list[Column]:
    hit = score >= threshold
    return [
        F.count_if(hit & (label == 1)).alias("tp"), F.count_if(hit & (label == 0)).alias("fp"),
        F.count_if(~hit & (label == 1)).alias("fn"), F.count_if(~hit & (label == 0)).alias("tn"),
    ]


def prevalence_precision(tpr: Column, fpr: Column, prevalence: Column) -> Column:
    """Precision at a prevalence; NULL where nothing is flagged."""
    return prevalence * tpr / F.nullif(prevalence * tpr + (1 - prevalence) * fpr, F.lit(0.0))


def prevalence_report(df: DataFrame, score: str, label: str, threshold: float, prevalences: tuple[float, ...] = (0.01, 0.001, 0.0001), by: tuple[str, ...] = ()) -> DataFrame:
    c = df.groupBy(*by).agg(*confusion(F.col(score), F.col(label), threshold))
    rates = c.select(*by, (F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))).alias("tpr"), (F.col("fp") / F.nullif(F.col("fp") + F.col("tn"), F.lit(0))).alias("fpr"))
    x = rates.select("*", F.explode(F.array(*[F.lit(p) for p in prevalences])).alias("prevalence"))
    p = F.col("prevalence")
    return x.withColumn("precision", prevalence_precision(F.col("tpr"), F.col("fpr"), p)).withColumn("alerts_per_1e6", 1e6 * (p * F.col("tpr") + (1 - p) * F.col("fpr")))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval, clamped to 0..1; NULL for n = 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(mid - half, F.lit(0.0)), F.least(mid + half, F.lit(1.0))


def by_score(df: DataFrame, score: str, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, __s, p, n): counts of both classes at each score."""
    return df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("__s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))


def roc_auc(df: DataFrame, score: str, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Exact area under the curve from tie-grouped counts and their running sums, which no task holds whole. NULL where a
    class is missing."""
    g = prefix_sums(by_score(df, score, label, by), ["__s"], {"below": F.col("n")}, list(by))
    return g.groupBy(*by).agg((F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)) / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auc"))


def threshold_choice(df: DataFrame, score: str, label: str, prevalence: float = 1e-4, least_recall: float = 0.97, places: int = 4) -> DataFrame:
    """The threshold of most precision at the prevalence whose recall is high enough; of equal ones the lowest."""
    g = df.groupBy(F.bround(F.col(score), places).alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    up = W.orderBy(F.desc("threshold")).rowsBetween(W.unboundedPreceding, 0)
    al = W.partitionBy()
    g = g.select("threshold", (F.sum("p").over(up) / F.sum("p").over(al)).alias("recall"), (F.sum("n").over(up) / F.sum("n").over(al)).alias("fpr"))
    g = g.withColumn("precision", prevalence_precision(F.col("recall"), F.col("fpr"), F.lit(prevalence)))
    return g.where(F.col("recall") >= least_recall).orderBy(F.desc("precision"), "threshold").limit(1)


def coverage_risk(df: DataFrame, score: str, label: str, half_widths: tuple[float, ...]) -> DataFrame:
    """Share answered and error among the answered when scores within a half-width of one half, or at it, abstain. Rows
    are counted by score before they meet the half-widths."""
    g = df.groupBy(F.col(score).alias("s"), F.col(label).alias("y")).agg(F.count("*").alias("c"))
    x = g.select("*", F.explode(F.array(*[F.lit(float(h)) for h in half_widths])).alias("half_width"))
    s, h, c = F.col("s"), F.col("half_width"), F.col("c")
    said = F.coalesce((s < 0.5 - h) | (s > 0.5 + h), F.lit(False))
    wrong = (s >= 0.5).cast("int") != F.col("y")
    of = lambda cond: F.coalesce(F.sum(F.when(cond, c)), F.lit(0))
    return x.groupBy("half_width").agg((of(said) / F.sum(c)).alias("coverage"), (of(said & wrong) / F.nullif(of(said), F.lit(0))).alias("risk"))


def abstention_grid(df: DataFrame, score: str, label: str, grid: tuple[float, ...], least_coverage: float) -> DataFrame:
    """Band (lo, hi) of least error among those that answer enough; of equal ones the widest, then the lowest lo. Rows are
    counted by the place of their score among the grid's values before they meet the bands."""
    s = F.col(score)
    edges = sorted(set(grid))
    place = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < s)) * 2 + s.isin(*edges).cast("int")
    g = df.where(s.isNotNull()).groupBy(place.alias("at"), F.col(label).alias("y")).agg(F.count("*").alias("c"))
    bands = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi"), F.lit(2 * edges.index(a)).alias("a"), F.lit(2 * edges.index(b) + 1).alias("b")) for a in edges for b in edges if a < b])
    x = g.select("*", F.explode(bands).alias("g")).select("at", "y", "c", "g.*")
    # at: twice the edges below, and one more on an edge; so below lo is at <= a, and above hi is at > b
    said, high, c = (F.col("at") <= F.col("a")) | (F.col("at") > F.col("b")), F.col("at") > F.col("b"), F.col("c")
    of = lambda cond: F.coalesce(F.sum(F.when(cond, c)), F.lit(0))
    r = x.groupBy("lo", "hi").agg((of(said) / F.sum(c)).alias("coverage"), (of(said & (high.cast("int") != F.col("y"))) / F.nullif(of(said), F.lit(0))).alias("risk"))
    return r.where(F.col("coverage") >= least_coverage).orderBy("risk", F.desc(F.col("hi") - F.col("lo")), "lo").limit(1)


#: Cumulative probabilities of a Poisson weight of mean 1.
_POISSON = np.cumsum(np.exp(-1.0) / np.array([math.factorial(k) for k in range(12)]))


def _weights(keys: np.ndarray, boots: np.ndarray, seed: int) -> np.ndarray:
    """Poisson weights, rows by resamples, drawn from a mix of key, resample and seed (splitmix64)."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + boots.astype(np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed + 1) * np.uint64(0x8CB92BA72F3D8DD7)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return np.searchsorted(_POISSON, (z >> np.uint64(11)) / float(1 << 53), side="right")


def resampled(df: DataFrame, scores: list[str], label: str, key: str, n_boot: int, seed: int = 0) -> DataFrame:
    """(score column, b, s, p, n): weighted class counts at each score of each resample. Weights depend on key and
    resample only, so columns of scores are paired. Each batch is summed before anything is shuffled."""

    def run(batches):
        boots = np.arange(n_boot)
        for pdf in batches:
            w = _weights(pdf["k"].to_numpy(), boots, seed)
            y = pdf["y"].to_numpy()
            for i, c in enumerate(scores):
                v, at = np.unique(pdf[f"s{i}"].to_numpy(), return_inverse=True)
                p, n = np.zeros((len(v), n_boot), np.int64), np.zeros((len(v), n_boot), np.int64)
                np.add.at(p, at[y == 1], w[y == 1])
                np.add.at(n, at[y == 0], w[y == 0])
                r, b = np.nonzero(p + n)
                yield pd.DataFrame({"score": c, "b": b, "s": v[r], "p": p[r, b], "n": n[r, b]})

    x = df.dropna(subset=[*scores, label]).select(F.xxhash64(key).alias("k"), F.col(label).cast("int").alias("y"), *[F.col(c).cast("double").alias(f"s{i}") for i, c in enumerate(scores)])
    return x.mapInPandas(run, "score string, b int, s double, p long, n long").groupBy("score", "b", "s").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))


def _boot_aucs(df: DataFrame, scores: list[str], label: str, key: str, n_boot: int, seed: int) -> DataFrame:
    g = prefix_sums(resampled(df, scores, label, key, n_boot, seed), ["s"], {"below": F.col("n")}, ["score", "b"])
    a = g.groupBy("score", "b").agg((F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)) / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auc"))
    return a.where("auc is not null")


def bootstrap_auc(df: DataFrame, score: str, label: str, key: str, n_boot: int = 200, ci: float = 0.95, seed: int = 0) -> DataFrame:
    """Percentile interval from Poisson resamples (each row weighs 0, 1, 2, ... times in a resample, drawn from a hash of
    key and resample, so replicas agree). Resamples without both classes are left out."""
    a = _boot_aucs(df, [score], label, key, n_boot, seed)
    lo, hi = (1 - ci) / 2, 1 - (1 - ci) / 2
    return a.agg(F.expr(f"percentile(auc, {lo})").alias("lo"), F.expr(f"percentile(auc, {hi})").alias("hi"), F.count("*").alias("n_boot"))  # one value a resample


def bootstrap_delta(df: DataFrame, first: str, second: str, label: str, key: str, n_boot: int = 200, ci: float = 0.95, seed: int = 0) -> DataFrame:
    """Difference of the areas under the curve of two scores of the same rows, second less first, with a percentile
    interval over paired resamples and whether it excludes 0."""
    a = _boot_aucs(df, [first, second], label, key, n_boot, seed)
    per = a.groupBy("b").pivot("score", [first, second]).agg(F.first("auc")).select((F.col(second) - F.col(first)).alias("d")).where("d is not null")
    lo, hi = (1 - ci) / 2, 1 - (1 - ci) / 2
    x, y = roc_auc(df, first, label), roc_auc(df, second, label)
    b = per.agg(F.expr(f"percentile(d, {lo})").alias("lo"), F.expr(f"percentile(d, {hi})").alias("hi"), F.count("*").alias("n_boot"))
    r = x.select(F.col("auc").alias("x")).crossJoin(y.select(F.col("auc").alias("y"))).crossJoin(b)  # one row each
    return r.select((F.col("y") - F.col("x")).alias("delta"), "lo", "hi", "n_boot", ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("differs"))


def _average_ranks(df: DataFrame, c: str) -> DataFrame:
    """(value, its average rank) of a column of counted values."""
    g = df.groupBy(F.col(c).alias(f"__k{c}")).agg(F.sum("__c").alias("__m"))
    return prefix_sums(g, [f"__k{c}"], {"__b": F.col("__m")}).select(f"__k{c}", (F.col("__b") + (F.col("__m") + 1) / 2).alias(f"__r{c}"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of average ranks, over counted pairs of values."""
    g = df.groupBy(a, b).agg(F.count("*").alias("__c"))
    for c in (a, b):
        r = _average_ranks(g, c)
        g = g.join(r, F.col(c).eqNullSafe(F.col(f"__k{c}")))
    x, y, w = F.col(f"__r{a}"), F.col(f"__r{b}"), F.col("__c")
    m = g.agg(F.sum(w).alias("n"), F.sum(w * x).alias("x"), F.sum(w * y).alias("y"), F.sum(w * x * y).alias("xy"), F.sum(w * x * x).alias("xx"), F.sum(w * y * y).alias("yy"))
    cov = lambda u, v, uv: F.col(uv) / F.col("n") - F.col(u) / F.col("n") * F.col(v) / F.col("n")
    return m.select((cov("x", "y", "xy") / F.nullif(F.sqrt(cov("x", "x", "xx") * cov("y", "y", "yy")), F.lit(0.0))).alias("rho"))


def _inversions(v: np.ndarray) -> int:
    """Pairs that stand in the wrong order, by merging halves."""
    if len(v) < 2:
        return 0
    h = len(v) // 2
    return _inversions(v[:h]) + _inversions(v[h:]) + int((h - np.searchsorted(np.sort(v[:h]), v[h:], side="right")).sum())


def kendall_tau(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """tau-b of two rankings of the same things (models, features, sources: small by nature, so they are read in one
    task), in n log n steps."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["a", "b"], kind="stable")
        tied = lambda cols: sum(int(c) * (int(c) - 1) // 2 for c in pdf.groupby(cols).size())
        n = len(pdf) * (len(pdf) - 1) // 2
        ta, tb, both = tied(["a"]), tied(["b"]), tied(["a", "b"])
        root = math.sqrt((n - ta) * (n - tb))
        return pd.DataFrame({"tau": [(n - ta - tb + both - 2 * _inversions(pdf["b"].to_numpy())) / root if root else None]}, dtype="float64")

    return df.select(key, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).dropna().groupBy().applyInPandas(run, "tau double")


def source_matrix(df: DataFrame, source: str, score: str, label: str) -> DataFrame:
    """AUC on each source, on all others pooled, and the mean over the others. The others are all sources less the one:
    running sums over all and over the source's own scores are enough, and no row is repeated."""
    g = by_score(df.where(F.col(source).isNotNull()), score, label, (source,))
    al = g.groupBy("__s").agg(F.sum("p").alias("ap"), F.sum("n").alias("an"))
    al = prefix_sums(al, ["__s"], {"apb": F.col("ap"), "anb": F.col("an")})
    top = al.agg(F.sum("ap").alias("ap_all"), F.sum("an").alias("an_all"), F.sum(F.col("ap") * (F.col("anb") + F.col("an") / 2)).alias("a_all"))
    own = prefix_sums(g, ["__s"], {"nb": F.col("n")}, [source])
    x = own.join(al, "__s").crossJoin(F.broadcast(top))  # one row
    per = x.groupBy(source).agg(
        F.sum("p").alias("tp"), F.sum("n").alias("tn"), F.sum(F.col("p") * (F.col("nb") + F.col("n") / 2)).alias("aa"), *[F.first(c).alias(c) for c in ("ap_all", "an_all", "a_all")],
        F.sum(F.col("p") * (F.col("anb") + F.col("an") / 2)).alias("pa"), F.sum(F.col("n") * (F.col("ap_all") - F.col("apb") - F.col("ap") / 2)).alias("na"),
    )
    auc = F.col("aa") / F.nullif(F.col("tp") * F.col("tn"), F.lit(0))
    pooled = (F.col("a_all") - F.col("pa") - F.col("na") + F.col("aa")) / F.nullif((F.col("ap_all") - F.col("tp")) * (F.col("an_all") - F.col("tn")), F.lit(0))
    per = per.select(source, auc.alias("auc"), pooled.alias("others_pooled"))
    sums = per.agg(F.sum("auc").alias("__t"), F.count("auc").alias("__k"))
    others = (F.col("__t") - F.coalesce("auc", F.lit(0.0))) / F.nullif(F.col("__k") - F.col("auc").isNotNull().cast("int"), F.lit(0))
    return per.crossJoin(F.broadcast(sums)).select(source, "auc", "others_pooled", others.alias("others_mean"))  # one row


def recall_under_transforms(df: DataFrame, url: str, label: str, key: str, score, transforms: dict, threshold: float = 0.5) -> DataFrame:
    """(transform, recall, delta) over the harmful rows: as they are, and with each transform applied to their address.
    `score` maps a Column of addresses to scores. One pass: the variants of a row are one array."""
    bad = df.where(F.col(label) == 1)
    forms = {"none": F.col(url)} | {n: f(F.col(url), F.col(key)) for n, f in transforms.items()}
    x = bad.select(F.explode(F.array(*[F.struct(F.lit(n).alias("transform"), c.alias("u")) for n, c in forms.items()])).alias("v")).select("v.transform", "v.u")
    r = x.groupBy("transform").agg((F.count_if(score(F.col("u")) >= threshold) / F.count("*")).alias("recall"))
    base = r.where("transform = 'none'").select(F.col("recall").alias("__b"))
    return r.crossJoin(F.broadcast(base)).select("transform", "recall", (F.col("recall") - F.col("__b")).alias("delta"))  # one row


def separated(cells: DataFrame, model: str, train: str, lo: str, hi: str, inside: str) -> DataFrame:
    """Cells outside their distribution whose interval doesn't overlap that of the cell inside, for each model and
    training source."""
    home = cells.where(F.col(inside)).select(model, train, F.col(lo).alias("__lo"), F.col(hi).alias("__hi"))
    return cells.where(~F.col(inside)).join(home, [model, train]).where((F.col(hi) < F.col("__lo")) | (F.col(lo) > F.col("__hi"))).drop("__lo", "__hi")


def operating_points(df: DataFrame, score: str, label: str, thresholds: tuple[float, ...]) -> DataFrame:
    """(threshold, recall, fpr, n). Rows are counted by score before they meet the thresholds."""
    g = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s"), F.col(label).alias("y")).agg(F.count("*").alias("c"))
    x = g.select("*", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    of = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("c"))), F.lit(0))
    hit = F.col("s") >= F.col("threshold")
    return x.groupBy("threshold").agg((of(hit & (F.col("y") == 1)) / F.nullif(of(F.col("y") == 1), F.lit(0))).alias("recall"), (of(hit & (F.col("y") == 0)) / F.nullif(of(F.col("y") == 0), F.lit(0))).alias("fpr"), F.sum("c").alias("n"))


def share_sample(df: DataFrame, flag: Column, key: str, share: float, n: int) -> DataFrame:
    """n rows of which exactly round(share n) have the flag: the smallest hashes of each side."""
    want = round(share * n)
    h = F.pmod(F.col(key) * 1103515245 + 12345, F.lit(2147483647))
    return df.where(flag).orderBy(h, key).limit(want).unionByName(df.where(~flag).orderBy(h, key).limit(n - want))


def accepted(verdict: Column, expected: Column) -> Column:
    """Whether a verdict meets what is expected: ALLOW (safe or trusted), DENY (not), or the verdict itself."""
    good = verdict.isin("safe", "trusted", "legitimate")
    return F.when(expected == "ALLOW", good).when(expected == "DENY", ~good).otherwise(verdict == expected)
