"""Duplicate rates, near-duplicate pairs and greedy in-order dedup over character shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltweir.functions.transforms import plain_letters
from siltweir.session import spread, staged, unstage


def shingles(text: Column, k: int = 4) -> Column:
    """Distinct k-character substrings in lower case; a shorter text is its own only one."""
    s = F.lower(text)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - k + 1, F.lit(1))), lambda i: F.substr(s, i, F.lit(k)))
    return F.when(text.isNotNull(), F.array_distinct(grams))


def exact_duplicate_rate(df: DataFrame, text: str, by: tuple[str, ...] = ()) -> DataFrame:
    """1 - distinct / all; 0 for no rows."""
    n = df.groupBy(*by, F.col(text).alias("__t")).agg(F.count("*").alias("n")).groupBy(*by).agg(F.sum("n").alias("n"), F.count_if(F.col("__t").isNotNull()).alias("d"))
    return n.select(*by, "n", F.coalesce(1 - F.col("d") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)).alias("exact_dup_rate"))


def near_pairs(df: DataFrame, key: str, text: str, threshold: float = 0.8, k: int = 4) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of distinct texts whose shingle sets are that similar. Shingles are ordered
    from rare to frequent; similar sets share one among the first of each, at places from which enough can still be in
    common. Candidates are checked exactly. Equal texts are one candidate, named by their smallest key; bring the copies
    back with a join on the text."""
    one = staged(spread(df.where(F.col(text).isNotNull()).groupBy(F.lower(text).alias("t")).agg(F.min(key).alias("k"))), "texts")
    grams = one.select("k", F.explode(shingles(F.col("t"), k)).alias("x"))
    ranked = grams.join(grams.groupBy("x").agg(F.count("*").alias("df")), "x").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("df", "x"))).alias("g"))
    n = F.size("g")
    first = ranked.select("k", n.alias("n"), F.posexplode(F.slice("g", F.lit(1), n - F.ceil(threshold * n - 1e-9).cast("int") + 1)).alias("at", "z"))
    first = staged(first.where("z.df > 1").select("k", "n", "at", F.col("z.x").alias("x")), "rare")
    other = first.select(F.col("k").alias("k2"), F.col("n").alias("n2"), F.col("at").alias("at2"), "x")
    most = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"))
    near = (F.col("k") < F.col("k2")) & (most * (1 + threshold) >= threshold * (F.col("n") + F.col("n2")) - 1e-6)
    cand = first.join(other, "x").where(near).select("k", "k2").distinct()
    a, b = one.select("k", F.col("t").alias("ta")), one.select(F.col("k").alias("k2"), F.col("t").alias("tb"))
    x = cand.join(a, "k").join(b, "k2").select("k", "k2", shingles(F.col("ta"), k).alias("g"), shingles(F.col("tb"), k).alias("g2"))
    both = F.size(F.array_intersect("g", "g2"))
    sim = both / (F.size("g") + F.size("g2") - both)
    return x.select(F.col("k").alias("a"), F.col("k2").alias("b"), sim.alias("similarity")).where(F.col("similarity") >= threshold)


def greedy_keep(df: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """(key, kept): a row is dropped if it is similar to a kept row before it. Fixpoint: rows whose earlier neighbours are
    all dropped are kept, rows with a kept earlier neighbour are dropped; equals the sequential result."""
    live = staged(pairs.select(F.col("a").alias("early"), F.col("b").alias("late")), "greedy")
    state = staged(live.select(F.col("early").alias("k")).union(live.select("late")).distinct().withColumn("kept", F.lit(None).cast("boolean")), "greedy-state")
    while True:  # the first undecided row of the order is decided in every round
        open_ = state.where("kept is null").select("k")
        if open_.isEmpty():
            break
        e = live.join(state.select(F.col("k").alias("early"), F.col("kept").alias("ek")), "early")
        per = e.groupBy(F.col("late").alias("k")).agg(F.bool_or(F.coalesce("ek", F.lit(False))).alias("has_kept"), F.bool_and(F.coalesce(~F.col("ek"), F.lit(False))).alias("all_dropped"))
        nxt = staged(state.join(per, "k", "left").select("k", F.coalesce("kept", F.when(F.col("has_kept"), F.lit(False)), F.when(F.coalesce("all_dropped", F.lit(True)), F.lit(True))).alias("kept")), "greedy-state")
        unstage(state)
        state = nxt
    return df.select(key).join(state.withColumnRenamed("k", key), key, "left").select(key, F.coalesce("kept", F.lit(True)).alias("kept"))


def leakage_rate(pairs: DataFrame, df: DataFrame, key: str, split: str, train: str, test: str) -> DataFrame:
    """Share of test texts with a similar train text."""
    s = df.select(F.col(key).alias("k"), F.col(split).alias("s"))
    x = pairs.join(s.withColumnsRenamed({"k": "a", "s": "sa"}), "a").join(s.withColumnsRenamed({"k": "b", "s": "sb"}), "b")
    hit = x.where((F.col("sa") == train) & (F.col("sb") == test)).select(F.col("b").alias("k")).union(x.where((F.col("sb") == train) & (F.col("sa") == test)).select(F.col("a").alias("k"))).distinct()
    n = s.where(F.col("s") == test)
    return n.join(hit.withColumn("hit", F.lit(1)), "k", "left").agg(F.count("*").alias("n"), F.count("hit").alias("leaked")).withColumn("rate", F.coalesce(F.col("leaked") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)))


def dedup_frame(df: DataFrame, key: str, text: str, threshold: float = 0.8, k: int = 4) -> DataFrame:
    """df without the rows whose text is equal or that similar to a kept one before it (by key). Columns stay; rows without
    a text stay."""
    first = df.where(F.col(text).isNotNull()).groupBy(F.lower(text).alias("__t")).agg(F.min(key).alias("__k"))
    one = first.select(F.col("__k").alias(key))
    keep = greedy_keep(one, key, near_pairs(df, key, text, threshold, k)).where("kept").select(key)
    return df.join(keep, key, "left_semi").unionByName(df.where(F.col(text).isNull()))


def cleaned(df: DataFrame, key: str, text: str, threshold: float = 0.8) -> DataFrame:
    """Training rows: near duplicates dropped first, then look-alike letters of the kept texts given as ASCII."""
    return dedup_frame(df, key, text, threshold).withColumn(text, plain_letters(F.col(text)))


def before_and_after(df: DataFrame, key: str, text: str, metric, threshold: float = 0.8) -> DataFrame:
    """(stage, n, metric) of the frame as it is and without near duplicates; `metric` maps a frame to one row with one
    column."""
    out = None
    for stage, x in (("before", df), ("after", dedup_frame(df, key, text, threshold))):
        m = metric(x)
        r = x.agg(F.count("*").alias("n")).crossJoin(m.select(F.col(m.columns[0]).cast("double").alias("metric"))).select(F.lit(stage).alias("stage"), "n", "metric")  # one row each
        out = r if out is None else out.unionByName(r)
    return out
