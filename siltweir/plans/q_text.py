"""Duplicates and character models."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltweir.operators import charmodel as C
from siltweir.operators import dedup as D
from siltweir.session import table


def _urls(s, d):
    return table(s, d, "run_b6_experiments").select("row_id", "url", "source", "split", "label")


def exact_dup_rates(s, d):
    x = D.exact_duplicate_rate(_urls(s, d), "url", ("source",))
    return x.select("source", "n", F.round("exact_dup_rate", 8).alias("exact_dup_rate"))


def shingle_counts(s, d):
    return _urls(s, d).select("row_id", F.size(D.shingles(F.col("url"))).alias("shingles"))


def near_dup_pairs(s, d):
    x = D.near_pairs(_urls(s, d), "row_id", "url")
    return x.select("a", "b", F.round("similarity", 8).alias("similarity"))


def greedy_dedup(s, d):
    """Over the distinct addresses of the whole table."""
    x = _urls(s, d)
    keep = D.greedy_keep(x.where("url is not null").groupBy(F.lower("url")).agg(F.min("row_id").alias("row_id")), "row_id", D.near_pairs(x, "row_id", "url"))
    return keep.groupBy("kept").agg(F.count("*").alias("n"), F.sum("row_id").alias("ids"))


def leakage(s, d):
    """Over the distinct test addresses of the whole table; an address that stands in train too is leaked."""
    x = _urls(s, d).where("url is not null and split in ('train', 'test')")
    one = x.groupBy(F.lower("url").alias("url")).agg(F.min("row_id").alias("row_id"), F.array_sort(F.collect_set("split")).alias("splits"))
    rows = one.select("row_id", F.explode("splits").alias("split"))
    same = one.where(F.size("splits") == 2).select(F.col("row_id").alias("a"), F.col("row_id").alias("b"), F.lit(1.0).alias("similarity"))
    return D.leakage_rate(D.near_pairs(x, "row_id", "url").union(same), rows, "row_id", "split", "train", "test")


def markov_counts(s, d):
    return C.fit(_urls(s, d), "url", 4, ("label",)).groupBy("label").agg(F.count("*").alias("steps"), F.sum("n").alias("n"), F.count_distinct("context").alias("contexts"))


def char_surprisal(s, d):
    x = _urls(s, d)
    m = C.fit(x.where("label = 0"), "url", 4)
    return C.surprisal(x.where("label = 1 and split = 'test'"), "row_id", "url", m).select("row_id", F.round("surprisal", 6).alias("surprisal"))


def surprisal_threshold(s, d):
    x = _urls(s, d)
    m = C.fit(x.where("label = 0 and split = 'train'"), "url", 4)
    v = C.surprisal(x.where("label = 0 and split = 'validation'"), "row_id", "url", m)
    return C.percentile_threshold(v, "surprisal").select(F.round("threshold", 6).alias("threshold"))


def markov_generated(s, d):
    m = C.fit(_urls(s, d).where("label = 1"), "url", 4)
    return C.generate(m, s.range(0, 200).withColumnRenamed("id", "seed"))


QUERIES = {f.__name__: f for f in (exact_dup_rates, shingle_counts, near_dup_pairs, greedy_dedup, leakage, markov_counts, char_surprisal, surprisal_threshold, markov_generated)}

_G = "list_distinct(list_transform(range(1, greatest(length(lower({u})) - 3, 1)::BIGINT + 1), lambda i: substr(lower({u}), i, 4)))"
_PAIRS = f"""one AS (SELECT lower(url) AS t, min(row_id) AS k FROM src GROUP BY 1), g AS (SELECT k, {_G.format(u='t')} AS g FROM one), e AS (SELECT k, unnest(g) AS x FROM g), f AS (SELECT x, count(*) AS df FROM e GROUP BY 1),
r AS (SELECT e.k, e.x, row_number() OVER (PARTITION BY e.k ORDER BY df, e.x) AS r, count(*) OVER (PARTITION BY e.k) AS n FROM e JOIN f ON e.x = f.x), p AS (SELECT k, x FROM r WHERE r <= n - ceil(0.8 * n - 1e-9) + 1),
c AS (SELECT DISTINCT a.k AS a, b.k AS b FROM p a JOIN p b ON a.x = b.x AND a.k < b.k), j AS (SELECT a, b, len(list_intersect(ga.g, gb.g))::DOUBLE AS i, len(ga.g) AS na, len(gb.g) AS nb FROM c JOIN g ga ON c.a = ga.k JOIN g gb ON c.b = gb.k),
pairs AS (SELECT a, b, i / (na + nb - i) AS similarity FROM j WHERE i / (na + nb - i) >= 0.8)"""
_ST = "list_transform(range(1, greatest(length({s}) - 4, 0)::BIGINT + 1), lambda i: {{'c': substr({s}, i, 4), 'x': substr({s}, i + 4, 1)}})"
_MODEL = f"m AS (SELECT z.c AS context, z.x AS next, count(*) AS n FROM (SELECT unnest({_ST.format(s='t')}) AS z FROM (SELECT url || chr(10) AS t FROM src)) GROUP BY 1, 2), v AS (SELECT count(DISTINCT next) AS v FROM m), tt AS (SELECT context, sum(n) AS total FROM m GROUP BY 1)"
_SURP = f"s AS (SELECT row_id, unnest({_ST.format(s='url')}) AS z FROM q), sp AS (SELECT row_id, avg(CASE WHEN total IS NULL THEN log2(v) ELSE -log2((coalesce(n, 0) + 0.5::DOUBLE) / (total + 0.5::DOUBLE * v)) END) AS b FROM s LEFT JOIN tt ON s.z.c = tt.context LEFT JOIN m ON s.z.c = m.context AND s.z.x = m.next, v GROUP BY 1)"
SQL = {
    "exact_dup_rates": "SELECT source, count(*) AS n, round(1 - count(DISTINCT url) / count(*)::DOUBLE, 8) AS exact_dup_rate FROM run_b6_experiments GROUP BY 1",
    "shingle_counts": f"SELECT row_id, CAST(len({_G.format(u='url')}) AS INT) AS shingles FROM run_b6_experiments",
    "near_dup_pairs": f"WITH src AS (SELECT * FROM run_b6_experiments WHERE url IS NOT NULL), {_PAIRS} SELECT a, b, round(similarity, 8) AS similarity FROM pairs",
    "markov_counts": f"WITH src AS (SELECT label, url || chr(10) AS t FROM run_b6_experiments), m AS (SELECT label, z.c AS c, z.x AS x, count(*) AS n FROM (SELECT label, unnest({_ST.format(s='t')}) AS z FROM src) GROUP BY 1, 2, 3) SELECT label, count(*) AS steps, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT c) AS contexts FROM m GROUP BY 1",
    "char_surprisal": f"WITH src AS (SELECT url FROM run_b6_experiments WHERE label = 0), q AS (SELECT row_id, url FROM run_b6_experiments WHERE label = 1 AND split = 'test'), {_MODEL}, {_SURP} SELECT row_id, round(b, 6) AS surprisal FROM sp",
    "surprisal_threshold": f"WITH src AS (SELECT url FROM run_b6_experiments WHERE label = 0 AND split = 'train'), q AS (SELECT row_id, url FROM run_b6_experiments WHERE label = 0 AND split = 'validation'), {_MODEL}, {_SURP} SELECT round(quantile_cont(b, 0.95), 6) AS threshold FROM sp",
}
