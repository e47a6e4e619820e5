"""Evaluation queries. The score is a plain text feature, so that SQL can compute it, too."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltweir.operators import evaluation as E
from siltweir.session import table


def _scored(s, d):
    """row_id, label, source, split, ts, score in 0..1 from length and digits of the address."""
    u = F.col("url")
    digits = F.length(u) - F.length(F.regexp_replace(u, "[0-9]", ""))
    score = F.round(F.least(F.lit(1.0), F.length(u) / 150 + digits / 60), 4)
    return table(s, d, "run_b6_experiments").select("row_id", "label", "source", "split", F.col("submission_time").alias("ts"), score.alias("score"))


def temporal_counts(s, d):
    return E.temporal_split(_scored(s, d), "ts", "2024-01-01", (1, 6, 12)).groupBy("window_months").agg(F.count("*").alias("n"), F.sum("label").alias("phishing"))


def temporal_disjoint(s, d):
    return E.temporal_split(_scored(s, d), "ts", "2024-01-01", (1, 6, 12), disjoint=True).groupBy("window_months").agg(F.count("*").alias("n"))


def decay_curve(s, d):
    x = E.temporal_split(_scored(s, d), "ts", "2024-01-01", (1, 6, 12)).where("window_months > 0")
    return E.roc_auc(x, "score", "label", ("window_months",)).select("window_months", F.round("auc", 6).alias("auc"))


def source_matrix(s, d):
    x = E.source_matrix(_scored(s, d), "source", "score", "label")
    return x.select("source", *[F.round(c, 6).alias(c) for c in ("auc", "others_pooled", "others_mean")])


def confusion_by_split(s, d):
    return _scored(s, d).where("split is not null").groupBy("split").agg(*E.confusion(F.col("score"), F.col("label"), 0.5))


def prevalence_report(s, d):
    x = E.prevalence_report(_scored(s, d).where("split = 'test'"), "score", "label", 0.6, by=("source",))
    return x.select("source", "prevalence", *[F.round(c, 8).alias(c) for c in ("tpr", "fpr", "precision")], F.round("alerts_per_1e6", 4).alias("alerts_per_1e6"))


def wilson_buckets(s, d):
    x = _scored(s, d).groupBy("source").agg(F.count("*").alias("n"), F.count_if((F.col("score") >= 0.5).cast("int") != F.col("label")).alias("errors"))
    lo, hi = E.wilson(F.col("errors"), F.col("n"))
    return x.select("source", "n", "errors", F.round(lo, 8).alias("ci_lo"), F.round(hi, 8).alias("ci_hi"))


def roc_auc_exact(s, d):
    return E.roc_auc(_scored(s, d).where("split is not null"), "score", "label", ("split",)).select("split", F.round("auc", 8).alias("auc"))


def threshold_choice(s, d):
    x = E.threshold_choice(_scored(s, d), "score", "label", 1e-2, 0.6)
    return x.select("threshold", *[F.round(c, 8).alias(c) for c in ("recall", "fpr", "precision")])


def coverage_risk(s, d):
    x = E.coverage_risk(_scored(s, d), "score", "label", tuple(i / 20 for i in range(9)))
    return x.select("half_width", F.round("coverage", 8).alias("coverage"), F.round("risk", 8).alias("risk"))


def abstention_band(s, d):
    x = E.abstention_grid(_scored(s, d), "score", "label", (0.3, 0.4, 0.5, 0.6, 0.7), 0.5)
    return x.select("lo", "hi", F.round("coverage", 8).alias("coverage"), F.round("risk", 8).alias("risk"))


def rank_correlation(s, d):
    x = table(s, d, "part").select("p_partkey", "p_retailprice", "p_size")
    return E.spearman(x, "p_retailprice", "p_size").select(F.round("rho", 8).alias("rho"))


def ranking_agreement(s, d):
    """Two rankings of the brands: by quantity and by revenue."""
    x = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.sum("l_quantity").alias("q"), F.round(F.sum("l_extendedprice"), 2).alias("p"))
    return E.kendall_tau(x, "p_brand", "q", "p").select(F.round("tau", 8).alias("tau"))


def bootstrap_interval(s, d):
    return E.bootstrap_auc(_scored(s, d).where("split = 'test'"), "score", "label", "row_id", 50)


def bootstrap_difference(s, d):
    """Whether a second score, by length alone, does worse on the same rows."""
    x = _scored(s, d).where("split = 'test'").join(table(s, d, "run_b6_experiments").select("row_id", F.round(F.length("url") / 400, 4).alias("other")), "row_id")
    return E.bootstrap_delta(x, "score", "other", "label", "row_id", 50).select(F.round("delta", 8).alias("delta"), "n_boot", "differs")


def undated_rows(s, d):
    """Rows that the temporal splits can't place."""
    return _scored(s, d).groupBy("source").agg(F.count_if(F.col("ts").isNull()).alias("undated"), F.count("*").alias("n"))


def gates(s, d):
    """OR gate, AND gate, gated escalation and abstention as share of rows they flag."""
    x = _scored(s, d).withColumn("novel", F.pmod("row_id", F.lit(100)) / 100.0)
    a, b = F.col("score"), F.col("novel")
    return x.groupBy("label").agg(
        F.count_if((a >= 0.5) | (b >= 0.95)).alias("or_gate"), F.count_if((a >= 0.5) | ((b >= 0.9) & (a >= 0.3))).alias("and_gate"),
        F.count_if((a >= 0.5) | ((a >= 0.15) & (b >= 0.95))).alias("escalated"), F.count_if((a >= 0.4) & (a <= 0.6)).alias("abstained"),
    )


def cascade_cost(s, d):
    x = _scored(s, d).groupBy("source").agg(F.avg((F.col("score") >= 0.1).cast("double")).alias("routed"))
    ms = (18.07 + F.col("routed") * 3414.0) / 1000
    return x.select("source", F.round("routed", 8).alias("routed"), F.round(1000 / ms, 4).alias("urls_per_s"))


QUERIES = {f.__name__: f for f in (temporal_counts, temporal_disjoint, decay_curve, source_matrix, confusion_by_split, prevalence_report, wilson_buckets, roc_auc_exact, threshold_choice, coverage_risk, abstention_band, rank_correlation, ranking_agreement, bootstrap_interval, bootstrap_difference, undated_rows, gates, cascade_cost)}

_S = "sc AS (SELECT row_id, label, source, split, submission_time AS ts, round(least(1.0::DOUBLE, length(url) / 150::DOUBLE + (length(url) - length(regexp_replace(url, '[0-9]', '', 'g'))) / 60::DOUBLE), 4) AS score FROM run_b6_experiments)"
_W = "tw AS (SELECT *, 0 AS window_months FROM sc WHERE ts <= TIMESTAMP '2024-01-01' UNION ALL SELECT sc.*, m FROM sc, (VALUES (1), (6), (12)) v(m) WHERE ts > TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '2024-01-01' + to_months(m))"


def _auc(src: str, by: str) -> str:
    return f"(SELECT {by}, sum(p * (below + n / 2.0)) / nullif(sum(p) * sum(n), 0) AS auc FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY {by} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT {by}, score, (count(*) FILTER (label = 1))::DOUBLE AS p, (count(*) FILTER (label = 0))::DOUBLE AS n FROM {src} GROUP BY {by}, score)) GROUP BY {by})"


SQL = {
    "temporal_counts": f"WITH {_S}, {_W} SELECT window_months, count(*) AS n, CAST(sum(label) AS BIGINT) AS phishing FROM tw GROUP BY 1",
    "temporal_disjoint": f"WITH {_S} SELECT CASE WHEN ts <= TIMESTAMP '2024-01-01' THEN 0 WHEN ts <= TIMESTAMP '2024-02-01' THEN 1 WHEN ts <= TIMESTAMP '2024-07-01' THEN 6 ELSE 12 END AS window_months, count(*) AS n FROM sc WHERE ts <= TIMESTAMP '2025-01-01' GROUP BY 1",
    "decay_curve": f"WITH {_S}, {_W} SELECT window_months, round(auc, 6) AS auc FROM {_auc('(SELECT * FROM tw WHERE window_months > 0)', 'window_months')}",
    "source_matrix": f"""WITH {_S}, own AS {_auc('sc', 'source')}, held AS (SELECT DISTINCT source AS held FROM sc WHERE source IS NOT NULL), pool AS (SELECT held, score, label FROM sc JOIN held ON source <> held),
pooled AS {_auc('pool', 'held')}, mean AS (SELECT a.source, avg(b.auc) AS m FROM own a JOIN own b ON a.source <> b.source GROUP BY 1)
SELECT own.source, round(own.auc, 6) AS auc, round(pooled.auc, 6) AS others_pooled, round(m, 6) AS others_mean FROM own JOIN pooled ON own.source = pooled.held JOIN mean ON own.source = mean.source""",
    "confusion_by_split": f"WITH {_S} SELECT split, count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label = 0) AS tn FROM sc WHERE split IS NOT NULL GROUP BY 1",
    "prevalence_report": f"""WITH {_S}, c AS (SELECT source, count(*) FILTER (score >= 0.6 AND label = 1) AS tp, count(*) FILTER (score >= 0.6 AND label = 0) AS fp, count(*) FILTER (label = 1) AS np, count(*) FILTER (label = 0) AS nn FROM sc WHERE split = 'test' GROUP BY 1),
r AS (SELECT source, tp / nullif(np, 0)::DOUBLE AS tpr, fp / nullif(nn, 0)::DOUBLE AS fpr, p AS prevalence FROM c, (VALUES (0.01::DOUBLE), (0.001::DOUBLE), (0.0001::DOUBLE)) v(p))
SELECT source, prevalence, round(tpr, 8) AS tpr, round(fpr, 8) AS fpr, round(prevalence * tpr / nullif(prevalence * tpr + (1 - prevalence) * fpr, 0), 8) AS precision, round(1e6 * (prevalence * tpr + (1 - prevalence) * fpr), 4) AS alerts_per_1e6 FROM r""",
    "wilson_buckets": f"""WITH {_S}, b AS (SELECT source, count(*) AS n, count(*) FILTER (CAST(score >= 0.5 AS INT) <> label) AS errors FROM sc GROUP BY 1), c AS (SELECT *, errors / n::DOUBLE AS p, 1.96::DOUBLE AS z FROM b)
SELECT source, n, errors, round(greatest((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n), 0), 8) AS ci_lo, round(least((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n), 1), 8) AS ci_hi FROM c""",
    "roc_auc_exact": f"WITH {_S} SELECT split, round(auc, 8) AS auc FROM {_auc('(SELECT * FROM sc WHERE split IS NOT NULL)', 'split')}",
    "threshold_choice": f"""WITH {_S}, g AS (SELECT round_even(score, 4) AS threshold, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM sc GROUP BY 1),
h AS (SELECT threshold, sum(p) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) / (sum(p) OVER ())::DOUBLE AS recall, sum(n) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) / (sum(n) OVER ())::DOUBLE AS fpr FROM g),
i AS (SELECT *, 0.01::DOUBLE * recall / nullif(0.01::DOUBLE * recall + 0.99::DOUBLE * fpr, 0) AS precision FROM h WHERE recall >= 0.6)
SELECT threshold, round(recall, 8) AS recall, round(fpr, 8) AS fpr, round(precision, 8) AS precision FROM i ORDER BY i.precision DESC, threshold LIMIT 1""",
    "coverage_risk": f"""WITH {_S}, x AS (SELECT score AS s, label, h / 20::DOUBLE AS half_width FROM sc, range(9) r(h)), y AS (SELECT *, (s < 0.5::DOUBLE - half_width OR s > 0.5::DOUBLE + half_width) AS said, CAST(s >= 0.5 AS INT) <> label AS wrong FROM x)
SELECT half_width, round(count(*) FILTER (said) / count(*)::DOUBLE, 8) AS coverage, round(count(*) FILTER (said AND wrong) / nullif(count(*) FILTER (said), 0)::DOUBLE, 8) AS risk FROM y GROUP BY 1""",
    "abstention_band": f"""WITH {_S}, gr AS (SELECT unnest([0.3::DOUBLE, 0.4::DOUBLE, 0.5::DOUBLE, 0.6::DOUBLE, 0.7::DOUBLE]) AS g), x AS (SELECT a.g AS lo, b.g AS hi, score AS s, label FROM sc, gr a, gr b WHERE a.g < b.g),
r AS (SELECT lo, hi, count(*) FILTER (s < lo OR s > hi) / count(*)::DOUBLE AS coverage, count(*) FILTER ((s < lo OR s > hi) AND CAST(s > hi AS INT) <> label) / nullif(count(*) FILTER (s < lo OR s > hi), 0)::DOUBLE AS risk FROM x GROUP BY 1, 2)
SELECT lo, hi, round(coverage, 8) AS coverage, round(risk, 8) AS risk FROM r WHERE r.coverage >= 0.5 ORDER BY r.risk, hi - lo DESC, lo LIMIT 1""",
    "rank_correlation": "SELECT round(corr(a, b), 8) AS rho FROM (SELECT rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE AS b FROM part)",
    "ranking_agreement": "WITH x AS (SELECT p_brand AS k, sum(l_quantity) AS q, round(sum(l_extendedprice), 2) AS p FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), y AS (SELECT sign(a.q - b.q)::DOUBLE AS u, sign(a.p - b.p)::DOUBLE AS v FROM x a JOIN x b ON a.k < b.k) SELECT round(sum(u * v) / nullif(sqrt(sum(abs(u)) * sum(abs(v))), 0), 8) AS tau FROM y",
    "undated_rows": "SELECT source, count(*) FILTER (submission_time IS NULL) AS undated, count(*) AS n FROM run_b6_experiments GROUP BY 1",
    "gates": f"WITH {_S}, x AS (SELECT label, score AS a, (row_id % 100) / 100::DOUBLE AS b FROM sc) SELECT label, count(*) FILTER (a >= 0.5 OR b >= 0.95) AS or_gate, count(*) FILTER (a >= 0.5 OR (b >= 0.9 AND a >= 0.3)) AS and_gate, count(*) FILTER (a >= 0.5 OR (a >= 0.15 AND b >= 0.95)) AS escalated, count(*) FILTER (a >= 0.4 AND a <= 0.6) AS abstained FROM x GROUP BY 1",
    "cascade_cost": f"WITH {_S}, x AS (SELECT source, avg(CAST(score >= 0.1 AS DOUBLE)) AS routed FROM sc GROUP BY 1) SELECT source, round(routed, 8) AS routed, round(1000 / ((18.07::DOUBLE + x.routed * 3414.0::DOUBLE) / 1000), 4) AS urls_per_s FROM x",
}
