"""Drift and stability queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from siltweir.operators import drift as D
from siltweir.session import table


def psi_time(s, d):
    return D.psi_across_windows(table(s, d, "lineitem"), "l_quantity", ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], 4).select(F.round("psi_t", 8).alias("psi_t"))


def psi_source(s, d):
    return D.psi_across_sources(table(s, d, "lineitem"), "l_extendedprice", "l_returnflag").select(F.round("psi_s", 8).alias("psi_s"))


def psi_source_pairs(s, d):
    x = table(s, d, "run_b6_experiments").select("source", F.length("url").alias("len"))
    k = x.select(F.col("source").alias("expected")).distinct()
    p = k.join(k.withColumnRenamed("expected", "actual"), F.col("expected") < F.col("actual"))
    return D.psi_pairs(x, "len", "source", p).select("expected", "actual", F.round("psi", 8).alias("psi"))


def stability_rank(s, d):
    x = table(s, d, "lineitem")
    parts = [D.psi_across_sources(x, f, "l_returnflag").select(F.lit(f).alias("feature"), F.lit(0.0).alias("psi_t"), "psi_s", F.lit(0.0).alias("sigma2")) for f in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    y = D.stability(reduce(lambda a, b: a.unionByName(b), parts))
    return y.select("feature", F.round("psi_s", 8).alias("psi_s"), "is_stable", F.round("weight", 4).alias("weight"))


def topk_uncertain(s, d):
    x = table(s, d, "events").select("event_id", "event_type", F.round(F.col("value") / 100, 4).alias("score"))
    return D.most_uncertain(x, "score", "event_id", 0.02, ("event_type",)).select("event_type", "event_id")


def drift_alarms(s, d):
    x = table(s, d, "events").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.least(F.col("value") / 100, F.lit(1.0)).alias("v"))
    y = x.unionByName(x.select("event_type", (F.col("at") + 10**13).alias("at"), (F.col("v") * 0.2).alias("v")))
    return D.drift_alarms(y, "event_type", "at", "v")


QUERIES = {f.__name__: f for f in (psi_time, psi_source, psi_source_pairs, stability_rank, topk_uncertain, drift_alarms)}


def _psi(src: str, pairs: str) -> str:
    q = "[" + ", ".join(f"{i / 10}" for i in range(11)) + "]"
    return f"""ed AS (SELECT g, list_sort(list_distinct(quantile_cont(v, {q}))) AS e FROM {src} GROUP BY g), nn AS (SELECT g, count(*) AS n FROM {src} GROUP BY g),
pr AS (SELECT p.expected, p.actual, ed.e FROM {pairs} p JOIN ed ON ed.g = p.expected), fb AS (SELECT expected, actual, len(e) AS k, unnest(range(0, greatest(len(e) - 1, 1)::BIGINT)) AS b FROM pr),
bn AS (SELECT expected, actual, 'e' AS side, g, len(list_filter(e[2:len(e) - 1], lambda t: t <= v)) AS b FROM {src} JOIN pr ON g = expected UNION ALL SELECT expected, actual, 'a', g, len(list_filter(e[2:len(e) - 1], lambda t: t <= v)) FROM {src} JOIN pr ON g = actual),
sh AS (SELECT expected, actual, side, b, count(*) / any_value(n)::DOUBLE AS s FROM bn JOIN nn ON bn.g = nn.g GROUP BY 1, 2, 3, 4),
psi AS (SELECT fb.expected, fb.actual, CASE WHEN max(fb.k) >= 3 THEN sum((coalesce(a.s, 0) - coalesce(x.s, 0)) * ln((coalesce(a.s, 0) + 1e-6) / (coalesce(x.s, 0) + 1e-6))) ELSE 0 END AS psi FROM fb LEFT JOIN sh x ON x.side = 'e' AND x.expected = fb.expected AND x.actual = fb.actual AND x.b = fb.b LEFT JOIN sh a ON a.side = 'a' AND a.expected = fb.expected AND a.actual = fb.actual AND a.b = fb.b GROUP BY 1, 2)"""


def _src(feature: str) -> str:
    return f"src AS (SELECT l_returnflag AS g, {feature}::DOUBLE AS v FROM lineitem), pairs AS (SELECT DISTINCT a.l_returnflag AS expected, b.l_returnflag AS actual FROM lineitem a, (SELECT DISTINCT l_returnflag FROM lineitem) b WHERE a.l_returnflag < b.l_returnflag)"


_FEATS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
SQL = {
    "psi_time": f"WITH src AS (SELECT ntile(4) OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS g, l_quantity::DOUBLE AS v FROM lineitem), pairs AS (SELECT g AS expected, g + 1 AS actual FROM range(1, 4) r(g)), {_psi('src', 'pairs')} SELECT round(avg(psi), 8) AS psi_t FROM psi",
    "psi_source": f"WITH {_src('l_extendedprice')}, {_psi('src', 'pairs')} SELECT round(avg(psi), 8) AS psi_s FROM psi",
    "psi_source_pairs": f"WITH src AS (SELECT source AS g, length(url)::DOUBLE AS v FROM run_b6_experiments), sr AS (SELECT DISTINCT g FROM src), pairs AS (SELECT a.g AS expected, b.g AS actual FROM sr a, sr b WHERE a.g < b.g), {_psi('src', 'pairs')} SELECT expected, actual, round(psi, 8) AS psi FROM psi",
    "stability_rank": "WITH al AS ("
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, (WITH {_src(f)}, {_psi('src', 'pairs')} SELECT avg(psi) FROM psi) AS psi_s" for f in _FEATS)
    + "), st AS (SELECT *, coalesce(CASE WHEN psi_s > 0 THEN 1 / psi_s END, 1.0) AS stab FROM al) SELECT feature, round(psi_s, 8) AS psi_s, stab >= (SELECT quantile_cont(stab, 0.25) FROM st) AS is_stable, round(stab / sum(stab) OVER (), 4) AS weight FROM st",
    "topk_uncertain": "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY abs(round(value / 100, 4) - 0.5::DOUBLE), event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r <= greatest(1, round_even(n * 0.02::DOUBLE, 0))",
}
