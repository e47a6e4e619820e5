"""Page parsing over fetched bodies, findings and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltweir.functions import hosts
from siltweir.functions.decode import body_text
from siltweir.operators import findings as G
from siltweir.operators import page as P
from siltweir.session import table


def _pages(s, d):
    """All fetches with a body, read in the charset that its type names; the parser tells whether it is a page."""
    x = table(s, d, "fetch_results").where("body is not null")
    x = x.select("fetch_id", body_text(F.col("body"), F.col("content_type")).alias("html"), F.coalesce("final_url", "requested_url").alias("url"), "content_type")
    return P.parse(x, "fetch_id", "html", "url", "content_type", hosts.suffix_list(table(s, d, "public_suffix")))


def page_signals(s, d):
    x = P.signals(_pages(s, d))
    flat = [F.to_json(c).alias(c) if t.startswith("array<struct") else F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in x.dtypes]
    return x.select(*flat)


def page_titles(s, d):
    return _pages(s, d).where("is_html").select(F.col("page_key").alias("fetch_id"), "title")


def login_language(s, d):
    x = table(s, d, "page_analysis")
    head = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("text_excerpt", F.lit("")))
    return x.groupBy(head.rlike(P.LOGIN_WORDS).alias("words"), "login_language").agg(F.count("*").alias("n"))


def finding_score(s, d):
    """Findings from the flags of analysed pages, long form, then one score a page."""
    x = table(s, d, "page_analysis")
    f = F.filter(F.array(
        F.when(F.col("provider_takedown"), F.struct(F.lit("takedown").alias("id"), F.lit(1.5).alias("weight"))), F.when(F.col("has_password"), F.struct(F.lit("password").alias("id"), F.lit(1.2).alias("weight"))),
        F.when(F.col("dead_link_ratio") >= 0.6, F.struct(F.lit("dead_links").alias("id"), F.lit(0.6).alias("weight"))), F.when(F.col("login_language"), F.struct(F.lit("login").alias("id"), F.lit(0.8).alias("weight"))),
        F.when(F.col("parked"), F.struct(F.lit("parked").alias("id"), F.lit(-0.6).alias("weight"))),
    ), lambda z: z.isNotNull())
    long = x.select("page_id", F.explode_outer(f).alias("f")).select("page_id", F.coalesce("f.id", F.lit("none")).alias("id"), F.coalesce("f.weight", F.lit(0.0)).alias("weight"))
    return G.combine(long, "page_id", "weight").select("page_id", "risk", "verdict")


def severity_counts(s, d):
    w = F.round((F.col("value") - 50) / 20, 2)
    return table(s, d, "events").groupBy(G.severity(w).alias("severity")).agg(F.count("*").alias("n"))


def age_bins(s, d):
    days = F.datediff(F.lit("1998-12-31"), F.col("o_orderdate"))
    return table(s, d, "orders").groupBy(G.age_weight(days).alias("weight")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (page_signals, page_titles, login_language, finding_score, severity_counts, age_bins)}
_LW = P.LOGIN_WORDS.replace("'", "''")
_SUM = "round((coalesce(CAST(provider_takedown AS INT), 0) * 1.5::DOUBLE + coalesce(CAST(has_password AS INT), 0) * 1.2::DOUBLE + coalesce(CAST(dead_link_ratio >= 0.6 AS INT), 0) * 0.6::DOUBLE + coalesce(CAST(login_language AS INT), 0) * 0.8::DOUBLE - coalesce(CAST(parked AS INT), 0) * 0.6::DOUBLE), 10)"
SQL = {
    "login_language": f"SELECT regexp_matches(coalesce(title, '') || ' ' || coalesce(text_excerpt, ''), '{_LW}') AS words, login_language, count(*) AS n FROM page_analysis GROUP BY 1, 2",
    "finding_score": f"WITH a AS (SELECT page_id, CAST(least(greatest(round_even(100 / (1 + exp(-(-1.4::DOUBLE + {_SUM}))), 0), 1), 99) AS INT) AS risk FROM page_analysis) SELECT page_id, risk, CASE WHEN risk >= 70 THEN 'phishing' WHEN risk >= 40 THEN 'suspicious' ELSE 'safe' END AS verdict FROM a",
    "severity_counts": "WITH a AS (SELECT round((value - 50) / 20, 2) AS w FROM events) SELECT CASE WHEN w <= -0.01 THEN 'good' WHEN w >= 3 THEN 'critical' WHEN w >= 1.5 THEN 'high' WHEN w >= 0.6 THEN 'medium' WHEN w >= 0.01 THEN 'low' ELSE 'info' END AS severity, count(*) AS n FROM a GROUP BY 1",
    "age_bins": "WITH a AS (SELECT date_diff('day', o_orderdate, TIMESTAMP '1998-12-31') AS d FROM orders) SELECT CASE WHEN d <= 7 THEN 3.0 WHEN d <= 30 THEN 2.0 WHEN d <= 90 THEN 1.2 WHEN d <= 365 THEN 0.4 WHEN d >= 3650 THEN -1.5 WHEN d >= 1825 THEN -1.0 WHEN d >= 730 THEN -0.5 ELSE 0.0 END::DOUBLE AS weight, count(*) AS n FROM a GROUP BY 1",
}
