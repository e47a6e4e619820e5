"""Lookups, cleaning, generators and further evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltweir.functions import lexical as L, tokens as K, transforms as X
from siltweir.operators import dedup as D, evaluation as E, findings as G, generate as N, lookup as U
from siltweir.session import table


def _urls(s, d):
    return table(s, d, "run_b6_experiments").select("row_id", "url", "domain", "source", "split", "label")


def confusable_letters(s, d):
    return _urls(s, d).select("row_id", X.plain_letters(F.col("url")).alias("plain"))


def threat_lookup(s, d):
    """Test addresses against the harmful ones of train as a feed; the hosts of harmless train rows are trusted."""
    x = _urls(s, d)
    feed = x.where("split = 'train' and label = 1")
    good = x.where("split = 'train' and label = 0").select(U.url_host(F.col("url")).alias("h"))
    return U.threat_hits(x.where("split = 'test'").select("row_id", "url"), "url", feed, "url", good).select("row_id", "threat")


def domain_owners(s, d):
    """Owner: the source that lists a domain most; hosts below it belong to it, too."""
    x = table(s, d, "run_axis_s").where("domain is not null and source is not null").groupBy(F.lower("domain").alias("domain"), "source").agg(F.count("*").alias("n"))
    owned = x.groupBy("domain").agg(F.min_by("source", F.struct(-F.col("n"), F.col("source"))).alias("owner"))
    hosts = table(s, d, "run_axis_s").select("row_id", F.lower(U.url_host(F.col("url"))).alias("host")).where("host <> ''")
    return U.owners(hosts, "host", owned).groupBy("owner").agg(F.count("*").alias("n"))


def fetch_targets(s, d):
    return _urls(s, d).groupBy(U.target_error(F.col("url")).alias("error")).agg(F.count("*").alias("n"))


def finding_order(s, d):
    x = table(s, d, "events").select("user_id", "event_id", ((F.col("value") - 50) / 20).alias("weight"))
    return G.ordered(x, "user_id", "weight", "event_id").select("user_id", "event_id", "position")


def recall_transforms(s, d):
    score = lambda u: F.round(F.least(F.lit(1.0), F.length(u) / 150), 4)
    names = ("subdomain_padding", "path_padding", "tld_swap", "hyphenated_brand_insertion", "shortener_wrap")
    x = E.recall_under_transforms(_urls(s, d), "url", "label", "row_id", score, {n: X.TRANSFORMS[n] for n in names}, 0.6)
    return x.select("transform", F.round("recall", 8).alias("recall"), F.round("delta", 8).alias("delta"))


def operating_points(s, d):
    x = table(s, d, "run_b6_experiments").select("label", F.round(F.least(F.lit(1.0), F.length("url") / 150), 4).alias("score"))
    return E.operating_points(x, "score", "label", (0.4, 0.7)).select("threshold", F.round("recall", 8).alias("recall"), F.round("fpr", 8).alias("fpr"), "n")


def path_sensitivity(s, d):
    """Mean score of each source's addresses as they are and without their path, on the same rows."""
    score = lambda u: F.round(F.least(F.lit(1.0), F.length(u) / 150), 4)
    bare = F.regexp_replace("url", r"^([a-z]+://[^/?#]*).*$", "$1")
    x = _urls(s, d).select("source", score(F.col("url")).alias("whole"), score(bare).alias("bare"))
    return x.groupBy("source").agg(F.round(F.avg("whole"), 6).alias("whole"), F.round(F.avg("bare"), 6).alias("bare"), F.count_if(F.col("whole") >= 0.5).alias("over"), F.count_if(F.col("bare") >= 0.5).alias("bare_over"))


def path_matched(s, d):
    """400 harmful rows of which exactly a quarter have a path."""
    x = _urls(s, d).where("label = 1").withColumn("path", F.col("url").rlike(r"^[a-z]+://[^/?#]+/[^?#]"))
    return E.share_sample(x.select("row_id", "path"), F.col("path"), "row_id", 0.25, 400)


def dedup_frames(s, d):
    """Rows, and mean length, of each source before and after near duplicates are dropped."""
    x = table(s, d, "run_axis_s").where("url is not null and source is not null").select("row_id", "url", "source")
    y = D.dedup_frame(x, "row_id", "url")
    n = lambda df, c: df.groupBy("source").agg(F.count("*").alias(c))
    return n(x, "n_before").join(n(y, "n_after"), "source", "left").select("source", "n_before", F.coalesce("n_after", F.lit(0)).alias("n_after"))


def typo_variants(s, d):
    x = table(s, d, "run_b6_experiments").where("domain is not null").groupBy("domain").agg(F.min("row_id").alias("row_id"))
    return N.typo_variants(x, "row_id", "domain").select("row_id", "kind", "variant")


def path_augmented(s, d):
    return N.with_paths(_urls(s, d).where("label = 0"), "row_id", "url").groupBy("source").agg(F.count_if(F.col("augmented") != F.col("url")).alias("changed"), F.count_if(F.col("augmented").startswith("http:")).alias("plain_http"), F.sum(F.length("augmented")).alias("size"))


def smoke_corpus(s, d):
    return N.smoke_corpus(s).groupBy("source", "label").agg(F.count("*").alias("n"), F.sum("domain_age_days").alias("age"), F.count("rank").alias("ranked"))


def provenance(s, d):
    """Columns of the table by what they come from: of the address itself, of lookups, of nothing known."""
    frame = L.lexical(_urls(s, d).select("row_id", "url"), "url", ["test"], fuzzy=False)
    names = frame.columns
    kind = {c: "address" if c in L.FEATURES else "lookup" if c in K.LOOKED_UP else "unknown" for c in names}
    kept = frame.select(*[c for c in names if kind[c] == "address"])
    total = kept.agg(*[F.sum(F.col(c).cast("double")).alias(c) for c, t in kept.dtypes if t == "int"])
    long = total.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("total")) for c in total.columns])).alias("v")).select("v.column", "v.total")
    return long.where(F.col("column").isin("url_length", "num_dots", "num_hyphens", "num_digits", "num_slashes"))


def permutation_slices(s, d):
    """Rows in an order drawn from their key, cut into slices of 500."""
    from siltweir.operators.ordered import ranked
    from siltweir.operators.relational import hashed

    x = table(s, d, "orders").select("o_orderkey").withColumn("h", hashed(F.col("o_orderkey"), 3))
    return ranked(x, ["h", "o_orderkey"], "r").select("o_orderkey", F.floor((F.col("r") - 1) / 500).alias("slice"))


def map_sums(s, d):
    """Counts by event type as a map: its sum and one key with a default."""
    m = table(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return m.select("user_id", F.aggregate(F.map_values("m"), F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total"), F.coalesce(F.try_element_at("m", F.lit("click")), F.lit(0)).alias("clicks"))


QUERIES = {f.__name__: f for f in (confusable_letters, threat_lookup, domain_owners, fetch_targets, finding_order, recall_transforms, operating_points, path_sensitivity, path_matched, dedup_frames, typo_variants, path_augmented, smoke_corpus, provenance, permutation_slices, map_sums)}
_HOST = r"lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(trim(url, ' '), '^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?', 2), '^.*@', ''), ':[^:\]]*$', ''), '^\[|\]$', '', 'g'))"
_KEY = "lower(rtrim(regexp_replace(url, '^ +| +$', '', 'g'), '/'))"
_SEV = "CASE WHEN w <= -0.01 THEN 6 WHEN w >= 3 THEN 1 WHEN w >= 1.5 THEN 2 WHEN w >= 0.6 THEN 3 WHEN w >= 0.01 THEN 4 ELSE 5 END"
_BARE = r"regexp_replace(url, '^([a-z]+://[^/?#]*).*$', '\1')"
SQL = {
    "confusable_letters": "SELECT row_id, translate(url, '" + K.CONFUSABLE_FROM.replace("'", "''") + "', '" + K.CONFUSABLE_TO.replace("'", "''") + "') AS plain FROM run_b6_experiments",
    "threat_lookup": f"""WITH f AS (SELECT DISTINCT {_KEY} AS k FROM run_b6_experiments WHERE split = 'train' AND label = 1), g AS (SELECT DISTINCT {_HOST} AS h FROM run_b6_experiments WHERE split = 'train' AND label = 0),
h AS (SELECT DISTINCT {_HOST} AS h FROM run_b6_experiments WHERE split = 'train' AND label = 1 EXCEPT SELECT h FROM g)
SELECT row_id, CASE WHEN {_KEY} IN (SELECT k FROM f) THEN 'address' WHEN {_HOST} <> '' AND {_HOST} IN (SELECT h FROM h WHERE h <> '') THEN 'host' END AS threat FROM run_b6_experiments WHERE split = 'test'""",
    "finding_order": f"WITH a AS (SELECT user_id, event_id, (value - 50) / 20 AS w FROM events) SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY {_SEV}, abs(w) DESC, event_id) AS INT) AS position FROM a",
    "operating_points": "WITH a AS (SELECT label, round(least(1.0::DOUBLE, length(url) / 150::DOUBLE), 4) AS s FROM run_b6_experiments WHERE url IS NOT NULL) SELECT t AS threshold, round(count(*) FILTER (s >= t AND label = 1) / (count(*) FILTER (label = 1))::DOUBLE, 8) AS recall, round(count(*) FILTER (s >= t AND label = 0) / (count(*) FILTER (label = 0))::DOUBLE, 8) AS fpr, count(*) AS n FROM a, (VALUES (0.4::DOUBLE), (0.7::DOUBLE)) v(t) GROUP BY 1",
    "path_sensitivity": f"WITH a AS (SELECT source, round(least(1.0::DOUBLE, length(url) / 150::DOUBLE), 4) AS x, round(least(1.0::DOUBLE, length({_BARE}) / 150::DOUBLE), 4) AS y FROM run_b6_experiments) SELECT source, round(avg(x), 6) AS whole, round(avg(y), 6) AS bare, count(*) FILTER (x >= 0.5) AS over, count(*) FILTER (y >= 0.5) AS bare_over FROM a GROUP BY 1",
    "path_matched": r"""WITH a AS (SELECT row_id, regexp_matches(url, '^[a-z]+://[^/?#]+/[^?#]') AS path, (row_id * 1103515245 + 12345) % 2147483647 AS h FROM run_b6_experiments WHERE label = 1 AND url IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY h, row_id) AS r FROM a) SELECT row_id, path FROM b WHERE r <= CASE WHEN path THEN 100 ELSE 300 END""",
    "permutation_slices": "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY (o_orderkey * (1103515245 + 6) + 12348) % 2147483647, o_orderkey) - 1) // 500 AS BIGINT) AS slice FROM orders",
    "map_sums": "SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'click') AS clicks FROM events GROUP BY 1",
    "provenance": "SELECT unnest(['url_length', 'num_dots', 'num_hyphens', 'num_digits', 'num_slashes']) AS column, unnest([sum(length(url)), sum(length(url) - length(replace(url, '.', ''))), sum(length(url) - length(replace(url, '-', ''))), sum(length(url) - length(regexp_replace(url, '[\\p{Nd}²³¹⁰⁴-⁹₀-₉]', '', 'g'))), sum(length(url) - length(replace(url, '/', '')))])::DOUBLE AS total FROM run_b6_experiments",
}
