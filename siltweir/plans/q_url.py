"""Queries on addresses: parsing, lexical columns, repair, rules, transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltweir.functions import hosts, lexical as L, tokens as K, transforms as X
from siltweir.session import table

RE = hosts.URL_RE.replace("'", "''")
_U = "CASE WHEN contains(url, '//') THEN url ELSE '//' || url END"


def _urls(spark, sf):
    return table(spark, sf, "run_b6_experiments").select("row_id", "url", "label", "source", "split")


def _icann(spark, sf):
    return hosts.suffix_list(table(spark, sf, "public_suffix"), ("icann",))


def _host(url):
    """The host as it stands, in lower case."""
    return F.lower(hosts.url_host(url))


def url_lexical(spark, sf):
    x = L.lexical(_urls(spark, sf).select("row_id", "url"), "url", _icann(spark, sf), fuzzy=False).drop("url")
    return x.select("row_id", *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in x.dtypes if c != "row_id"])


def url_fuzzy(spark, sf):
    """The three brand and bait columns added later, and the squatting score."""
    x = L.squatting(L.lexical(_urls(spark, sf).select("row_id", "url"), "url", _icann(spark, sf)))
    return x.select("row_id", "num_brand_tokens_fuzzy", "num_brand_tokens_extended", "num_suspicious_tokens_extended", F.round("squat", 6).alias("squat"))


def url_registrable(spark, sf):
    s = hosts.suffix_list(table(spark, sf, "public_suffix"))
    x = _urls(spark, sf).select("row_id", _host(F.col("url")).alias("host"))
    return x.select("row_id", "host", hosts.registrable(F.col("host"), s).alias("registrable"), hosts.registrable(F.col("host"), _icann(spark, sf)).alias("icann_domain"))


def url_spelled_hosts(spark, sf):
    """Hosts in one spelling (percent and punycode decoded, wide and invisible characters undone), their registrable domain
    and how many addresses name them, over all rows."""
    s = hosts.suffix_list(table(spark, sf, "public_suffix"))
    h = hosts.spelled(hosts.url_host(F.col("url")))
    return _urls(spark, sf).groupBy(h.alias("host")).agg(F.count("*").alias("urls")).select("host", "urls", hosts.registrable(F.col("host"), s).alias("registrable"))


def url_host_profile(spark, sf):
    return _urls(spark, sf).groupBy(_host(F.col("url")).alias("host")).agg(F.count("*").alias("urls"), F.round(F.avg(F.length("url")), 6).alias("avg_length"), F.sum("label").alias("phishing"), F.countDistinct("source").alias("sources"))


def url_repair(spark, sf):
    x = _urls(spark, sf)
    raw = F.when(F.pmod("row_id", F.lit(5)) == 0, F.concat(F.lit(" <"), F.regexp_replace("url", "^http", "hxxp"), F.lit("> "))).when(F.pmod("row_id", F.lit(5)) == 1, F.regexp_replace("url", r"^https?://", "")).otherwise(F.col("url"))
    return X.repair(x.select("row_id", raw.alias("raw")), "raw").select("row_id", "repaired", "error")


def url_has_path(spark, sf):
    p = F.trim(hosts.url_part(F.col("url"), 3), F.lit("/")) != ""
    return _urls(spark, sf).groupBy("source", p.alias("has_path")).agg(F.count("*").alias("n"))


def url_feed_key(spark, sf):
    return _urls(spark, sf).groupBy(X.feed_key(F.col("url")).alias("feed_key")).agg(F.count("*").alias("n")).where("n > 1")


def evasion_structural(spark, sf):
    x = _urls(spark, sf)
    return x.select("row_id", *[X.transform(F.col("url"), F.col("row_id"), n).alias(n) for n in ("subdomain_padding", "path_padding", "tld_swap", "hyphenated_brand_insertion", "shortener_wrap")])


def evasion_characters(spark, sf):
    x = _urls(spark, sf)
    return x.select("row_id", *[X.transform(F.col("url"), F.col("row_id"), n).alias(n) for n in ("homoglyph", "percent_encoding")])


def base64_key(spark, sf):
    k = F.rtrim(F.translate(F.base64(F.encode("url", "UTF-8")), "+/\r\n", "-_"), F.lit("="))
    return _urls(spark, sf).select("row_id", k.alias("key"))


def provenance_columns(spark, sf):
    """Columns by provenance class: lexical, looked up, content."""
    return spark.createDataFrame([(f, "later" if f in L.LATER else "first") for f in L.FEATURES], "feature string, class string").groupBy("class").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (url_lexical, url_fuzzy, url_registrable, url_spelled_hosts, url_host_profile, url_repair, url_has_path, url_feed_key, evasion_structural, evasion_characters, base64_key, provenance_columns)}


def _cnt(c: str, col: str = "url") -> str:
    return f"CAST(length({col}) - length(replace({col}, '{c}', '')) AS INT)"


def _cls(p: str, col: str = "url") -> str:
    return f"CAST(length({col}) - length(regexp_replace({col}, '{p}', '', 'g')) AS INT)"


def _has(words, col="lower(url)") -> str:
    return " + ".join(f"CAST(contains({col}, '{w}') AS INT)" for w in words)


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_ENT = "CASE WHEN length({c}) > 0 THEN round(-list_sum(list_transform(list_distinct(regexp_extract_all({c}, '(?s).')), lambda k: (length({c}) - length(replace({c}, k, ''))) / length({c})::DOUBLE * log2((length({c}) - length(replace({c}, k, ''))) / length({c})::DOUBLE))), 6) ELSE 0.0 END"

PARTS = rf"""
WITH sfx AS (SELECT list(lower(suffix)) AS s FROM public_suffix WHERE section = 'icann'),
a AS (SELECT row_id, url, regexp_extract({_U}, '{RE}', 1) AS scheme, regexp_extract({_U}, '{RE}', 2) AS netloc, regexp_extract({_U}, '{RE}', 3) AS path, regexp_extract({_U}, '{RE}', 4) AS query, regexp_extract({_U}, '{RE}', 5) AS fragment FROM run_b6_experiments WHERE url IS NOT NULL),
b AS (SELECT *, regexp_replace(netloc, '^.*@', '') AS hp FROM a),
c AS (SELECT *, regexp_extract(hp, ':([^:\]]*)$', 1) AS port, lower(regexp_replace(regexp_replace(hp, ':[^:\]]*$', ''), '^\[|\]$', '', 'g')) AS host FROM b),
d AS (SELECT *, regexp_full_match(host, '\d{{1,3}}(\.\d{{1,3}}){{3}}') AS ip, string_split(host, '.') AS hl FROM c),
e AS (SELECT d.*, CASE WHEN ip THEN NULL ELSE list_min(list_filter(range(1, len(hl) + 1), lambda i: list_contains(s, array_to_string(hl[i:], '.')))) END AS pos FROM d, sfx),
f AS (SELECT *, CASE WHEN pos IS NULL THEN '' ELSE array_to_string(hl[pos:], '.') END AS suffix, CASE WHEN ip THEN [host] WHEN pos IS NULL THEN hl ELSE hl[:pos - 1] END AS rest FROM e),
g AS (SELECT *, CASE WHEN len(rest) = 0 THEN '' ELSE rest[-1] END AS lab, CASE WHEN ip OR len(rest) < 2 THEN '' ELSE array_to_string(rest[:-2], '.') END AS sub, CASE WHEN ip OR len(rest) < 2 THEN [] ELSE list_filter(rest[:-2], lambda x: x <> '') END AS labels FROM f),
h AS (SELECT *, list_concat([lab], labels) AS base FROM g),
x AS (SELECT *, list_concat(base, flatten(list_transform(base, lambda b: list_filter(string_split(b, '-'), lambda p: p <> '' AND p <> b)))) AS alllabels, list_filter(regexp_split_to_array(url, '[/.\-_?=&]+'), lambda t: t <> '') AS words FROM h)
"""

_REST_FIX = PARTS.replace("rest[:-2]", "rest[:len(rest) - 1]")

SQL = {
    "url_lexical": _REST_FIX
    + rf"""
SELECT row_id, CAST(length(url) AS INT) AS url_length, CAST(length(host) AS INT) AS hostname_length, CAST(length(path) AS INT) AS path_length, CAST(length(query) AS INT) AS query_length, CAST(length(fragment) AS INT) AS fragment_length,
{_cnt('.')} AS num_dots, {_cnt('-')} AS num_hyphens, {_cnt('_')} AS num_underscores, {_cnt('/')} AS num_slashes, {_cls('[\\p{Nd}²³¹⁰⁴-⁹₀-₉]')} AS num_digits,
{_cnt('=')} AS num_equal, {_cnt('@')} AS num_at, {_cnt('&')} AS num_ampersand, {_cnt('%')} AS num_percent, {_cnt('?')} AS num_question,
CAST(len(list_filter(string_split(query, '&'), lambda p: p <> '')) AS INT) AS num_params, CAST(len(labels) AS INT) AS num_subdomains,
{_ENT.format(c='url')} AS entropy_url, {_ENT.format(c='host')} AS entropy_hostname,
round({_cls('[\\p{Nd}²³¹⁰⁴-⁹₀-₉]')} / greatest(length(url), 1)::DOUBLE, 6) AS digit_ratio, round({_cls('\\p{L}')} / greatest(length(url), 1)::DOUBLE, 6) AS letter_ratio,
round((greatest(length(url), 1) - {_cls('[\\p{Nd}²³¹⁰⁴-⁹₀-₉]')} - {_cls('\\p{L}')}) / greatest(length(url), 1)::DOUBLE, 6) AS special_ratio,
CAST(ip AS INT) AS has_ip_literal, CAST(lower(scheme) = 'https' AS INT) AS has_https, CAST(port <> '' AS INT) AS has_port, CAST(list_contains({_list(K.SHORTENERS)}, lab || '.' || suffix) AS INT) AS is_shortener,
CAST({_has(K.SUSPICIOUS)} AS INT) AS num_suspicious_tokens, CAST({_has(K.BRANDS)} AS INT) AS num_brand_tokens,
CAST(len(list_filter(alllabels, lambda v: list_contains({_list(K.BRANDS_EXTENDED)}, lower(v)))) AS INT) AS num_brand_tokens_extended,
CAST({_has(K.SUSPICIOUS_EXTENDED)} AS INT) AS num_suspicious_tokens_extended, CAST(({_has(K.BRANDS, 'lower(sub)')}) > 0 AS INT) AS brand_in_subdomain,
CAST(length(suffix) AS INT) AS tld_length, CAST(list_contains({_list(K.COMMON_TLDS)}, suffix) AS INT) AS tld_is_common,
CAST(coalesce(list_max(list_transform(words, lambda t: length(t))), 0) AS INT) AS longest_word_length,
CASE WHEN len(words) > 0 THEN round(list_sum(list_transform(words, lambda t: length(t)))::DOUBLE / len(words), 6) ELSE 0.0 END AS avg_token_length
FROM x""",
    "url_registrable": rf"""
WITH s AS (SELECT list(lower(suffix)) AS al, list(lower(suffix)) FILTER (section = 'icann') AS ic FROM public_suffix),
a AS (SELECT row_id, regexp_replace(regexp_extract(trim(url, ' '), '{RE}', 2), '^.*@', '') AS hp FROM run_b6_experiments),
b AS (SELECT row_id, lower(regexp_replace(regexp_replace(hp, ':[^:\]]*$', ''), '^\[|\]$', '', 'g')) AS host FROM a),
c AS (SELECT row_id, host, string_split(host, '.') AS l, regexp_matches(host, '\s|\.\.|:|^\d{{1,3}}(\.\d{{1,3}}){{3}}$') AS unfit, al, ic FROM b, s),
d AS (SELECT *, coalesce(list_min(list_filter(range(1, len(l) + 1), lambda i: list_contains(al, array_to_string(l[i:], '.')))), len(l)) AS p, coalesce(list_min(list_filter(range(1, len(l) + 1), lambda i: list_contains(ic, array_to_string(l[i:], '.')))), len(l)) AS q FROM c)
SELECT row_id, host, CASE WHEN NOT unfit AND p > 1 THEN array_to_string(l[p - 1:], '.') END AS registrable, CASE WHEN NOT unfit AND q > 1 THEN array_to_string(l[q - 1:], '.') END AS icann_domain FROM d""",
    "url_host_profile": rf"""
WITH a AS (SELECT *, regexp_replace(regexp_extract(trim(url, ' '), '{RE}', 2), '^.*@', '') AS hp FROM run_b6_experiments)
SELECT lower(regexp_replace(regexp_replace(hp, ':[^:\]]*$', ''), '^\[|\]$', '', 'g')) AS host, count(*) AS urls, round(avg(length(url)), 6) AS avg_length, CAST(sum(label) AS BIGINT) AS phishing, count(DISTINCT source) AS sources FROM a GROUP BY 1""",
    "url_has_path": rf"SELECT source, trim(regexp_extract(url, '{RE}', 3), '/') <> '' AS has_path, count(*) AS n FROM run_b6_experiments GROUP BY ALL",
    "url_feed_key": "SELECT lower(rtrim(regexp_replace(url, '^ +| +$', '', 'g'), '/')) AS feed_key, count(*) AS n FROM run_b6_experiments GROUP BY 1 HAVING count(*) > 1",
    "base64_key": "SELECT row_id, rtrim(translate(base64(encode(url)), '+/', '-_'), '=') AS key FROM run_b6_experiments",
    "provenance_columns": f"SELECT * FROM (VALUES ('first', {len(L.FIRST_33)}::BIGINT), ('later', {len(L.LATER)}::BIGINT)) t(class, n)",
}

_FZ = f"""EXISTS(SELECT 1 FROM br WHERE b <> l AND (
 (abs(length(sk) - length(b)) <= 1 AND levenshtein(sk, b) <= 1) OR (abs(length(l) - length(b)) <= 2 AND levenshtein(l, b) <= CASE WHEN length(b) <= 8 THEN 1 ELSE 2 END))
 AND NOT (list_contains({_list(K.BRANDS)}, b) AND contains(lu, b)))"""
_SK = "translate(replace(replace(replace(replace(l, 'rn', 'm'), 'vv', 'w'), 'cl', 'd'), 'ii', 'u'), '" + K.LOOKALIKE_FROM + "', '" + K.LOOKALIKE_TO + "')"
SQL["url_fuzzy"] = (
    _REST_FIX
    + f""", br AS (SELECT unnest({_list([b for b in K.BRANDS_EXTENDED if b not in K.ACRONYMS])}) AS b),
y AS (SELECT row_id, lower(url) AS lu, lower(unnest(alllabels)) AS l FROM x),
z AS (SELECT DISTINCT lu, l, {_SK} AS sk FROM y WHERE length(l) >= 4),
w AS (SELECT DISTINCT z.lu, z.l FROM z JOIN br ON b <> l AND abs(length(l) - length(b)) <= 3 AND ((abs(length(sk) - length(b)) <= 1 AND levenshtein(sk, b) <= 1) OR (abs(length(l) - length(b)) <= 2 AND levenshtein(l, b) <= CASE WHEN length(b) <= 8 THEN 1 ELSE 2 END)) AND NOT (list_contains({_list(K.BRANDS)}, b) AND contains(lu, b))),
v AS (SELECT row_id, count(w.l) AS n FROM y LEFT JOIN w ON y.lu = w.lu AND y.l = w.l GROUP BY row_id),
u AS (SELECT x.row_id, CAST(v.n AS INT) AS fz, CAST(len(list_filter(alllabels, lambda k: list_contains({_list(K.BRANDS_EXTENDED)}, lower(k)))) AS INT) AS ext, CAST({_has(K.SUSPICIOUS_EXTENDED)} AS INT) AS se, CAST({_has(K.SUSPICIOUS)} AS INT) AS su, CAST({_has(K.BRANDS)} AS INT) AS nb, CAST(({_has(K.BRANDS, 'lower(sub)')}) > 0 AS INT) AS bs, CAST(list_contains({_list(K.SHORTENERS)}, lab || '.' || suffix) AS INT) AS sh, {_cnt('-')} AS hy FROM x JOIN v ON x.row_id = v.row_id)
SELECT row_id, fz AS num_brand_tokens_fuzzy, ext AS num_brand_tokens_extended, se AS num_suspicious_tokens_extended,
round(greatest(1.0 * bs, CASE WHEN fz > 0 THEN 1.0 ELSE 0.0 END, CASE WHEN nb > 0 THEN 0.7 ELSE 0.0 END, CASE WHEN ext > 0 THEN 0.65 ELSE 0.0 END)::DOUBLE * (0.35::DOUBLE + 0.35::DOUBLE * least(1.0::DOUBLE, 0.35::DOUBLE * su + 0.25::DOUBLE * se) + 0.30::DOUBLE * least(1.0::DOUBLE, 0.30::DOUBLE * sh + 0.12::DOUBLE * least(hy, 4))), 6) AS squat FROM u"""
)
