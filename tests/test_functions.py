from pyspark.sql import functions as F

from siltweir.functions import hosts, hosts as H, lexical as L, tokens as K, transforms as X

SUFFIXES = ["com", "org", "net", "co.uk", "uk", "tk", "io", "ly", "com.example", "example", "webs.top.test", "test"]


def _one(spark, df_expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{c} string" for c in cols))
    return df.select(df_expr).first()[0]


def test_registrable(spark):
    rows = [("a.b.com.example", "b.com.example"), ("com.example", None), ("x.webs.top.test", "x.webs.top.test"), ("top.test", "top.test"), ("10.0.0.1", None), ("localhost", None), ("", None), (None, None), ("a b.com", None)]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(rows)], "i int, h string")
    got = {r.i: r.r for r in df.select("i", hosts.registrable(F.col("h"), SUFFIXES).alias("r")).collect()}
    assert [got[i] for i in range(len(rows))] == [w for _, w in rows]


def test_entity_from_domain_or_url(spark):
    rows = [
        ("WWW.Shop.com.example.", None, "shop.com.example"),
        ("xn--caf-dma.com.example", None, "café.com.example"),
        ("n/a", "http://u:p@a.b.com.example:8443/x", "b.com.example"),
        ("localhost", "https://help.com.example@evil.test/", "evil.test"),
        (" b.test ", None, "b.test"),
        (None, None, None),
    ]
    df = spark.createDataFrame([(i, d, u) for i, (d, u, _) in enumerate(rows)], "i int, d string, u string")
    got = {r.i: r.e for r in hosts.with_entity(df, "d", "u", "e", SUFFIXES).collect()}
    assert [got[i] for i in range(len(rows))] == [w for *_, w in rows]


def test_repair(spark):
    good = {
        "HTTPS://WWW.GOOGLE.COM/": "https://www.google.com", "example.com:8080/path": "https://example.com:8080/path", "hxxps://evil[.]tk/login": "https://evil.tk/login",
        "http://www.paypal.com@evil-site.tk/login": "http://www.paypal.com@evil-site.tk/login", " <http://a.com> ": "http://a.com",
    }
    bad = {"": "empty", "  ": "empty", "hello world": "no_host", "not-a-domain": "incomplete", "ftp://files.example.com": "opaque", "javascript:alert(1)": "opaque"}
    df = spark.createDataFrame([(k,) for k in [*good, *bad]], "raw string")
    got = {r.raw: (r.repaired, r.error) for r in X.repair(df, "raw").collect()}
    assert {k: got[k][0] for k in good} == good
    assert {k: got[k] for k in bad} == {k: (None, e) for k, e in bad.items()}


def test_squatting(spark):
    urls = {"https://google.com": 0.245, "https://icicibank.com/personal-banking/accounts/savings-account": 0.502, "https://bbc.co.uk/news": 0.0}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: round(r.squat, 3) for r in L.squatting(L.lexical(df, "url", SUFFIXES)).collect()}
    assert got == urls


def test_lexical_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "k int, url string")
    got = {r.k: r for r in L.lexical(df, "url", SUFFIXES).collect()}
    assert got[1].url_length is None and got[1].entropy_url is None
    assert got[2].url_length == 0 and got[2].special_ratio == 1.0 and got[2].entropy_url == 0.0
    assert [c for c in got[2].asDict() if c not in ("k", "url")] == L.FEATURES and len(L.FIRST_33) == 33


def test_fuzzy_brand(spark):
    hits = {"paypa1": True, "arnaz0n": True, "goog2e": True, "paypal": False, "apple": False, "sbin": False, "abc": False}
    df = spark.createDataFrame([(k,) for k in hits], "l string")
    got = {r.l: bool(r.h) for r in df.select("l", L.fuzzy_brands(F.array("l"), F.lit("")).alias("h")).collect()}
    assert got == hits
    # the forms lose nothing against all brands one by one
    lev = lambda a, b: spark.range(1).select(F.levenshtein(F.lit(a), F.lit(b))).first()[0]
    for w in ("bankofamrica", "wellsfarg0", "unionbnak", "rnicrosoft", "clropbox"):
        far = {b for b in K.BRANDS_EXTENDED if b not in K.ACRONYMS and abs(len(b) - len(w)) <= 2 and lev(w, b) <= (1 if len(b) <= 8 else 2)}
        assert far <= set(L.near_brands(w)) and L.near_brands(w)


def test_long_suffix_list(spark):
    listed = [f"s{i}.test" for i in range(10_000)] + ["test", "co.uk"]
    hosts = {"a.b.s77.test": "b.s77.test", "s77.test": None, "x.test": "x.test", "www.a.co.uk": "a.co.uk", "co.uk": None, "a.b.other": "b.other", "one": None, "1.2.3.4": None, "a..test": None, "a.test.": None}
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    assert {r.h: r.d for r in df.select("h", H.registrable(F.col("h"), listed).alias("d")).collect()} == hosts


def test_transforms(spark):
    df = spark.createDataFrame([(1, "https://www.site.com/a/b?q=1#f")], "k long, url string")
    r = df.select(*[X.transform(F.col("url"), F.col("k"), n).alias(n) for n in X.TRANSFORMS]).first()
    assert r.subdomain_padding.endswith(".www.site.com/a/b?q=1#f") and len(r.subdomain_padding.split(".")) == 6
    assert r.path_padding.startswith("https://www.site.com/a/b/") and len(r.path_padding) == len("https://www.site.com/a/b/?q=1#f") + 40
    assert r.tld_swap != "https://www.site.com/a/b?q=1#f" and r.tld_swap.startswith("https://www.site.c")
    assert "-secure-www.site.com" in r.hyphenated_brand_insertion
    assert any(r.shortener_wrap.startswith(f"https://{h}/") for h in K.EVASION_SHORTENERS)
    try:
        X.transform(F.col("url"), F.col("k"), "nope")
        raise AssertionError
    except ValueError:
        pass
