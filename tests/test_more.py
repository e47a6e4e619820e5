"""Ordered sums, cleaning, lookups, generators and further evaluation on small fixtures with awkward rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltweir.functions import transforms as X
from siltweir.operators import dedup as D
from siltweir.operators import evaluation as E
from siltweir.operators import findings as G
from siltweir.operators import generate as N
from siltweir.operators import lookup as U
from siltweir.operators import ordered as O
from siltweir.operators import page as P
from siltweir.operators import relational as R


def test_ranks_and_percentiles(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice("abc"), rnd.choice([rnd.random(), 0.5, 0.25])) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, g string, v double")
    got = sorted((r.rank, r.v, r.k) for r in O.ranked(df, ["v", "k"]).collect())
    assert [(v, k) for _, v, k in got] == sorted((v, k) for k, _, v in rows) and [r for r, *_ in got] == list(range(1, 601))
    for r in O.percentiles(df, "v", [0, 0.1, 0.5, 0.95, 1.0], ["g"]).collect():
        assert np.allclose(np.percentile([v for _, g, v in rows if g == r.g], [0, 10, 50, 95, 100]), r.percentiles)
    assert O.percentiles(df.limit(0), "v", [0.5]).first().percentiles == [None]
    assert [r.n for r in R.chunks(df, ["v", "k"], 7).groupBy("chunk").agg(F.count("*").alias("n")).orderBy("chunk").collect()] == [86] * 5 + [85] * 2


def test_agreement_of_rankings(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.randrange(12), rnd.randrange(12)) for i in range(60)]
    sign = lambda x: (x > 0) - (x < 0)
    pairs = [(sign(a[1] - b[1]), sign(a[2] - b[2])) for a in rows for b in rows if a[0] < b[0]]
    want = sum(x * y for x, y in pairs) / (sum(abs(x) for x, _ in pairs) * sum(abs(y) for _, y in pairs)) ** 0.5
    df = spark.createDataFrame(rows, "k int, a int, b int")
    assert E.kendall_tau(df, "k", "a", "b").first().tau == pytest.approx(want)
    avg = lambda v: [sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v]
    assert E.spearman(df, "a", "b").first().rho == pytest.approx(np.corrcoef(avg([r[1] for r in rows]), avg([r[2] for r in rows]))[0, 1])


def test_source_matrix_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", "c", None]), rnd.randrange(9) / 10, rnd.randrange(2)) for _ in range(300)]

    def auc(part):
        p, n = [s for _, s, y in part if y], [s for _, s, y in part if not y]
        return sum((a > b) + (a == b) / 2 for a in p for b in n) / (len(p) * len(n))

    known = [r for r in rows if r[0]]
    for r in E.source_matrix(spark.createDataFrame(rows, "s string, v double, y int"), "s", "v", "y").collect():
        assert r.auc == pytest.approx(auc([x for x in known if x[0] == r.s])) and r.others_pooled == pytest.approx(auc([x for x in known if x[0] != r.s]))
        assert r.others_mean == pytest.approx(np.mean([auc([x for x in known if x[0] == o]) for o in "abc" if o != r.s]))


def test_paired_difference(spark):
    rnd = random.Random(4)
    rows = [(i, i % 2, rnd.random() * 0.5 + 0.5 * (i % 2), rnd.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, y int, good double, noise double")
    r = E.bootstrap_delta(df, "noise", "good", "y", "k", 60).first()
    assert r.differs and r.lo > 0.3 and r.n_boot == 60 and E.bootstrap_delta(df, "noise", "good", "y", "k", 60).first() == r
    same = E.bootstrap_delta(df.withColumn("twin", F.col("good")), "good", "twin", "y", "k", 20).first()
    assert same.delta == same.lo == same.hi == 0 and not same.differs


def test_abstention(spark):
    df = spark.createDataFrame([(0.5, 1), (0.2, 0), (0.9, 1), (0.6, 0)], "s double, y int")
    got = {r.half_width: (r.coverage, r.risk) for r in E.coverage_risk(df, "s", "y", (0.0, 0.2)).collect()}
    assert got == {0.0: (0.75, pytest.approx(1 / 3)), 0.2: (0.5, 0.0)}


def test_dedup_of_frames(spark):
    base = "https://www.bank-login.example/account/confirm/session/"
    rows = [(1, base + "a1", "x"), (2, base + "a1x", "y"), (3, base + "a1", "z"), (4, "https://other.test/раура1", "w"), (5, None, "n")]
    df = spark.createDataFrame(rows, "k long, url string, t string")
    assert sorted((r.k, r.t) for r in D.dedup_frame(df, "k", "url").collect()) == [(1, "x"), (4, "w"), (5, "n")]
    assert {r.k: r.url for r in D.cleaned(df, "k", "url").collect()}[4] == "https://other.test/paypa1".replace("y", "y")
    got = {r.stage: (r.n, r.metric) for r in D.before_and_after(df, "k", "url", lambda x: x.agg(F.max("k"))).collect()}
    assert got == {"before": (5, 5.0), "after": (3, 5.0)}
    assert D.dedup_frame(df.limit(0), "k", "url").count() == 0


def test_long_chain_of_drops(spark):
    n = 200
    pairs = spark.createDataFrame([(i, i + 1, 1.0) for i in range(n)], "a long, b long, similarity double")
    df = spark.range(n + 1).withColumnRenamed("id", "k")
    assert {r.k for r in D.greedy_keep(df, "k", pairs).where("kept").collect()} == set(range(0, n + 1, 2))


def test_threats_and_owners(spark):
    feed = spark.createDataFrame([("http://bad.test/x",), ("https://forms.big.test/evil",), (None,)], "u string")
    df = spark.createDataFrame([(1, "http://BAD.test/x/"), (2, "http://bad.test/y"), (3, "https://forms.big.test/fine"), (4, "http://ok.test"), (5, None)], "k int, url string")
    good = spark.createDataFrame([("forms.big.test",)], "h string")
    assert {r.k: r.threat for r in U.threat_hits(df, "url", feed, "u", good).collect()} == {1: "address", 2: "host", 3: None, 4: None, 5: None}
    owned = spark.createDataFrame([("big.test", "Big"), ("shop.big.test", "Shop")], "domain string, owner string")
    h = spark.createDataFrame([("a.SHOP.big.test",), ("b.big.test",), ("test",), (None,), ("a.b.c.d.e.f.g.h.i.j.big.test",)], "h string")
    assert {r.h: r.owner for r in U.owners(h, "h", owned).collect()} == {"a.SHOP.big.test": "Shop", "b.big.test": "Big", "test": None, None: None, "a.b.c.d.e.f.g.h.i.j.big.test": "Big"}


def test_targets_and_addresses(spark):
    want = {"http://a.test/": None, "https://a.test:8443/x": None, "ftp://a.test": "scheme", "http:///x": "host", "http://a.test:22/": "port", "http://u:80@a.test:22/": "port"}
    df = spark.createDataFrame([(u,) for u in want], "u string")
    assert {r.u: r.e for r in df.select("u", U.target_error(F.col("u")).alias("e")).collect()} == want
    ips = {"8.8.8.8": True, "10.0.0.1": False, "127.0.0.1": False, "169.254.169.254": False, "::ffff:10.0.0.1": False, "::1": False, "224.0.0.1": False, "x": None, None: None}
    assert {r.i: r.p for r in spark.createDataFrame([(i,) for i in ips], "i string").select("i", U.is_public(F.col("i")).alias("p")).collect()} == ips


def test_order_of_findings(spark):
    df = spark.createDataFrame([(1, 0, 0.7), (1, 1, 3.1), (1, 2, -1.0), (1, 3, 1.2), (1, 4, 0.7)], "k int, i int, w double")
    assert [r.i for r in G.ordered(df, "k", "w", "i").orderBy("position").collect()] == [1, 3, 0, 4, 2]


def test_recall_under_transforms(spark):
    df = spark.createDataFrame([(i, "http://a.test/" + "x" * i, 1) for i in range(20)] + [(99, "http://b.test", 0)], "k long, url string, y int")
    got = {r.transform: (r.recall, r.delta) for r in E.recall_under_transforms(df, "url", "y", "k", lambda u: F.length(u) / 100, {"cut": lambda u, k: F.substr(u, F.lit(1), F.lit(10))}, 0.2).collect()}
    assert got["none"] == (0.7, 0.0) and got["cut"] == (0.0, -0.7)


def test_generators(spark):
    v = N.typo_variants(spark.createDataFrame([(1, "paypal.com"), (2, "x.test"), (3, None)], "k long, d string"), "k", "d").collect()
    assert {r.k for r in v} == {1} and {r.kind for r in v} >= {"omit", "double", "ending", "bait"} and all(r.variant != "paypal.com" for r in v)
    c = N.smoke_corpus(spark, 300)
    assert c.count() == 300 and c.where("label = 1 and rank is not null").count() == 0 and sorted(map(tuple, c.collect())) == sorted(map(tuple, N.smoke_corpus(spark, 300).collect()))
    p = N.with_paths(spark.range(2000).select("id", F.lit("https://a.test").alias("url")), "id", "url")
    assert abs(p.where(F.col("augmented").rlike("test/")).count() / 2000 - 0.65) < 0.05 and abs(p.where("augmented like 'http:%'").count() / 2000 - 0.15) < 0.04


def test_plain_letters(spark):
    r = spark.range(1).select(X.plain_letters(F.lit("раураl ｘ é")).alias("p")).first()
    assert r.p == "paypal x é"


def test_references_on_pages(spark):
    base = "http://a.test/d/e.html?q=1#f"
    want = {"x.html": "http://a.test/d/x.html", "/r": "http://a.test/r", "//b.test/y": "http://b.test/y", "../z?u=/v": "http://a.test/z?u=/v", "./": "http://a.test/d/", "?n=2": "http://a.test/d/e.html?n=2", "#g": "http://a.test/d/e.html?q=1#g", "https://c.test/": "https://c.test/", "": base, "mailto:x@y.test": "mailto:x@y.test"}
    df = spark.createDataFrame([(r,) for r in want], "r string")
    assert {x.r: x.u for x in df.select("r", P.resolved(F.lit(base), F.col("r")).alias("u")).collect()} == want


def test_logo_wall_and_script_redirect(spark):
    wall = "<title>Shop</title>" + "".join(f'<img class="logo" alt="{b}" src="/i/{b}.png">' for b in ("paypal", "apple", "amazon")) + '<script>location.replace("go/next")</script><form action="mailto:x@y.test"></form>'
    one = '<base href="https://b.test/q/"><title>Welcome</title><img src="/i/netflix-logo.png" alt="Netflix"><form><input name="pin"></form><a href="x">n</a>'
    df = spark.createDataFrame([(1, wall, "http://a.test/p/", "text/html"), (2, one, "http://a.test/", "text/html")], "k long, h string, u string, c string")
    r = {x.page_key: x for x in P.signals(P.parse(df, "k", "h", "u", "c", ["test"])).collect()}
    assert r[1].brand_claims == [] and r[1].js_redirects == ["http://a.test/p/go/next"] and r[1].exfil == "mailto" and not r[1].external_form
    assert r[2].brand_claims == ["netflix"] and r[2].sensitive_fields == ["pin"] and r[2].top_link_domains[0].domain == "b.test" and r[2].external_resource_ratio == 1.0
