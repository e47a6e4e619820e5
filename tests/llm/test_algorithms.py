"""Splits, consistent text and overlaps against brute force, with awkward rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltweir.llm import look, overlap
from siltweir.llm import split_groups as G
from siltweir.llm.fmindex import FMIndex, code_points, suffix_array, Alphabet

SUFFIX = [("com.example", "icann"), ("example", "icann"), ("test", "icann"), ("webs.test", "private")]


def suffixes(spark):
    return spark.createDataFrame(SUFFIX, "suffix string, section string")


def axis(spark, rows):
    """Extra columns with names the operator uses inside."""
    return spark.createDataFrame([(i, *r, 1, "x", 2) for i, r in enumerate(rows)], "row_id long, source string, domain string, url string, entity int, component string, size int")


def test_components_against_union_find(spark):
    rnd = random.Random(3)
    edges = [(f"n{rnd.randrange(80)}", f"n{rnd.randrange(80)}") for _ in range(70)] + [(f"c{i}", f"c{i + 1}") for i in range(30)] + [("z", "z"), (None, "a"), ("a", None)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a and b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    want = {n: find(n) for n in list(up)}
    least = {}
    for n, r in want.items():
        least[r] = min(least.get(r, n), n)
    got = {r.node: r.root for r in G.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {n: least[r] for n, r in want.items()}


def test_splits_keep_groups_together(spark):
    rnd = random.Random(1)
    rows = [(f"s{i % 40}", f"www.d{rnd.randrange(400)}.com.example", None) for i in range(600)]
    rows += [("hot", "hot.test", None)] * 300 + [(None, "hot.test", None), (None, "n/a", "http://u@HOT.test.:80/x"), (None, "lone.test", None), (None, None, None), ("only", None, None)]
    out = G.assign_splits(axis(spark, rows), suffixes(spark)).collect()
    assert len(out) == len(rows)
    for key in ("source", "entity"):
        seen = {}
        for r in out:
            if r[key] is not None:
                assert seen.setdefault(r[key], r.split) == r.split
    assert {r.split for r in out if r.entity == "hot.test"} == {next(r.split for r in out if r.source == "hot")}


def test_splits_reach_shares(spark):
    rows = [(f"s{i % 997}", f"d{i % 997}.test", None) for i in range(3000)]
    n = {r.split: r["count"] for r in G.assign_splits(axis(spark, rows), suffixes(spark)).groupBy("split").count().collect()}
    assert n == {"train": 2400, "validation": 300, "test": 300}


def test_splits_of_nothing(spark):
    assert G.assign_splits(axis(spark, []).limit(0), suffixes(spark)).count() == 0
    assert G.related_sources(axis(spark, []).limit(0), suffixes(spark)).count() == 0


def test_subset_sums():
    rnd = random.Random(0)
    for _ in range(60):
        sizes = [rnd.randint(1, 30) for _ in range(9)]
        hist = {}
        for s in sizes:
            hist[s] = hist.get(s, 0) + 1
        target = rnd.randint(1, sum(sizes))
        got = G._subset_counts(sorted(hist.items(), reverse=True), target)
        assert all(0 < k <= hist[s] for s, k in got.items())
        best = min(abs(target - sum(sizes[i] for i in range(9) if m >> i & 1)) for m in range(512))
        assert abs(target - sum(s * k for s, k in got.items())) == best


def test_big_sizes_are_placed_first(monkeypatch):
    monkeypatch.setattr(G, "MAX_BITS", 512)
    got = G.choose_sizes([(100, 50), (1, 200)], (0.8, 0.1, 0.1))
    assert [sum(s * k for s, k in g.items()) for g in got[1:]] == [520, 520]


LOOK = [("ｆｕｌｌ．com", "full.com"), ("café", "café"), ("a​b­", "ab"), (" x y　", "x y"), ("раураl", "paypal"), ("ⅼⅴ", "lv"), ("http:⁄∕x", "http://x"), ("a‑b․c", "a-b.c"), ("𝖺𝚋", "ab"), ("ﬁn", "fin")]
APART = ["a0", "ao", "rn", "m", "A", "a", "é", "e", "x²", "x2", "ü", "u", "l", "1", "I"]


def test_look():
    t = look.transducer()
    for a, b in LOOK:
        assert t.apply(a) == t.apply(b) == b
    assert [t.apply(x) for x in APART] == APART
    long = "ａ́" * 50_000
    assert t.apply(long) == "á" * 50_000 and t.apply("") == ""


def test_all_code_points_keep_their_form_when_decomposed():
    t = look.transducer()
    assert t.verify() == []
    assert t.apply("ё") == t.apply("е\u0308") == "ë" and t.apply("각") == t.apply("\u1100\u1161\u11a8") == "각"
    # joiners stay where they are seen, and only there
    assert t.apply("pay\u200dpal") == "paypal" and t.apply("می\u200cخواهم") == "می\u200cخواهم" and t.apply("👩\u200d💻") == "👩\u200d💻" and t.apply("क्\u200dष") == "क्\u200dष"


def test_look_pairs_against_brute_force(spark):
    vals = [x for p in LOOK for x in p] + APART + ["full.com", "full.com", None, "", " ", "ｆull.com", "ｆull.com"]
    df = spark.createDataFrame([(i, v, None, "c") for i, v in enumerate(vals)], "row_id long, url string, domain string, form string")
    got = {(r.field, r.row_id_a, r.row_id_b) for r in look.look_pairs(df).collect()}
    f = look.transducer().apply
    want = {("url", i, j) for i, a in enumerate(vals) for j, b in enumerate(vals) if i < j and a is not None and b is not None and a != b and f(a) == f(b)}
    assert got == want
    assert look.look_pairs(df.limit(0)).count() == 0


def test_consistent(spark):
    r = look.consistent(spark.createDataFrame([("ｘ", None, "old")], "url string, domain string, url_form string")).first()
    assert r.url_form == "x" and r.domain_form is None


def test_suffix_array():
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(60))) for _ in range(80)] + ["ab" * 40] * 3
    pts = code_points(texts)
    codes = Alphabet(pts).codes(pts)
    sa = suffix_array(codes)
    whole = "".join(t + "\0" for t in texts)
    key = [whole[i : whole.index("\0", i) + 1] for i in sa]
    assert sorted(sa.tolist()) == list(range(len(whole))) and key == sorted(key)


def test_index_search():
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abc./é") for _ in range(rnd.randrange(30))) for _ in range(300)] + ["same"] * 4
    ix = FMIndex.load(FMIndex.build(texts).dump())
    for _ in range(200):
        t = rnd.choice(texts)
        q = t[rnd.randrange(len(t) + 1) :][:6]
        lo, hi = np.array([0]), np.array([ix.n])
        for c in ix.alphabet.codes(code_points([q]))[:-1][::-1]:
            lo, hi = ix.step(np.array([c]), lo, hi)
        if q:
            assert sorted(ix.doc[lo[0] : hi[0]].tolist()) == sorted(d for d, x in enumerate(texts) for s in range(len(x)) if x.startswith(q, s))


@pytest.mark.parametrize("shard_chars", [600, 10_000_000])
def test_overlap_against_brute_force(spark, shard_chars):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("bdfgh") + rnd.choice("aeiou") for _ in range(4))
    base = [f"https://www.{word()}-{word()}.com.example/{word()}/{word()}.php?id={rnd.randrange(10**6)}" for _ in range(120)]
    urls = []
    for u in base:
        i = rnd.randrange(8, len(u))
        urls += [(u, "train"), (u[:i] + rnd.choice("xyz") + u[i + 1 :], "test"), (u + "/", "validation"), (u[:i] + u[i + 3 :], "test"), (u[:-7], "train"), (u.upper(), "test"), (u[: i - 2] + "qq" + u[i - 2 :], "train")]
    urls += [("", "train"), ("", "test"), ("ab", "train"), ("AB", "test"), ("abc", "test"), (None, "test"), ("x", None), ("aaaaaaaa", "train"), ("aaaaa", "test"), ("é" * 30, "train"), ("É" * 31, "test"), ("z" * 20_000, "train"), ("z" * 19_000, "test")]
    urls += [("https://copy.example/a", "train")] * 5 + [("https://copy.example/a", "test")] * 4
    df = spark.createDataFrame([(i, u, s, 0, "t") for i, (u, s) in enumerate(urls)], "row_id long, url string, split string, h1 int, text string")
    pairs, a, b = overlap.cross_split(df, shard_chars=shard_chars)
    got = {(r.row_id_a, r.row_id_b) for r in overlap.expand(pairs, a, b, "row_id").collect()}
    sh = [overlap.shingles(u.lower()) if u is not None else None for u, _ in urls]
    tr = [i for i, (u, s) in enumerate(urls) if s == "train" and u is not None]
    ev = [i for i, (u, s) in enumerate(urls) if s in ("test", "validation") and u is not None]
    want = {(min(i, j), max(i, j)) for i in tr for j in ev if len(sh[i] & sh[j]) * 5 >= len(sh[i] | sh[j]) * 4}
    assert got == want and len(want) > 300
    if shard_chars == 600:
        assert {(r.row_id_a, r.row_id_b) for r in overlap.expand(overlap.cross_split(df, exact=True)[0], a, b, "row_id").collect()} == want


def test_overlap_of_nothing(spark):
    df = spark.createDataFrame([], "row_id long, url string, split string")
    pairs, a, b = overlap.cross_split(df)
    assert overlap.expand(pairs, a, b, "row_id").count() == 0
    one = spark.createDataFrame([(1, "abcdef", "train")], "row_id long, url string, split string")
    assert overlap.cross_split(one)[0].count() == 0
    assert F is not None


def test_line_end_does_not_count(spark):
    ends = ["", "\n", "\r", "\r\n", "\x85", " "]
    df = spark.createDataFrame([(i, "full.com" + e, None) for i, e in enumerate(ends)], "row_id long, url string, domain string")
    assert {r.f for r in df.select(look.shown_form(F.col("url")).alias("f")).collect()} == {"full.com"}
