"""Text operators: bodies, encodings, residue, packing, mixing, pieces; small fixtures with awkward rows."""

import random

import pytest
from pyspark.sql import functions as F

from siltweir.llm import body as B
from siltweir.llm import charset as C
from siltweir.llm import mixing as M
from siltweir.llm import packing as K
from siltweir.llm import pieces as P
from siltweir.llm import residue as R

LABELS = {B._hash(B.mask(w)): B.E for w in ("Home", "About", "Contact", "Login", "News", "Blog")}
PARA = "The registrar answered within a day, and then withdrew the name. Nobody, not even the desk, had expected that outcome before noon."


def split(text, title=None):
    b, o = B.body_lines(text, title, LABELS)
    assert sorted(b + o) == [i for i, x in enumerate(text.split("\n"), 1) if x.strip()]
    return b, o


def test_body_page():
    text = "\n".join(["Some Site", "Home | About | Contact", "Home > Blog > X", "A headline", PARA, "", "Method", "• share: 3.5 percent", "Advertisement", PARA, "Share this page: Mail · Print", "You may also like", "Another headline", "A third one", "© 2024 Some Site. All rights reserved.", "Back to top", "We use cookies. Accept all | Reject"])
    assert split(text, "A headline")[0] == [4, 5, 7, 8, 10]


def test_sidebar_above_body():
    text = "\n".join(["Home", "About", "Related articles", "One entry", "Two entries", "A headline", PARA, "Summary"])
    assert split(text, "A headline")[0] == [6, 7, 8]


def test_quoted_notice_is_body():
    text = "\n".join([PARA, "A notice such as “Please enable JavaScript” is often all that a fetch brings back.", "Please enable JavaScript to view this page."])
    assert split(text)[0] == [1, 2]


def test_notice_alone_is_body():
    assert split("Home | About | Blog\nPlease enable JavaScript to view this page.")[0] == [2]


def test_body_edge_cases(spark):
    assert B.body_lines(None) == ([], []) and B.body_lines("") == ([], []) and B.body_lines("\n\n") == ([], [])
    rows = [(1, PARA + "\nBack to top", None, "http://a.test/", 9), (1, PARA + "\nBack to top", None, "http://a.test/", 9), (2, None, "x", None, 9), (3, "", None, "u", 9), (4, (PARA + "\n") * 2000, None, "u", 9)]
    df = spark.createDataFrame(rows, "page_id long, text_excerpt string, title string, url string, line_no int")
    out = B.marked_lines(df)
    assert out.where("page_id = 1 and not body").count() == 2 and out.where("page_id = 4 and body").count() == 2000 and out.where("page_id in (2, 3)").count() == 0
    assert B.marked_lines(df.limit(0)).count() == 0


def test_learned_without_cues(spark):
    """Link lines of wording that no list knows are told by where they stand on the pages of many sites."""
    rnd, rows = random.Random(1), []
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    prose = lambda: " ".join(word() for _ in range(22)) + ", " + word() + ". " + " ".join(word() for _ in range(4)) + "."
    for i in range(60):
        labels = rnd.sample(["Etusivu", "Tuotteet", "Yhteys", "Kirjaudu", "Haku", "Uutiset"], 5)
        menu = "\n".join(labels) if i % 2 else " | ".join(labels)
        lines = [menu, prose(), "Yhteenveto", prose(), *(["Mainos"] if i % 2 else []), prose(), *(["Mainos"] if not i % 2 else []), "Luetuimmat", word().capitalize() + " " + word(), word().capitalize() + " " + word(), "Kaikki oikeudet pidätetään", "Sivun alkuun"]
        rows.append((i, "\n".join(lines), None, f"http://h{i}.test/"))
    df = spark.createDataFrame(rows, "page_id long, text_excerpt string, title string, url string")
    body = {(r.page_id, r.line_no) for r in B.marked_lines(df, cues={}).where("body").collect()}
    for i, text, _, _ in rows:
        for n, x in enumerate(text.split("\n"), 1):
            assert ((i, n) in body) is (x == "Yhteenveto" or len(x) > 100), (i, n, x)


def test_long_footer_and_aside():
    """No length makes a line of another kind: a footer of 3,000 characters that recurs is none of the body."""
    foot = "this material is published for information only and without liability " * 45 + "."
    known = LABELS | {B._hash(B.mask_prose(foot)): B.E}
    assert len(foot) > 3000 and B.body_lines("\n".join([PARA, foot]), None, known) == ([1], [2])


WORDS = ["Prüfbericht über Gefälschtes", "Größere Fälschung müsste überprüft werden", "l’équipe a gardé le même kit", "la señal llegó mañana", "não há razão, a região é boa", "Страница исчезла раньше", "Ещё один отчёт появился", "証明書は報告の前に発行された"]


def clean_model():
    c = C.Counter()
    for w in WORDS * 5:
        C.grams_of(w + ". " + w, c)
    return C.Model(dict(c))


def test_charset_chains():
    m = clean_model()
    j = lambda ct, b, tr=False: C.judge(m, C.LEAST_MARGIN, ct, b, tr)
    for w in WORDS:
        u = w.encode()
        assert j("text/html; charset=utf-8", u)[0] is False
        assert j("text/html", u)[0] is False and j(None, u)[0] is False and j("text/plain; charset=x-unknown", u)[0] is False
        if not w.isascii():
            twice = w.encode().decode("cp1252", "replace")
            if "�" not in twice:
                got = j("text/html; charset=utf-8", twice.encode())
                assert got[0] and got[2] == w
            got = j("text/html; charset=windows-1252", u)
            assert got[0] and got[2] == w
    w = WORDS[1]
    assert j("text/html; charset=windows-1252", w.encode("cp1252"))[0] is False
    assert j("text/html; charset=windows-1251", w.encode("cp1252"))[2] == w
    assert j("text/html; charset=windows-1252", w.encode("mac_roman"))[2] == w
    assert j("text/html", w.encode("cp1252"))[:1] == (True,)
    assert j("text/html; charset=utf-8", "Gr�ße".encode()) == (True, None, None)
    part = (WORDS[1] + "\n").encode() + WORDS[1].encode().decode("cp1252").encode()
    assert j("text/html; charset=utf-8", part)[2] == WORDS[1] + "\n" + WORDS[1]


def test_charset_growth_has_no_limit():
    m = clean_model()
    j = lambda ct, b: C.judge(m, C.LEAST_MARGIN, ct, b, False)
    for stage in ("cp1252", "latin-1"):
        for w in WORDS[:2]:
            t = w
            for _ in range(6):  # more often than was undone before
                t = "".join(C._SLOPPY[stage].chars[b] for b in t.encode())
            assert j("text/html; charset=utf-8", t.encode())[2] == w
    # the same as from every text that can be read again from the declared one, scored without bounds
    for w in WORDS[:5]:
        t = w.encode().decode("cp1252", "ignore").encode().decode("mac_roman") + " " + w.encode().decode("cp437")
        met, todo = {t}, [t]
        while todo:
            x = todo.pop()
            for r in {C._runs(x, s) for s in C._SLOPPY.values()} - met:
                met.add(r)
                todo.append(r)
        most = max(m.score(x) for x in met - {t})
        assert C.likeliest(m, t.encode(), t, C.segments(t), False, m.score(t) + C.LEAST_MARGIN)[0] >= most - 1e-6
        assert all(m.bound(x, -1e9) >= m.score(x) - 1e-6 for x in met)


def test_charset_edges():
    m = clean_model()
    j = lambda ct, b, tr=False: C.judge(m, C.LEAST_MARGIN, ct, b, tr)[0]
    cut = WORDS[5].encode()[:-1]
    assert j("text/html; charset=utf-8", cut, True) is False and j("text/html; charset=utf-8", cut, False) is True
    assert j("image/png", b"\x89PNG\r\n\x00\xff") is False and j("text/html", b"\x89PNG\r\n\x1a\n\x00\xff\xfe") is False and j("text/html", b"plain") is False
    assert C.declared('text/html; charset="UTF-8"') == "utf-8" and C.declared("text/html; charset=") == "utf-8" and C.declared("text/html; charset=base64") == "utf-8"


def test_charset_operator(spark):
    rows = [(i, "text/html; charset=utf-8", (w * 3).encode(), None, 0) for i, w in enumerate(WORDS * 20)]
    rows += [(900, "text/html; charset=utf-8", (WORDS[1] * 3).encode().decode("cp1252").encode(), False, 0), (901, "text/html", None, False, 0), (902, None, b"", False, 0), (903, "text/html", WORDS[1].encode("cp1252") * 2000, False, 0)]
    df = spark.createDataFrame(rows, "fetch_id long, content_type string, body binary, truncated boolean, gram int")
    got = {r.fetch_id: r.restored for r in C.judged(df).where("garbled").collect()}
    assert got == {900: WORDS[1] * 3, 903: WORDS[1] * 2000}
    assert C.judged(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "title, text, want",
    [
        ("{{ name }}", PARA, True), ("A title", PARA[:40] + " [[page.title]] " + PARA[40:], True), ("A title", "Dear {% block x %}, your order #{customer} is ready.\n" + PARA, True),
        ("A title", PARA + "\nIts author forgot to replace {{ first_name }} in the second mail.", False), ("A title", PARA + "\nLorem ipsum on a login page is a sign of haste.", False),
        ("Home", "Lorem ipsum dolor sit amet consectetur elit sed.", True), ("New site", "Texte à remplacer\nInsérez votre contenu ici.", True), ("T", "xxx xxx xxxx xx", True),
        ("404 Not Found", "404\nThe page you asked for could not be found.", True), ("404 Not Found", None, True), ("404 Not Found", "", True), ("A report", "", False), (None, None, False), (None, "", False),
        ("x", "Home | About | Blog\nSomething went wrong. Try again later.", True), ("Why 404 pages matter", PARA + "\nThe kit shows the words “404 Not Found” to every visitor.", False),
        ("a.test", "a.test is for sale\nThis domain may be for sale by its owner. Make an offer.", True), ("T", "Bitte aktivieren Sie JavaScript, um fortzufahren.", True), ("T", PARA + "\nPlease enable JavaScript to view this page.", False),
        ("Sign in", "Sign in\nEmail address\nPassword\nContinue", False), ("t", (PARA + " ") * 3000, False),
        ("x", "The page you asked for could not be found. " + "We keep a list of the addresses of this place and you may look it over from the first page. " * 3 + "Or ask the desk by telephone.", True),
        ("x", "\n".join(["Traceback (most recent call last):", *[f"at shop.cart.step{i}(Cart.java)" for i in range(9)], "KeyError: 'sku'"]), True),
    ],
)
def test_residue(title, text, want):
    r, n, *_ = R.message_of(title, text, LABELS)
    assert bool(r or n) is want


def test_residue_operator(spark):
    rows = [(i, f"http://h{i}.test/", "Error", f"Your session has ended. Code {i}", None, "m") for i in range(6)] + [(7, None, None, None, True, "m"), (8, "http://x.test", "T", PARA, True, "m")]
    # wording that no rule knows: found because it recurs with titles or flags that tell
    rows += [(20 + i, f"http://p{i}.test/", "404 Not Found" if i else "Strona", f"Nie ma takiej strony {i}", None, "m") for i in range(5)]
    rows += [(30 + i, f"http://q{i}.test/", None, "Questo nome cerca un nuovo proprietario", i > 0, "m") for i in range(5)]
    rows += [(40, "http://r.test/", None, "Questo sito cerca molti nuovi lettori", True, "m"), (41, "http://s.test/", "Accedi", "Utente\nParola", None, "m"), (42, "http://t.test/", "Accedi", "Utente\nParola", None, "m"), (43, "http://u.test/", "Accedi", "Utente\nParola", None, "m")]
    df = spark.createDataFrame(rows, "page_id long, url string, title string, text_excerpt string, parked boolean, message string")
    x = {r.page_id: r for r in R.classified(df).collect()}
    assert x[0].found and x[0].sources == 6 and x[0].message == "your session has ended. code <n>" and not x[7].found and not x[8].found
    assert all(x[i].found for i in [*range(20, 25), *range(30, 35)]) and not any(x[i].found for i in range(40, 44))
    assert R.classified(df.limit(0)).count() == 0


def test_messages_of_prose_recur(spark):
    """A page with prose of its own takes part in the grouping, too: a notice in words that no rule knows, as long as an
    article, is found by the titles or flags of the sites that show it; an article that recurs without them isn't."""
    strange = "Tę nazwę zgłoszono niedawno i nic tu jeszcze nie ma, a kto chce ją mieć, niech napisze do nas z podaniem oferty. " * 4
    assert R.message_of(None, PARA, LABELS)[3] is not None
    rows = [(i, f"http://a{i}.test/", None, f"{strange}\n\n{strange}Nr {i}.", i > 0) for i in range(5)] + [(10 + i, f"http://b{i}.test/", "T", PARA, None) for i in range(5)] + [(20, "http://c.test/", None, strange + "Inna.", True)]
    df = spark.createDataFrame(rows, "page_id long, url string, title string, text_excerpt string, parked boolean")
    x = {r.page_id: r for r in R.classified(df).collect()}
    assert all(x[i].found and x[i].sources == 5 and x[i]["class"] == "parked" for i in range(5))
    assert all(x[10 + i].sources == 5 and not x[10 + i].found for i in range(5)) and not x[20].found


def test_masks_word_by_word():
    for text, want in [("See http://a.b/c  and\tx.com/path9 on 2024-01-02 10:30 or 1.2.2024", "see <u> and <h><u> on <d> or <d>"), ("It's 'a b' 12.5abc ab12cd v1.2abc 7,5.", "it<q>a b' <n>abc <n> v<n>abc <n>.")]:
        assert R.mask(text) == want


def test_rules_lose_nothing():
    """Alternatives tried by their literals match what the whole patterns match."""
    for name, p in (("error", R.ERROR), ("parked", R.PARKED), ("script", R.SCRIPT)):
        rules = R.Rules({name: p.pattern})
        for x in ["404", "404 Not Found", "Error 500", "http error 403", "503 – Service Unavailable now", "The page could not be found", "this domain may be for sale", "Domain steht zum Verkauf", "please enable JavaScript", "Checking your browser", "nothing here", "Ошибка 404", "hier entsteht eine Seite", "It works!", ""]:
            assert bool(rules.names(x)) is (p.search(x) is not None), (name, x)


def test_rules_are_tried_in_their_sentences(monkeypatch):
    """Rules are tried in the sentences where their literals stand, not in all of the line; letters that match others
    without case count as these."""
    calls = []
    notice = R.notice
    monkeypatch.setattr(R, "notice", lambda *a: calls.append(a) or notice(*a))
    text = "The desk met before nine. " * 200 + "This page was not found. " + "The desk met before ten. " * 200
    assert R.message_of(None, text, LABELS)[:2] == (None, None) and len(calls) < 10
    assert R.message_of(None, "Page not found. " + "The desk met before ten. " * 3, LABELS)[1] == "error"
    for name, p in (("error", R.ERROR), ("parked", R.PARKED), ("script", R.SCRIPT)):
        rules = R.Rules({name: p.pattern})
        for x in ["Page waſ not found", "THE NAME İS FOR SALE", "Checkıng your browſer", "Thiſ ſite haſ been suſpended", "Ошиᲂка", "стᲃница", "java script is required", "enable scripts"]:
            assert bool(rules.names(x)) is (p.search(x) is not None), (name, x)


def docs(spark, rows):
    return spark.createDataFrame([(i, *r, 5, "c") for i, r in enumerate(rows)], "doc_id long, source string, text string, lang string, size int, container string")


def test_packing(spark):
    rnd = random.Random(4)
    rows = [("s", " ".join(rnd.choice(["kit", "mail", "host", "über", "報告", "drift"]) + str(rnd.randrange(50)) for _ in range(rnd.randrange(1, 60))), rnd.choice(["en", "de", None])) for _ in range(400)]
    rows += [("s", "é" * 1300, "EN"), ("s", None, "en"), ("s", "", "en"), ("s", "dup dup", "en"), ("s", "dup dup", "en"), ("s", "x" * 1000, "en")]
    d = docs(spark, rows)
    for shard in (3000, 10**9):
        out = K.containers(d, 1000, shard_bytes=shard).collect()
        fill, seen = {}, {}
        for r in out:
            fill[r.container] = fill.get(r.container, 0) + r.size
            seen.setdefault(r.doc_id, []).append((r.start, r.end))
        assert max(fill.values()) <= 1000 and len(seen) == len(rows)
        for i, (_, t, _) in enumerate(rows):
            b = (t or "").encode()
            spans = sorted(seen[i])
            assert spans[0][0] == 0 and spans[-1][1] == len(b) and all(a[1] == c[0] for a, c in zip(spans, spans[1:])) and (len(b) > 1000 or len(spans) == 1)
            for a, c in spans:
                b[a:c].decode()
        places = {}
        for r in out:
            places.setdefault(r.container, []).append(r.place)
        assert all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())
    assert 1 - sum(fill.values()) / (1000 * len(fill)) < 0.02
    assert K.containers(d.limit(0), 1000).count() == 0


def test_bm25_finds_its_like():
    texts = ["alpha beta gamma delta"] * 2 + ["alpha beta gamma"] + ["one two three four"] * 20 + ["five six seven"] * 20
    s = K.Index(texts).scores(0)
    assert set(s.argsort()[::-1][:3].tolist()) == {0, 1, 2} and s[5] == 0


def test_mixing(spark):
    rnd = random.Random(2)
    rows = [("big", "x" * rnd.randrange(50, 150), None) for _ in range(800)] + [("small", "y" * rnd.randrange(50, 150), None) for _ in range(60)] + [("tiny", "z" * 10, None), ("tiny", None, None), (None, "w" * 900, None), ("other", "v" * 900, None)]
    d = docs(spark, rows)
    t = spark.createDataFrame([("big", 0.6, 1), ("small", 0.2, 4), ("tiny", 0.1, 3), ("none", 0.1, 2), ("zero", None, None)], "source string, target_share double, max_repeats int")
    a = {r.source: r for r in M.allocation(d, t).collect()}
    assert {s for s, r in a.items() if r.short} == {"tiny", "none"}
    m = M.mix(d, t).collect()
    assert len(m) == 862 and len({r.doc_id for r in m}) == 862
    used = {}
    for r in m:
        used[r.source] = used.get(r.source, 0) + r.size * r.copies
    total = a["big"].total
    assert abs(used["big"] / total - 0.6) < 0.002 and abs(used["small"] / total - 0.2) < 0.002 and used["tiny"] == 30
    assert max(r.copies for r in m if r.source == "small") <= 4 and max(r.copies for r in m if r.source == "big") == 1
    assert sorted(M.mix(d, t).collect()) == sorted(m)
    # of two kinds of documents the longer ones are drawn more often, as their inclusion says
    two = docs(spark, [("s", "x" * (100 if i % 2 else 300), None) for i in range(400)])
    half = spark.createDataFrame([("s", 0.4, 1)], "source string, target_share double, max_repeats int")
    drawn = [r for seed in range(4) for r in M.mix(two, half, seed).collect()]
    for size in (100, 300):
        of = [r for r in drawn if r.size == size]
        assert abs(sum(r.copies for r in of) / len(of) - of[0].inclusion) < 0.06
    assert abs({r.size: r.inclusion for r in drawn}[300] / {r.size: r.inclusion for r in drawn}[100] - 3) < 1e-6
    sh = {r.source: r for r in M.shares(d, t).collect()}
    assert sh["none"].documents == 0 and abs(sum(r.reached_share for r in sh.values()) - 1) < 1e-9
    assert M.mix(d.limit(0), t).count() == 0 and M.allocation(d, t.limit(0)).count() == 0


def test_pieces_round_trip(spark):
    rnd = random.Random(9)
    sent = lambda: " ".join("".join(rnd.choice("abcdefgäß") for _ in range(rnd.randrange(2, 9))) for _ in range(12)).capitalize() + ". "
    texts = ["\n\n".join("".join(sent() for _ in range(5)) for _ in range(30)), "x" * 5000, "é" * 3000, "入力欄はカード番号を求めた。" * 200, " " * 3000, "word " * 2000, "short", "", "🙂" * 700, "a" * 500]
    for t in texts:
        b = t.encode()
        cuts = P.cut_text(t, 500, 60)
        if len(b) <= 500:
            assert cuts == [(0, len(b))]
            continue
        assert cuts[0][0] == 0 and cuts[-1][1] == len(b)
        for (s, e), (s2, e2) in zip(cuts, cuts[1:]):
            assert e - s <= 500 and s < s2 <= e - 60 and e - s2 <= 63 and e2 > e
        for s, e in cuts:
            b[s:e].decode()
    assert all(texts[0].encode()[:e].endswith((b". ", b"\n")) for _, e in P.cut_text(texts[0], 500, 60)[:-1])
    df = spark.createDataFrame([(i, t, "p") for i, t in enumerate([*texts, None])], "doc_id long, text string, piece string")
    got = P.pieces(df, 500, 60)
    assert {r.doc_id for r in got.collect()} == {i for i, t in enumerate(texts) if len(t.encode()) > 500}
    assert P.pieces(df.limit(0), 500, 60).count() == 0
    with pytest.raises(ValueError):
        P.cut_text("abc", 10, 10)


def test_cuts_at_the_topic_boundary():
    a = "The kit copies the form. The form asks for the card. The card number goes to the kit. " * 4
    b = "Rain fell on the hills. The hills were green in the rain. Green rain fell. " * 4
    cuts = P.cut_text(a + "\n\n" + b + "\n\n" + a, 600, 0)
    assert abs(cuts[0][1] - len(a) - 2) <= 2
    assert F is not None
