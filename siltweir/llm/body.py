"""Problem 4: page boilerplate mixed with main content.

Tree scoring over the layout of a text. A page is a root, its blocks, their lines: link lines at the edge of bodies and
the headline part the blocks. Every line of prose or data passes points for its length and its commas to its block and
half of them to the page; a block's points are discounted by its link density, the share of its characters that stand
in link lines. The block with the most points is kept, and so are its siblings that score near it, hold a paragraph of
their own or begin with the headline; link lines inside a kept block are dropped from it.

What is a link line is learned from the corpus: lines, and items of separator lists, are masked (names and numbers) and
counted over all pages. A unit found on many sites that stands outside the span of the pages' unique prose is a link
line of the edge (menus, notices, sidebar headings, footers); one that stands there more often than headings and lists
do is a link line inside bodies (share, advertisement and paging lines). A short list of cue phrases only breaks the tie
for lines that the corpus doesn't tell about.

Nulls: a NULL or empty text has no lines. Empty lines are neither body nor boilerplate, but count for line numbers.
Texts of any length are read whole. Repeated rows give repeated lines. Where no block has points (an error page, a
notice, a form) what is no link line is body. With few sites the corpus tells nothing, and layout and cues decide.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltweir.functions.hosts import url_host
from siltweir.session import spread, staged, table, unstage

#: A unit is learned about if it is found on at least this share of the sites and on LEAST sites; so there are at most
#: (units a site) / share of them. Prose on COMMON of the sites doesn't mark where bodies stand.
SITE_SHARE, LEAST, COMMON = 0.001, 5, 0.01
#: Share of occurrences outside the prose from which a unit is a link line at all, and from which one of the edge.
INLINE, EDGE = 0.4, 0.8
#: Headlines stand directly above prose more often than this, lines of prose that close a body directly below it.
OVER, UNDER = 0.15, 0.5
#: Share of a sidebar heading's occurrences with a short line that isn't found elsewhere directly below it.
LEADS = 0.2
#: Characters from which a line counts as a paragraph, and from which it does so without a full stop.
PARAGRAPH, LONG = 60, 140
#: Share of a line that cue phrases must make up.
CUE_SHARE = 0.2

# Cue phrases of lines that stand beside a body, lower-cased.
CUES = {
    "notice": ("cookie preferences", "cookie settings", "cookie policy", "cookie notice", "uses cookies", "use cookies", "accept all", "reject all", "manage consent", "stores small files", "store information on your device", "on your device", "your privacy matters", "cookies we may set", "got it!", "agree and continue", "verwenden cookies", "alle annehmen", "ablehnen", "speichert daten auf ihrem gerät", "informationen auf ihrem gerät", "cookie-einstellungen", "auswahl bestätigen", "utilisons des cookies", "tout accepter", "refuser", "respecte votre vie privée", "gérer mes choix", "usamos cookies", "utilizamos cookies", "aceptar", "rechazar", "cuida tu privacidad", "aceitar tudo", "recusar", "guarda dados no seu", "respeita a sua privacidade", "файлы cookie", "принять", "отклонить", "данные на вашем устройстве"),
    "footer": ("all rights reserved", "alle rechte vorbehalten", "tous droits réservés", "todos los derechos reservados", "todos os direitos reservados", "все права защищены", "back to top", "nach oben", "haut de page", "retour en haut", "volver arriba", "voltar ao topo", "наверх", "follow us", "folgen sie uns", "suivez-nous", "síguenos", "siga-nos", "made with care", "made with love", "powered by", "site map", "sitemap", "newsletter", "privacy policy", "privacy", "imprint", "impressum", "terms of use", "legal notice", "accessibility", "do not sell my data", "datenschutz", "agb", "mentions légales", "confidentialité", "plan du site", "aviso legal", "privacidad", "mapa del sitio", "termos", "privacidade", "mapa do site", "правовая информация", "конфиденциальность", "registered under number", "registered office", "publishes this material for information only", "names of products belong to their owners"),
    "aside": ("advertisement", "advertising", "sponsored content", "anzeige", "werbung", "publicité", "publicidad", "publicidade", "реклама", "share this", "seite teilen", "partager", "compartir", "partilhar", "compartilhar", "поделиться", "share · save", "comments ·", "previous | next", "zurück | weiter", "précédent | suivant", "anterior | siguiente", "anterior | seguinte", "назад | вперёд", "read next:", "lesen sie auch:", "lire aussi :", "lee también:", "leia também:", "читайте также:", "was this helpful", "war das hilfreich", "skip to main content", "zum inhalt springen", "aller au contenu", "saltar al contenido", "saltar para o conteúdo", "перейти к содержанию"),
    "sidebar": ("related articles", "related posts", "you may also like", "recommended for you", "most read", "most popular", "popular tags", "popular posts", "recent posts", "latest news", "more from", "ähnliche beiträge", "das könnte sie auch interessieren", "meistgelesen", "neueste beiträge", "à lire aussi", "les plus lus", "articles récents", "artículos relacionados", "lo más leído", "artigos relacionados", "mais lidos", "veja também", "читайте также", "популярное", "похожие статьи"),
    "menu": ("home", "about", "contact", "login", "search", "careers", "products", "start", "kontakt", "anmelden", "accueil", "connexion", "inicio", "contacto", "início", "contato", "главная", "контакты"),
    "script": ("enable javascript", "javascript is off", "javascript is disabled", "requires javascript", "requires scripts", "scripts switched off", "scripts and cookies must be on", "scripts needed", "turn them on in your browser", "checking your browser", "a person is asking", "javascript aktivieren", "javascript est désactivé", "activez-le", "activar javascript", "ativar o javascript", "ative o javascript", "включите javascript"),
}
KINDS = ("", "notice", "footer", "aside", "sidebar", "script")
CODE = {k: i for i, k in enumerate(KINDS)}

# flags of a line
SOLID, PROSE, LIST, TITLE, AGAIN, SENTENCE, WORD, TITLED, NAME, LEX = 1, 2, 4, 8, 16, 32, 64, 128, 256, 512

_NAMES = re.compile(r"[A-ZÀ-ÖØ-ÞА-ЯЁ][\w’'-]*(?: [A-ZÀ-ÖØ-ÞА-ЯЁ][\w’'-]*)+")
_DIGITS = re.compile(r"\d+")
_SEP = re.compile(r"\s*[|·›»•]\s*|\s{2,}|\s[>/]\s")
_STOP = re.compile(r"[.!?。…]['\"”’»)]?(?:\s|$)")
_DATA = re.compile(r"^(?:[•\-*–]\s|\d+[.)]\s)|[:：]\s*[\d.,]+\s*\S*$")
_TITLE_SEP = re.compile(r"\s+[|–—-]\s+")


def automaton(cues: dict[str, tuple[str, ...]]) -> ahocorasick.Automaton | None:
    a = ahocorasick.Automaton()
    for kind, words in cues.items():
        for w in words if kind != "menu" else ():
            a.add_word(w, (CODE[kind], len(w)))
    if not len(a):
        return None
    a.make_automaton()
    return a


def menu_units(cues: dict[str, tuple[str, ...]]) -> dict[int, int]:
    """Verdicts on the labels that the cues name, for a corpus that doesn't tell about them."""
    return {_hash(mask(w)): E for w in cues.get("menu", ())}


def _norm(s: str) -> str:
    return _DIGITS.sub("0", _plain(s))


def _plain(s: str) -> str:
    return " ".join(s.split()).casefold()


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


def mask(t: str) -> str:
    """The line with runs of capitalised words and numbers masked; a line that is one such run keeps its words."""
    m = _NAMES.sub("<n>", t)
    return _norm(t if m == "<n>" else m)


def mask_prose(t: str) -> str:
    """The words of a paragraph that begin in lower case; all of it where there is none."""
    return " ".join([w for w in t.split() if w[0].islower()]) or _norm(t)


@dataclass(slots=True)
class Page:
    """What a text says of itself: by line its number, unit, flags and points; items of separator lists by line."""

    no: list[int] = field(default_factory=list)
    unit: list[int] = field(default_factory=list)
    flag: list[int] = field(default_factory=list)
    size: list[int] = field(default_factory=list)
    points: list[float] = field(default_factory=list)
    item: list[int] = field(default_factory=list)
    item_at: list[int] = field(default_factory=list)


#: Lines met before: (unit, flags, size, points, items, plain form); short lines recur widely. Emptied when full.
_MEMO: dict[str, tuple] = {}


def _parts(t: str) -> list[str]:
    """The items of a separator list; the line itself if it is none."""
    # blanks other than the space aren't printable
    if t.isprintable() and not ("|" in t or "·" in t or "›" in t or "»" in t or "•" in t or "  " in t or " / " in t or " > " in t):
        return [t]
    return [x for x in _SEP.split(t) if x]


def _line(t: str) -> tuple:
    n = len(t)
    stop = _STOP.search(t) is not None
    prose = n >= LONG or (n >= PARAGRAPH and stop)
    parts = [] if prose else _parts(t)
    flag = PROSE | SOLID if prose else 0
    if stop:
        flag |= SENTENCE | SOLID
    if len(parts) >= 2:
        flag |= LIST
        if sum(c.isdigit() for c in t) and not stop and any(p.replace(".", "").replace(",", "").isdigit() for p in parts):
            flag |= SOLID
    elif not prose and _DATA.search(t):
        flag |= SOLID
    if not prose:
        flag |= (WORD if " " not in t else 0) | (NAME if _NAMES.fullmatch(t) else 0)
    points = min(n / 100, 3) + t.count(",") + t.count("、") + t.count("，") + prose if flag & SOLID else 0.0
    items = tuple(_hash(mask(x)) for x in parts) if len(parts) >= 2 and not flag & SENTENCE else ()
    return _hash(mask_prose(t) if prose else mask(t)), flag, n, float(points), items, "" if prose else _plain(t)


def _titles(title: str | None) -> frozenset[str]:
    """What a headline may read: the title, or a part of it beside the site's name."""
    y = _plain(title or "")
    return frozenset({y, *(p.strip() for p in _TITLE_SEP.split(y))}) - {""}


def read_page(text: str | None, title: str | None, cues: ahocorasick.Automaton | None) -> Page:
    out = Page()
    if not text:
        return out
    titles, starts, at, leading = _titles(title), [], 0, True
    got, flags = [], []
    for no, raw in enumerate(text.split("\n"), 1):
        t = raw.strip()
        if t:
            x = _MEMO.get(t)
            if x is None:
                x = _line(t)
                if len(t) < LONG:
                    if len(_MEMO) >= 200_000:
                        _MEMO.clear()
                    _MEMO[t] = x
            flag = x[1]
            if titles:
                flag |= TITLE | TITLED if x[5] in titles else TITLED
            if flag & PROSE:
                leading = False
            elif not flag & (SOLID | LIST) and x[2] > 3 and (leading or flag & NAME) and text.count(t) > 1:
                flag |= AGAIN
            if x[4]:
                out.item += x[4]
                out.item_at += [len(flags)] * len(x[4])
            out.no.append(no)
            flags.append(flag)
            got.append(x)
            starts.append(at)
        at += len(raw) + 1
    if got:
        unit, _, size, points, _, _ = zip(*got)
        out.unit, out.size, out.points, out.flag = list(unit), list(size), list(points), flags
    if cues is not None and starts:
        cover = [0] * len(starts)
        kind = [0] * len(starts)
        most = [0] * len(starts)
        low = text.lower()
        quotes = any(c in low for c in "“«„\"")
        if len(low) == len(text):  # lower-casing keeps places for all but a few letters
            for end, (k, n) in cues.iter(low):
                i = bisect_right(starts, end) - 1
                if end + 1 < len(low) and low[end + 1].isalnum() or end >= n and low[end - n].isalnum():
                    continue
                before = low[starts[i] : end - n + 1] if quotes else ""
                if before and (before.rfind("“") > before.rfind("”") or before.rfind("«") > before.rfind("»") or before.rfind("„") > before.rfind("“") or before.count('"') % 2):
                    continue  # a text may quote a notice without being one
                cover[i] += n
                if n > most[i]:
                    most[i], kind[i] = n, k
            for i, c in enumerate(cover):
                if c and c >= CUE_SHARE * out.size[i]:
                    out.flag[i] |= kind[i] * LEX
        for i, s in enumerate(starts if "©" in low or "(c)" in low or "copyright " in low else ()):
            if low[s : s + out.size[i] + 8].lstrip().startswith(("©", "(c)", "copyright ")):
                out.flag[i] |= 0 if out.flag[i] >= LEX else CODE["footer"] * LEX
    return out


#: Unknown, body, headline of this page or another, link line inside bodies, link line of the edge, heading of a sidebar.
U, B, H, I, E, S = 0, 1, 2, 3, 4, 5
_BESIDE = (CODE["notice"], CODE["footer"], CODE["aside"], CODE["sidebar"])


def codes(page: Page, unit: list[int], item: list[int]) -> list[int]:
    """One code a line, from the corpus' verdicts on its unit and its items, then from the cues."""
    n = len(page.no)
    known: dict[int, list[int]] = {}
    for c, at in zip(item, page.item_at):
        known.setdefault(at, []).append(c)
    out = []
    for i in range(n):
        c, f = unit[i], page.flag[i]
        k = f // LEX
        if c == U and i in known:
            its = known[i]
            sure = [x for x in its if x != U]
            if sure and 3 * len(sure) >= len(its):
                links = sum(x >= I for x in sure)
                if 2 * links >= len(sure):
                    c = E if sum(x >= E for x in sure) * 2 >= links else I
        if c == U and (k in _BESIDE or k == CODE["script"]):
            c = I if k == CODE["aside"] else S if k == CODE["sidebar"] else E
        if f & TITLE and c != B:
            c = U
        out.append(c)
    return out


def body_of(page: Page, code: list[int]) -> list[int]:
    """Places of the lines of the body."""
    n, flag = len(page.no), page.flag
    if not n:
        return []
    # a title that names the site instead of the page is found above the menu
    head = next((i for i in range(n) if flag[i] & TITLE and not (flag[i] & AGAIN and i + 1 < n and code[i + 1] >= E)), None)
    if head is not None and any(flag[i] & PROSE and code[i] < I for i in range(head)) and any(code[i] >= E for i in range(head)):
        head = None  # it stands among the links below a body
    # blocks: runs of link lines of the edge, and what stands between them; the headline opens one
    blocks: list[tuple[int, int]] = []
    a = 0
    for i in range(1, n + 1):
        if i == n or (code[i] >= E) != (code[i - 1] >= E) or i == head:
            blocks.append((a, i))
            a = i
    score, prose = [], []
    for a, b in blocks:
        size = sum(page.size[a:b])
        links = sum(page.size[i] for i in range(a, b) if code[i] >= I)
        score.append(sum(page.points[i] for i in range(a, b) if code[i] < I) * (1 - links / size))
        prose.append(any(flag[i] & PROSE and code[i] < I for i in range(a, b)))
    best, whole = max(score), sum(score) / 2
    body: list[int] = []
    for (a, b), s, p in zip(blocks, score, prose):
        if code[a] >= E:
            continue
        if best > 0:
            if not (s > 0 and (s >= 0.2 * best or p or s >= whole) or a == head):
                continue
        elif head is not None and a != head:
            continue
        body += _leaves(page, code, a, b, head)
    if not any(flag[i] & SOLID for i in body):
        # nothing but labels: a notice that elsewhere stands beside bodies is then what the page consists of
        none = all(flag[i] & AGAIN for i in body)
        body += [i for i in range(n) if code[i] >= I and (flag[i] // LEX == CODE["script"] or none and flag[i] & SENTENCE and flag[i] < LEX)]
        if not body:
            body = [i for a, b in blocks if code[a] < E and not (a and code[a - 1] == S) for i in range(a, b) if code[i] < I and not flag[i] & AGAIN]
    return sorted(set(body))


def _leaves(page: Page, code: list[int], a: int, b: int, head: int | None) -> list[int]:
    """Lines of a kept block that are of the body: not its link lines, nor entries of a sidebar or a site's name that
    stand between link lines and the prose."""
    flag = page.flag
    first = next((i for i in range(a, b) if code[i] < I and flag[i] & SOLID), None)
    after = a > 0 and a != head  # the block follows link lines
    beside = after and code[a - 1] == S
    stack = after and bool(flag[a - 1] & WORD)
    # entries are one block of lines: those of a sidebar end where a line is left blank
    end = next((i for i in range(a + 1, b) if page.no[i] > page.no[i - 1] + 1), b) if beside else a
    between = first is None and after and head is None and b < len(code) and b - a <= 2 and code[a - 1] == code[b] == E and not (flag[a - 1] | flag[b]) & LIST
    out = []
    for i in range(a, b):
        if code[i] >= I:
            continue
        if code[i] in (U, H) and not flag[i] & SOLID and i != head:
            if flag[i] & AGAIN and (head is None or i < head):
                continue
            if code[i] == H and flag[i] & TITLED and (head is not None or first is not None and i > first):
                continue  # the title names another line: this one is the headline of another page
            above = first is None or i < first
            if above and i < end and (flag[i] & TITLED or i + 1 != first):
                continue  # an entry; only the line directly above the prose of a page without a title can be its headline
            if above and stack and i == a and flag[i] & WORD:
                continue  # the last label of a menu
            if between and code[i] == U:
                continue  # a label of the site's own between those of a menu
            if above and flag[i] & LIST:
                continue
        out.append(i)
    return out


def body_lines(text: str | None, title: str | None = None, known: dict[int, int] | None = None, cues: ahocorasick.Automaton | None = None) -> tuple[list[int], list[int]]:
    """(numbers of body lines, numbers of other non-empty lines); `known` holds the corpus' verdicts on units."""
    page = read_page(text, title, cues if cues is not None else default_cues())
    known = menu_units(CUES) | (known or {})
    code = codes(page, [known.get(u, U) for u in page.unit], [known.get(u, U) for u in page.item])
    body = set(body_of(page, code))
    return [page.no[i] for i in sorted(body)], [page.no[i] for i in range(len(page.no)) if i not in body]


_DEFAULT: list = []


def default_cues() -> ahocorasick.Automaton | None:
    if not _DEFAULT:
        _DEFAULT.append(automaton(CUES))
    return _DEFAULT[0]


LISTS = (("no", pa.int32()), ("unit", pa.int64()), ("flag", pa.int32()), ("size", pa.int32()), ("points", pa.float32()), ("item", pa.int64()), ("item_at", pa.int32()))


def compact(pages: DataFrame, key: str, text: str, title: str, url: str, cues: dict[str, tuple[str, ...]] | None = None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """k (the key), host (hash) and the arrays of Page for each page with a text: the text is read once. With `keep`
    also title, text and those columns, and the pages without a text."""
    own = cues

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = default_cues() if own is None else automaton(own)
        for batch in batches:
            got = [read_page(t, h, a) for t, h in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            cols = [batch.column(0), batch.column(1)]
            for name, kind in LISTS:
                parts = [getattr(p, name) for p in got]
                at = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(at), pa.array(list(chain.from_iterable(parts)), kind)))
            rest = batch.schema.names[2:] if keep is not None else []
            yield pa.RecordBatch.from_arrays([*cols, *[batch.column(batch.schema.get_field_index(n)) for n in rest]], ["k", "host", *[n for n, _ in LISTS], *rest])

    x = pages.select(F.col(key).alias("k"), F.xxhash64(F.coalesce(url_host(F.col(url)), F.lit(""))).alias("host"), F.col(text).alias("text"), F.col(title).alias("title"), *(keep or ()))
    x = spread(x if keep is not None else x.where("text is not null"))
    arrays = "no array<int>, unit array<long>, flag array<int>, size array<int>, points array<float>, item array<long>, item_at array<int>"
    rest = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in x.schema.fields[2:]) if keep is not None else ""
    kind = pages.schema[key].dataType.simpleString()
    return staged(x.mapInArrow(run, f"k {kind}, host long, {arrays}" + (", " + rest if rest else "")), "page-lines")


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column."""
    c = batch.column(batch.schema.get_field_index(name))
    at = c.offsets.to_numpy()
    return c.flatten().to_numpy(zero_copy_only=False), at - at[0]


def pages_of(batch: pa.RecordBatch) -> Iterator[Page]:
    """The pages of a batch of the compact table."""
    flat = [(v.tolist(), at.tolist()) for v, at in (_flat(batch, n) for n, _ in LISTS)]
    for i in range(batch.num_rows):
        yield Page(*[v[at[i] : at[i + 1]] for v, at in flat])


def learned(lines: DataFrame) -> dict[int, int]:
    """Verdicts on units that are found on many sites. Two passes over the compact table: sites of each unit, then
    where the frequent ones stand. What reaches the driver is bounded by SITE_SHARE."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host = batch.column(1).to_numpy()
            both = []
            for name in ("unit", "item"):
                v, at = _flat(batch, name)
                both.append(np.stack([v, np.repeat(host, np.diff(at))], 1))
            z = np.concatenate(both)
            z = z[np.lexsort((z[:, 1], z[:, 0]))]
            z = z[np.concatenate([[True], (z[1:] != z[:-1]).any(1)])] if len(z) else z
            yield pa.RecordBatch.from_arrays([pa.array(z[:, 0]), pa.array(z[:, 1])], ["u", "h"])

    hosts = lines.select("host").distinct().count()
    least = max(LEAST, int(np.ceil(SITE_SHARE * hosts)))
    frequent = lines.mapInArrow(pairs, "u long, h long").distinct().groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    got = frequent.collect()
    if not got:
        return {}
    often, sites = np.array(sorted((r.u, r.n) for r in got), np.int64).T
    common = sites >= max(LEAST, COMMON * hosts)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(often), 6), np.int64)
        for batch in batches:
            unit, at = _flat(batch, "unit")
            flag, _ = _flat(batch, "flag")
            item, iat = _flat(batch, "item")
            where, _ = _flat(batch, "item_at")
            n = len(unit)
            if not n:
                continue
            page = np.repeat(np.arange(len(at) - 1), np.diff(at))
            rank = np.minimum(np.searchsorted(often, unit), len(often) - 1)
            freq = often[rank] == unit
            prose = flag & PROSE > 0
            i = np.arange(n)

            def span(strong: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                first, last = np.full(len(at) - 1, n), np.full(len(at) - 1, -1)
                np.minimum.at(first, page[strong], i[strong])
                np.maximum.at(last, page[strong], i[strong])
                return first[page], last[page]

            # other lines are held against prose that is found nowhere else, prose against all but the commonest
            strong, wide = prose & ~freq, prose & ~(freq & common[rank])
            (f1, l1), (f2, l2) = span(strong), span(wide)
            has_line = np.where(prose, (l2 >= 0) & ~((f2 == i) & (l2 == i)), l1 >= 0)
            outer = np.where(prose, (i <= f2) | (i >= l2), (i < f1) | (i > l1))
            same = np.append(page[1:] == page[:-1], False)
            over = same & np.append(wide[1:], False)
            under = np.append(False, (page[1:] == page[:-1]) & wide[:-1])
            lead = same & np.append(~freq[1:] & (flag[1:] & (SOLID | LIST | AGAIN) == 0), False)
            has = np.zeros(len(at) - 1, bool)
            has[page[l1 >= 0]] = True
            line = i[freq & has_line]
            ipage = np.repeat(np.arange(len(at) - 1), np.diff(iat))
            host_line = at[:-1][ipage] + where
            irank = np.minimum(np.searchsorted(often, item), len(often) - 1) if len(item) else np.zeros(0, int)
            use = (often[irank] == item) & has[ipage] if len(item) else np.zeros(0, bool)
            np.add.at(total, (rank[freq], 4), 1)
            if len(item):
                np.add.at(total, (irank[often[irank] == item], 4), 1)
            for r, ln, single in ((rank[line], line, True), (irank[use], host_line[use], False)):
                np.add.at(total, (r, 0), 1)
                np.add.at(total, (r, 1), outer[ln])
                if single:
                    np.add.at(total, (r, 2), over[ln])
                    np.add.at(total, (r, 3), under[ln])
                    np.add.at(total, (r, 5), lead[ln])
        hit = np.flatnonzero(total[:, 4])
        yield pa.RecordBatch.from_arrays([pa.array(often[hit]), *[pa.array(total[hit, j]) for j in range(6)]], ["u", "n", "outer", "over", "under", "whole", "lead"])

    per = lines.mapInArrow(places, "u long, n long, outer long, over long, under long, whole long, lead long").groupBy("u").agg(*[F.sum(c).alias(c) for c in ("n", "outer", "over", "under", "whole", "lead")])
    prose = _prose_units(lines, often)
    out = {}
    for r in per.collect():
        if r.n < LEAST or 2 * r.n < r.whole:  # it mostly stands on pages without prose, which tell nothing of it
            continue
        outer, over, under = r.outer / r.n, r.over / r.n, r.under / r.n
        if outer < (EDGE if r.u in prose else INLINE) or (r.u in prose and under >= UNDER):
            out[r.u] = B
        elif outer < EDGE:
            out[r.u] = I
        else:
            out[r.u] = H if over >= OVER else S if r.lead >= LEADS * r.n else E
    return out


def _prose_units(lines: DataFrame, often: np.ndarray) -> set[int]:
    """Which frequent units are lines of prose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: set[int] = set()
        for batch in batches:
            unit, _ = _flat(batch, "unit")
            flag, _ = _flat(batch, "flag")
            u = np.unique(unit[flag & PROSE > 0])
            got |= set(u[np.isin(u, often, assume_unique=True)].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(sorted(got), pa.int64())], ["u"])

    return {r.u for r in lines.mapInArrow(run, "u long").distinct().collect()}


def marked_lines(pages: DataFrame, key: str = "page_id", text: str = "text_excerpt", title: str = "title", url: str = "url", cues: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """key, line_no, body for each non-empty line."""
    lines = compact(pages, key, text, title, url, cues)
    known = menu_units(CUES if cues is None else cues) | learned(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, size = [], []
            for p in pages_of(batch):
                inside = set(body_of(p, codes(p, [known.get(u, U) for u in p.unit], [known.get(u, U) for u in p.item])))
                body += [i in inside for i in range(len(p.no))]
                size.append(len(p.no))
            no, _ = _flat(batch, "no")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(size)), size))), pa.array(no, pa.int32()), pa.array(body, pa.bool_())], [key, "line_no", "body"])

    kind = pages.schema[key].dataType.simpleString()
    return lines.mapInArrow(run, f"{key} {kind}, line_no int, body boolean")


def p4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_lines(table(spark, sf_dir, "page_analysis"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_lines(spark, sf_dir).where("not body").select("page_id", "line_no").distinct()


def verdicts(pages: DataFrame, text: str = "text_excerpt", title: str = "title", url: str = "url", key: str = "page_id") -> dict[int, int]:
    lines = compact(pages, key, text, title, url)
    out = learned(lines)
    unstage(lines)
    return out


def p4_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body of each page, its lines in order; NULL and empty texts have an empty one."""
    pages = table(spark, sf_dir, "page_analysis")
    known = verdicts(pages)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for t, h in zip(pdf["text_excerpt"], pdf["title"]):
                b, _ = body_lines(t, h, known)
                parts = (t or "").split("\n")
                out.append("\n".join(parts[n - 1] for n in b))
            yield pd.DataFrame({"page_id": pdf["page_id"], "body": out})

    return spread(pages.select("page_id", "text_excerpt", "title")).mapInPandas(run, "page_id long, body string")


QUERIES = {"p4_found": p4_found, "p4_bodies": p4_bodies}
