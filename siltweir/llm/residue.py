"""Problem 6: template residue and error-page text.

The body of each page is cut out by the body operator and its message is masked: numbers, addresses, dates and long
tokens give way to marks. Masked messages are grouped by exact hash across sources (sites). A message that recurs on
many of them is classified as a group: by the phrase rules of most of its pages, else by what most of their titles or
their `parked` flags say, whatever the language; the class holds for all its pages. Every page with a body takes part,
with prose of its own or not. A message that doesn't recur is
classified by the phrase rules alone. Unfilled placeholders and filler are looked for anywhere in title and text; a
sentence that speaks of a placeholder, and quoted text, are none.

A body is a notice if sentences worded as one make up most of it, or if it opens with one and they make up a tenth; so
neither the number nor the length of its lines matters.

Nulls: with a NULL or empty text, or one without a body, the title decides; NULL title and text is no case. `parked`
counts for widely recurring messages only. Texts are read whole. Repeated rows count as rows; empty input gives an empty
result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltweir.llm.body import CUES, U, Page, body_of, codes, compact, default_cues, learned, menu_units, pages_of, read_page
from siltweir.llm.gate import Rules, alternatives, beginnings, folded
from siltweir.llm.phrases import ERROR, PARKED, SCRIPT, unquoted
from siltweir.session import staged, table, unstage

#: A masked message found on at least this many sources counts as widely recurring.
WIDE = 3
#: Share of a body that notice-worded sentences make up: without, and with one at its beginning.
MOST, OPENING = 0.5, 0.1
#: Labels of up to this many characters beside a notice (a code, a name) say nothing of their own.
LABEL = 40

_NAME = r"[A-Za-z][A-Za-z0-9]*(?:[._ -][A-Za-z0-9]+)*"
_ID = r"[A-Za-z][A-Za-z0-9]*(?:[._][A-Za-z0-9]+)*"
PLACEHOLDER = re.compile(
    rf"\{{\{{\s*{_NAME}\s*\}}\}}|\{{%-?\s*{_NAME}\s*-?%\}}|[$#]\{{\s*{_ID}\s*\}}|(?<![\w{{]){{{_ID}}}(?![\w}}])|<%=?\s*{_NAME}\s*%>|<(?!/?(?:a|b|i|p|br|em|li|ul|ol|td|tr|div|span|img|strong|html|body|head|table)\b){_ID}>"
    rf"|%%\s*{_ID}\s*%%|@@\s*{_ID}\s*@@|\*\|\s*{_ID}\s*\|\*|\[\[\s*{_ID}\s*\]\]|(?<!\w)__{_ID}__(?!\w)|\[(?:your |insert )?{_NAME} here\]|\[(?:insert|enter|your) {_NAME}\]|(?<!\w)%[A-Z][A-Z_]{{2,}}%(?!\w)"
)
#: A sentence with one of these speaks of the placeholder.
_MENTION = re.compile(r"\b(?:replac\w+|placeholders?|forgot|variables?|templates?|unfilled|literal\w*|syntax|platzhalter|ersetz\w+|vergaß|remplac\w+|oubli\w+|marcador\w*|reemplaz\w+|sustitu\w+|substitu\w+|olvid\w+|esque\w+)\b|шаблон|замен|забы", re.I)

#: The words of dummy Latin.
_LATIN = frozenset("lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum".split())
#: At the start of a sentence, and anywhere in it.
_FILLER = re.compile(
    r"^(?:x{3,}(?: x{2,})*|(?:asdf|qwer|qwerty|jkl[;ö]?|foo|bar|baz|bla|blah|test|abc|dummy)(?:[ ,.]+(?:asdf|qwer|qwerty|jkl[;ö]?|foo|bar|baz|bla|blah|test|abc|dummy|\d+))+)[.!]?$"
    r"|^(?:todo|tbd|fixme|tba)\b|^(?:your|insert|add|enter|put|type|write) (?:your |a |an |the |some |more )?(?:short |own |first |company |main )*(?:text|content|title|headline|heading|description|tagline|slogan|name|image|copy|paragraph)\b.{0,60}(?:here|area|section|below|this (?:block|box|area|page))?[.!]?$"
    r"|^(?:sub)?heading$|^button (?:label|text)$|^(?:section|page|post|article) title$|^\[?(?:image|logo|photo)\]?$"
    r"|^this is (?:an? |the |some |your )?(?:example|sample|dummy|placeholder|first|filler)\b.{0,40}\b(?:page|text|post|paragraph)\b|^(?:replace|edit|change|delete) (?:this|or delete)\b.{0,30}\b(?:text|paragraph|page|post|content|block)\b|^just another \w+ site$|^hello world!?$|^untitled(?: document| page)?(?: \d+)?$"
    r"|^(?:beispiel(?:text|seite)|mustertext|platzhalter(?:text)?|blindtext|hier (?:steht|kommt) (?:ihr|dein|der|ein) text)|^(?:fügen|ersetzen|geben) sie (?:hier )?(?:ihren|diesen|den) (?:text|inhalt)"
    r"|^texte? à remplacer|^(?:insérez|ajoutez|remplacez|saisissez) (?:votre|ce|ici|le) (?:contenu|texte|titre)|^(?:votre|exemple de) (?:texte|contenu)(?: ici)?|^page d['’]exemple"
    r"|^aquí va (?:tu|su|el) (?:texto|contenido)|^(?:inserta|inserte|añade|añada|escribe|escriba|cambia|cambie|sustituye|reemplaza) (?:tu|su|este|el|aquí) (?:texto|contenido|párrafo|título)|^(?:texto|página) de (?:ejemplo|prueba|relleno)"
    r"|^(?:insira|adicione|escreva|coloque|substitua|altere) (?:o seu|seu|este|aqui|o) (?:texto|conteúdo|parágrafo|título)|^(?:o )?seu texto (?:aqui|vai aqui)|^(?:texto|página) de (?:exemplo|teste)|^aqui vai o (?:seu )?texto"
    r"|^(?:пример (?:страницы|текста)|текст-заполнитель|здесь (?:будет|должен быть)? ?(?:ваш )?текст|введите (?:ваш )?текст|замените (?:этот )?текст|ваш текст|вставьте (?:ваш )?(?:текст|содержание))",
    re.I,
)
_FILLER_ANY = re.compile(
    r"\bcontent for section \d+|\b(?:sub)?(?:heading|headline|text|title|content|caption|image|name|copy|description) goes here\b|\b(?:sample|example|dummy|placeholder|filler) (?:page|text|content)\b\.?(?: this is an? (?:example|sample).*)?$|click (?:here )?to edit|(?:ihr|dein) text (?:hier|kommt)",
    re.I,
)
_MARKS = re.compile(r"[{<%@*\[_]")


def _latin(line: str) -> bool:
    """Dummy Latin: at least five of its words, one of them of five letters or more, that make up most of the line's words."""
    words = re.findall(r"[a-zà-ÿ]+", line.lower())
    if len(words) < 5:
        return False
    hits = sum(w in _LATIN for w in words)
    if hits >= 5 and hits >= 0.6 * len(words):
        return True
    run = best = 0
    for w in words:
        run = run + 1 if w in _LATIN else 0
        best = max(best, run)
    return best >= 5


def placeholder(line: str) -> bool:
    """Whether the line holds an unfilled placeholder, not a sentence about one."""
    if not _MARKS.search(line):
        return False
    q = unquoted(line)
    for m in PLACEHOLDER.finditer(q):
        a = max((x.end() for x in re.finditer(r"[.!?]\s", q[: m.start()])), default=0)
        b = re.search(r"[.!?](?:\s|$)", q[m.end() :])
        sentence = q[a : m.end() + (b.end() if b else len(q))]
        if not _MENTION.search(sentence.replace(m.group(), " ")):
            return True
    return False


_SENTENCE = re.compile(r"(?<=[.!?。])\s+")
#: The stop and the blanks behind a sentence. It begins with a set of characters, as the other patterns that are looked for
#: in whole texts do: these are found fast.
_STOP = re.compile(r"[.!?。]\s+")
_FILL, _NOTE = ("any",), ("script", "parked", "error")
#: Filler at the start of a sentence, by what a sentence must begin with.
_STARTS = {x: [] for part in alternatives(_FILLER.pattern) for x in beginnings(part)}
for _part in alternatives(_FILLER.pattern):
    assert beginnings(_part), _part
    for _x in beginnings(_part):
        _STARTS[_x].append(re.compile(_part, re.I))
_BEGIN = tuple(_STARTS)
_BY_LETTER = {c: [(b, rules) for b, rules in _STARTS.items() if b[0] == c] for c in {b[0] for b in _STARTS}}
_ANY_BEGIN = re.compile(r"(?:^|(?<=[.!?。])\s)\s*(?=" + "|".join(map(re.escape, sorted(_STARTS))) + ")", re.I | re.M)
#: The same in a folded text that a newline was put before; also sentences that begin with a digit, as codes of errors do,
#: which have no literal.
_LOW_BEGIN = re.compile(r"[\n.!?。](?:(?<=\n)|\s)\s*(?=\d|" + "|".join(re.escape(c) + "(?:" + "|".join(re.escape(b[1:]) for b, _ in rules) + ")" for c, rules in _BY_LETTER.items()) + ")")
_RULES = Rules({"script": SCRIPT.pattern, "parked": PARKED.pattern, "error": ERROR.pattern, "any": _FILLER_ANY.pattern, "latin": "|".join(sorted(w for w in _LATIN if len(w) >= 5))})
_IDS = {k: frozenset(n for n, (_, name) in enumerate(_RULES.rules) if name in names) for k, names in (("fill", _FILL), ("note", _NOTE), ("latin", ("latin",)))}


def filler(line: str, tried: set[int] | None = None) -> bool:
    """Whether the line is filler: dummy Latin, or a sentence that only holds a place."""
    t = line.strip()
    if tried is None:
        tried = _RULES.hits(t, [0]).get(0, _NOTHING)
    if tried & _IDS["latin"] and _latin(t):
        return True
    fill = tried & _IDS["fill"]
    for x in dict.fromkeys((t, *_SENTENCE.split(t))):
        low = x.lower()
        if low.startswith(_BEGIN) and _starts(x, low) or fill and _RULES.names(x, fill):
            return True
    return False


def _filled(line: str, spots: list[tuple[int, tuple[int, ...]]]) -> bool:
    """Whether the line is filler by the rules whose literals stand at these places, each tried in its sentence."""
    tried = {n for _, ns in spots for n in ns}
    if tried & _IDS["latin"] and _latin(line.strip()):
        return True
    fill = tried & _IDS["fill"]
    if not fill:
        return False
    if _RULES.names(line.strip(), fill):
        return True
    return any(own and _RULES.names(line[a:b].strip(), own) for a, b, own in _sentences(line, spots, _IDS["fill"]))


def _sentences(line: str, spots: list[tuple[int, tuple[int, ...]]], ids: frozenset[int]) -> Iterator[tuple[int, int, set[int]]]:
    """(start, end, those of the rules whose literals end in it) of each sentence; the places are in order."""
    a, at, n = 0, 0, len(spots)
    for m in chain(_STOP.finditer(line), (None,)):
        b = m.start() + 1 if m else len(line)
        own: set[int] = set()
        while at < n and spots[at][0] < (m.end() if m else b):
            own.update(spots[at][1])
            at += 1
        yield a, b, own & ids
        a = m.end() if m else b


def _begun(text: str, at: int) -> bool:
    """Whether the sentence, or the line, that begins at this place is filler."""
    end = text.find("\n", at)
    line = text[at : end if end >= 0 else len(text)].rstrip()
    low = line.lower()
    if not _starts(line, low):
        stop = _SENTENCE.search(line)
        return stop is not None and _starts(line[: stop.start()], low)
    return True


def _starts(x: str, low: str) -> bool:
    return any(r.match(x) for b, rules in _BY_LETTER.get(low[:1], ()) if low.startswith(b) for r in rules)


_NOTHING: frozenset[int] = frozenset()
_QUOTE = re.compile("[“«„\"‘]")
_SHORT: dict[tuple[str, str], object] = {}


def _kept(kind: str, f, line: str):
    """f(line), remembered for short lines, which recur widely."""
    if len(line) >= 140:
        return f(line)
    k = (kind, line)
    got = _SHORT.get(k, _SHORT)
    if got is _SHORT:
        if len(_SHORT) >= 200_000:
            _SHORT.clear()
        got = _SHORT[k] = f(line)
    return got


_URL, _HOST = re.compile(r"(?:https?://|www\.)\S+|/[\w./-]{4,}"), re.compile(r"\b[\w-]+(?:\.[\w-]+)*\.(?:[a-z]{2,})\b")
_DATE = re.compile(r"\d(?:\d{3}-\d\d-\d\d(?:[t ]\d\d:\d\d(?::\d\d)?z?)?|\d?[./]\d{1,2}[./]\d{2,4})")
_NUMBER, _QUOTES = re.compile(r"\b(?=\w*\d)(?=\w*[a-z])\w{4,}\b|\d+(?:[.,]\d+)*"), re.compile(r"'[^']*'")
#: What stands in all addresses, hosts, numbers and dates, to the end of the word; a date may go on in words that begin with digits.
_SPOT, _ASCII_SPOT = (re.compile(rf"[./{d}](?:(?<=[{d}])|(?=\S))[^ ]*(?: [{d}][^ ]*)*") for d in (r"\d", "0-9"))


def _words(t: str, spot: re.Pattern, f: Callable[[str], str]) -> str:
    """The text with f applied to the words, parted by blanks, that hold such a spot; it reaches to the end of the word."""
    out, done = [], 0
    for m in spot.finditer(t):
        a = max(t.rfind(" ", done, m.start()) + 1, done)
        out += (t[done:a], f(t[a : m.end()]))
        done = m.end()
    return "".join((*out, t[done:])) if done else t


def _addresses(w: str) -> str:
    return _HOST.sub("<h>", _URL.sub("<u>", w)) if "." in w or "/" in w else w


def mask(text: str) -> str:
    """Numbers, dates, addresses, hosts and mixed tokens give way to marks; case and blanks are folded."""
    # marks that hold no blank are set word by word, in words that may hold what they stand for
    t = text.casefold()
    if t.count("'") > 1:
        t = _DATE.sub("<d>", _words(t, _SPOT, _addresses))
        t = _words(_QUOTES.sub("<q>", t), _SPOT, lambda w: _NUMBER.sub("<n>", w))
    else:
        t = _words(t, _ASCII_SPOT if t.isascii() else _SPOT, lambda w: _NUMBER.sub("<n>", _DATE.sub("<d>", _addresses(w))))
    # blanks other than the space aren't printable
    return t if t.isprintable() and "  " not in t and t == t.strip() else " ".join(t.split())


def notice(line: str, tried: set[int] | None = None) -> str | None:
    """The class of notice a line is worded as."""
    if tried is None:
        tried = _RULES.hits(line, [0]).get(0, _NOTHING)
    tried = tried & _IDS["note"]
    if line[:1].isdigit():  # codes of errors have no literal
        tried = tried.union(_RULES.free)
    if not tried:
        return None
    plain = unquoted(line)
    if len(line.split()) > len(plain.split()) + 1:  # it quotes words: it speaks of a notice
        return None
    got = _RULES.names(plain, tried)
    return next((k for k in _NOTE if k in got), None)


def _opening(line: str, spots: list[tuple[int, tuple[int, ...]]], code: bool) -> tuple[str | None, int]:
    """(class of the first notice-worded sentence or None, characters of such sentences, negative if not the first). `code`:
    a sentence of the line may begin with a digit."""
    tried = {n for _, ns in spots for n in ns} & _IDS["note"]
    if not tried and not code:
        return None, 0
    quoted = _QUOTE.search(line) is not None  # without what is quoted, other literals may stand in a sentence
    first, size = None, 0
    for i, (a, b, own) in enumerate(_sentences(line, spots, _IDS["note"])):
        k = notice(line[a:b], tried if quoted else own) if own or quoted or line[a : a + 1].isdigit() else None
        if k:
            size += b - a
            first = first or (k, i)
    if first is None:
        whole = notice(line, tried)
        return whole, len(line) if whole else 0
    return first[0], size if first[1] == 0 else -size


def message_of(title: str | None, text: str | None, known: dict[int, int] | None = None, page: Page | None = None) -> tuple[str | None, str | None, str | None, int | None, str]:
    """(residue class, notice class, class of the title, hash of the masked message, the message); no message where the
    page has no body."""
    known = menu_units(CUES) if known is None else known
    if page is None:
        page = read_page(text, title, default_cues())
    text = text or ""
    parts = text.split("\n")
    starts = [0, *accumulate(len(x) + 1 for x in parts[:-1])]
    low = folded(text)
    spots = _RULES.places(text, low, starts)
    # where a sentence begins as filler does or with a digit
    if len(low) == len(text):
        begins = [m.end() - 1 for m in _LOW_BEGIN.finditer("\n" + low)]
        coded = {bisect_right(starts, i) - 1 for i in begins if low[i].isdigit()}
    else:
        begins, coded = [m.end() for m in _ANY_BEGIN.finditer(text)], range(len(parts))
    residue = None
    for x in [title or "", *(parts if _MARKS.search(text) else ())]:
        if placeholder(x):
            residue = "placeholder"
            break
    if residue is None:
        # a sentence that begins as filler does is looked at alone and, at the start of a line, with all of the line
        if any(_filled(parts[i], x) for i, x in spots.items()) or any(_begun(text, i) for i in begins) or title and _kept("f", filler, title):
            residue = "filler"
    named = _kept("n", notice, title) if title else None
    code = codes(page, [known.get(u, U) for u in page.unit], [known.get(u, U) for u in page.item])
    body = [page.no[i] for i in body_of(page, code)] if page.no else []
    if not body:
        return residue, named, named, None, ""
    lines = [(parts[n - 1].strip(), n - 1) for n in body]
    kind, worded, rest, opens = None, 0, 0, None
    head = (title or "").strip()
    for x, i in lines:
        may = spots.get(i, ())
        if may and (lead := len(parts[i]) - len(parts[i].lstrip())):
            may = [(end - lead, ns) for end, ns in may]
        k, n = _opening(x, may, i in coded)
        if opens is None and x != head:
            opens = k is not None and n > 0
        kind = kind or k
        worded += abs(n)
        rest += len(x) - abs(n) if (len(x) > LABEL or k) and x != head else 0
        if k is None and len(x) <= LABEL and x != head:
            rest += len(x) // 2
    share = worded / (worded + rest) if worded else 0.0
    message = mask(" / ".join(x for x, _ in lines))
    found = kind if share > MOST or opens and share >= OPENING else None
    return residue, found, named, xxhash.xxh3_64_intdigest(message.encode("utf-8", "surrogatepass")) - (1 << 63), message


def classified(pages: DataFrame, messages: bool = True) -> DataFrame:
    """page_id, residue, notice, message (if wanted), h, sources (on how many sources the message recurs), class, found."""
    lines = compact(pages, "page_id", "text_excerpt", "title", "url", keep=("parked",))
    known = menu_units(CUES) | learned(lines)
    names = ["residue", "notice", "named", "h", "message"][: 5 if messages else 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            title, text = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("title", "text"))
            rows = [message_of(h, t, known, p) for h, t, p in zip(title, text, pages_of(batch))]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())[: len(names)]
            out = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(batch.schema.get_field_index("parked")), *[pa.array(v, t) for v, t in zip(out, kinds)]], ["page_id", "host", "parked", *names])

    kind = pages.schema["page_id"].dataType.simpleString()
    x = staged(lines.withColumn("parked", F.coalesce("parked", F.lit(False))).mapInArrow(run, f"page_id {kind}, host long, parked boolean, residue string, notice string, named string, h long" + ", message string" * messages), "messages")
    unstage(lines)
    return x.join(groups(x), "h", "left").withColumn("sources", F.coalesce("sources", F.lit(0))).withColumn("class", F.when(F.col("sources") >= WIDE, F.col("group_class")).otherwise(F.col("notice"))).withColumn("found", F.col("residue").isNotNull() | F.col("class").isNotNull())


def groups(x: DataFrame) -> DataFrame:
    """h, sources, group_class of the messages that recur on WIDE sources. Pre-aggregated by message and site, so a hot
    message is combined where it is read."""
    n = lambda c: F.count_if(c)
    kinds = ("script", "parked", "error")
    per = x.where(F.col("h").isNotNull()).groupBy("h", "host").agg(F.count("*").alias("n"), n(F.col("parked")).alias("p"), *[n(F.col("notice") == k).alias(f"w_{k}") for k in kinds], *[n(F.col("named") == k).alias(f"t_{k}") for k in kinds])
    g = per.groupBy("h").agg(F.count("*").alias("sources"), *[F.sum(c).alias(c) for c in per.columns if c not in ("h", "host")]).where(F.col("sources") >= WIDE)
    half = F.col("n") / 2
    rule = [F.when(F.col(f"w_{k}") >= half, F.lit(k)) for k in kinds] + [F.when(F.col(f"t_{k}") >= half, F.lit(k)) for k in kinds] + [F.when(F.col("p") >= half, F.lit("parked"))]
    return g.select("h", "sources", F.coalesce(*rule).alias("group_class"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "page_analysis"), messages=False).where("found").select("page_id").distinct()


def p6_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that recur widely, with their class (NULL if they are no notices), pages and sources."""
    x = classified(table(spark, sf_dir, "page_analysis")).where((F.col("sources") >= WIDE) & (F.col("message") != ""))
    return x.groupBy("message").agg(F.max("class").alias("class"), F.max("residue").alias("residue"), F.count("*").alias("pages"), F.max("sources").alias("sources"), F.avg(F.col("parked").cast("int")).alias("parked_share"))


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages for further use."""
    pages = table(spark, sf_dir, "page_analysis")
    return pages.join(p6_found(spark, sf_dir), "page_id", "left_anti").select("page_id", "row_id")


QUERIES = {"p6_found": p6_found, "p6_messages": p6_messages, "p6_clean": p6_clean}
