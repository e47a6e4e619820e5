"""Problem 5: garbled text from wrong character encoding.

A smoothed character trigram model is trained on clean records. Every body with other than ASCII characters is then read
through every candidate chain (decode; or decode, encode, decode, on the whole text or on its runs of other than ASCII
characters, the latter as often as they read as UTF-8 again), and the likeliest reading is accepted if it gains more over
the declared one than a margin validated on held-out clean records. Runs are read again in the declared reading, in
those likelier than it, and in whatever comes of these, without a limit. A reading is given up as soon as it, or for one
that is read again anything that may come of it, can't reach what it must: scores are sums of logarithms, and each run
is bounded by the best that it can be read as. Scores of runs are remembered, as words recur.

NULL bodies, empty bodies and bodies that are no text (by signature or control bytes, whatever the type says) are no
cases. A character cut off at the end of a truncated body is no fault. Bodies in plain ASCII read alike in every
candidate and are passed over, but for those with the escapes of ISO-2022. Repeated bodies are judged once by each task.
Bodies are read whole. With no clean record to train on, only replacement characters and control characters tell.
"""

from __future__ import annotations

import codecs
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltweir.session import spread, staged, table, unstage

#: Single-byte and other charsets tried for the bytes; stages and targets of text that was read wrongly and written again.
SINGLE = ("cp1252", "iso8859-15", "cp1250", "cp1251", "koi8-r", "koi8-u", "cp437", "cp850", "cp866", "mac_roman", "iso8859-2", "iso8859-7", "cp1253", "cp1254", "cp1255", "cp1256", "cp1257", "cp1258")
MULTI = ("utf-8", "shift_jis", "euc_jp", "gb18030", "big5", "euc_kr")
STAGES = ("cp1252", "latin-1", "iso8859-15", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8-r", "iso8859-2")
TARGETS = ("cp1251", "koi8-r", "cp1250", "cp1252", "mac_roman", "cp437")
MULTI_TARGETS = ("utf-8", "shift_jis", "euc_jp")
#: Grams rarer than this share of all are left out, which bounds the model at 1 / share entries of about 100 bytes.
GRAM_SHARE = 2e-6
#: The margin, in nats for each character in question, never falls below this.
LEAST_MARGIN = 0.6
#: Runs of up to this many characters with those around are bounded by reading them again in every way, longer ones by the
#: characters that stay.
SHORT = 10
#: One in so many clean records is held out of training to validate the margin.
HELD = 10
#: Scores of runs, and judged bodies, that a worker remembers; emptied when full.
REMEMBERED = 400_000

_NON = re.compile(r"[^\x00-\x7f]+")


def declared(content_type: str | None) -> str:
    m = re.search(r"charset\s*=\s*[\"']?([^\s;\"']+)", content_type or "", re.I)
    try:
        c = codecs.lookup(m.group(1)) if m else None
        return c.name if c and getattr(c, "_is_text_encoding", True) else "utf-8"
    except (LookupError, ValueError):
        return "utf-8"


def is_text(content_type: str | None, body: bytes) -> bool:
    """By the bytes, and by the type where it names images, sound or the like."""
    kind = (content_type or "").split(";")[0].strip().lower()
    if kind.startswith(("image/", "audio/", "video/", "font/")) or kind in ("application/pdf", "application/zip", "application/gzip"):
        return False
    if body[:4] in (b"\x89PNG", b"%PDF", b"PK\x03\x04", b"GIF8", b"\xff\xd8\xff\xe0", b"RIFF") or body[:2] == b"\x1f\x8b":
        return False
    control = len(body) - len(body.translate(None, bytes(range(0, 9)) + bytes(range(14, 27)) + bytes(range(28, 32))))
    return control * 50 <= len(body)


def read(body: bytes, charset: str, truncated: bool) -> str:
    """The declared reading; of a truncated body without a last character that is cut off."""
    if truncated:
        try:
            d = codecs.getincrementaldecoder(charset)("replace")
            return d.decode(body, False)
        except (LookupError, UnicodeError):
            pass
    return body.decode(charset, "replace")


class _Sloppy:
    """A single-byte charset whose undefined bytes stand for the control of that number."""

    def __init__(self, name: str) -> None:
        chars = [bytes([b]).decode(name, "replace") for b in range(256)]
        self.chars = [chr(b) if c == "�" else c for b, c in enumerate(chars)]
        self.table = {c: b for b, c in enumerate(self.chars)}
        for b in range(128, 160):
            self.table.setdefault(chr(b), b)
        kind = lambda lo, hi: "[" + re.escape("".join(c for c, b in self.table.items() if lo <= b <= hi)) + "]"
        tail = kind(0x80, 0xBF)
        #: whole UTF-8 characters, read in this charset
        self.utf8 = re.compile(f"{kind(0xC2, 0xDF)}{tail}|{kind(0xE0, 0xEF)}{tail}{tail}|{kind(0xF0, 0xF4)}{tail}{tail}{tail}")
        self.bytes = {ord(c): b for c, b in self.table.items()}
        self.fast = codecs.charmap_build("".join(self.chars))

    def encode(self, s: str) -> bytes | None:
        try:
            return codecs.charmap_encode(s, "strict", self.fast)[0]
        except UnicodeEncodeError as e:
            if not "\x80" <= s[e.start] < "\xa0":
                return None
        try:  # a control stands for the byte of its number beside the character of that byte
            return codecs.charmap_encode(s, "strict", self.bytes)[0]
        except UnicodeEncodeError:
            return None


_SLOPPY = {n: _Sloppy(n) for n in STAGES}
#: What may be a whole UTF-8 character in one of them.
_AGAIN = re.compile("|".join(dict.fromkeys(s.utf8.pattern for s in _SLOPPY.values())))
#: Characters that may be part of one.
LIVE = frozenset(c for s in _SLOPPY.values() for c, b in s.table.items() if 0x80 <= b <= 0xF4)


def _decoding(name: str) -> dict[int, str]:
    """byte -> character of a single-byte charset, for the bytes it defines."""
    out = {}
    for b in range(256):
        try:
            out[b] = bytes([b]).decode(name)
        except UnicodeError:
            pass
    return out


def _chains() -> dict[str, dict[str, str]]:
    """Chains that turn each character into one other: name -> table of other than ASCII characters. The bytes of a body
    stand as the characters of their numbers."""
    out = {c: {chr(b): v for b, v in _decoding(c).items() if b >= 128} for c in SINGLE}
    for s in STAGES:
        for t in TARGETS:
            if s != t:
                to = _decoding(t)
                out[f">{s}>{t}"] = {c: to[b] for c, b in _SLOPPY[s].table.items() if b >= 128 and b in to}
    return out


CHAINS = _chains()


def _strict(b: bytes, charset: str, truncated: bool = False) -> str | None:
    try:
        if truncated:
            return codecs.getincrementaldecoder(charset)("strict").decode(b, False)
        return b.decode(charset)
    except UnicodeError:
        return None


class Model:
    """Character trigrams around other than ASCII characters, backing off to shorter ones."""

    def __init__(self, grams: dict[str, int]) -> None:
        one, two, three, ctx = Counter(), Counter(), Counter(), Counter()
        for g, n in grams.items():
            (three if len(g) == 3 else two if len(g) == 2 else one)[g] += n
        for g, n in three.items():
            ctx[g[:2]] += n
        first = Counter()
        for g, n in two.items():
            first[g[0]] += n
        total = sum(one.values()) or 1
        self.one = {g: math.log(n / total * 0.9) for g, n in one.items()}
        self.two = {g: math.log(n / (first[g[0]] + 5)) for g, n in two.items()}
        self.three = {g: math.log(n / (ctx[g[:2]] + 2)) for g, n in three.items()}
        self.none = math.log(1e-7)
        self.empty = not grams
        self.memo: dict[str, dict[tuple[str, int], float]] = {}
        self.size = 0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}, "size": 0}

    def at(self, t: str, i: int) -> float:
        v = self.three.get(t[i - 2 : i + 1]) if i >= 2 else None
        if v is not None:
            return v
        v = self.two.get(t[i - 1 : i + 1]) if i >= 1 else None
        if v is not None:
            return v - 1.0
        v = self.one.get(t[i])
        return (v - 2.0 if v is not None else self.none - 2.0) - (3.0 if t[i] == "�" or "\x80" <= t[i] < "\xa0" else 0.0)

    def score(self, t: str, least: float = -math.inf) -> float:
        """Log-likelihood of the characters that are, or follow, others than ASCII; -inf if it is below `least`."""
        return self.total("", None, segments(t) if least == -math.inf else sorted(segments(t), key=_length), least)

    def total(self, chain: str, to: dict[str, str] | None, parts: list[tuple[str, int]], least: float, of: Callable | None = None) -> float:
        """Score of a text's segments read through a chain of one character for one; -inf where a character has no
        reading, or once the sum is below `least` (no term is positive)."""
        memo = self.memo.get(chain)
        if memo is None:
            memo = self.memo[chain] = {}
        s, of = 0.0, of or self._segment
        for part in parts:
            v = memo.get(part)
            if v is None:
                if self.size >= REMEMBERED:
                    for m in self.memo.values():
                        m.clear()
                    self.size = 0
                self.size += 1
                v = memo[part] = of(part, to)
            s += v
            if s < least:
                return -math.inf
        return s

    def bound(self, t: str, least: float) -> float:
        """What a text, and all that is read again from it, score at most; -inf once the sum is below `least`."""
        return self.total("<", None, sorted(pieces(t), key=_length), least - 1e-6, self._best)  # sums differ by their order

    def _best(self, part: tuple[str, int], to: None) -> float:
        t, off = part
        if not _AGAIN.search(t):
            return self._segment(part, None)
        if len(t) > SHORT:  # characters that are never read again, nor those before them, keep their score
            return sum([self.at(t, i) for i in range(off, len(t)) if LIVE.isdisjoint(t[max(i - 2, 0) : i + 1])])
        out, met, todo = -math.inf, {t}, [t]
        while todo:
            t = todo.pop()
            out = max(out, self._segment((t, off), None))
            for s in _SLOPPY.values() if _AGAIN.search(t) else ():
                r = _runs(t, s)
                if r not in met:
                    met.add(r)
                    todo.append(r)
        return out

    def _segment(self, part: tuple[str, int], to: dict[str, str] | None) -> float:
        t, off = part
        if to is not None:
            read_ = [c if c < "\x80" else to.get(c) for c in t]
            if None in read_:
                return -math.inf
            t = "".join(read_)
        return sum([self.at(t, i) for i in range(off, len(t))])


def segments(t: str) -> list[tuple[str, int]]:
    """(two characters before, the run of other than ASCII characters and the two after it; place from which it counts)
    for each run. No character counts twice."""
    out, done, n = [], 0, len(t)
    for m in _NON.finditer(t):
        a, b = max(m.start(), done), min(m.end() + 2, n)
        if a < b:
            lo = a - 2 if a > 2 else 0
            out.append((t[lo:b], a - lo))
            done = b
    return out


def pieces(t: str) -> list[tuple[str, int]]:
    """(up to two ASCII characters before, the run and the ASCII characters, up to two, after it; place from which it
    counts) for each run of other than ASCII characters. Reading a piece again changes no other piece, so the best scores
    of the pieces bound those of the texts; a character whose context reaches into the run before isn't counted."""
    out, done, n = [], 0, len(t)
    runs = [m.span() for m in _NON.finditer(t)]
    for i, (a, b) in enumerate(runs):
        end = min(b + 2, runs[i + 1][0] if i + 1 < len(runs) else n)
        known = not i or a - done >= 2
        lo = max(a - 2, 0) if known else a
        out.append((t[lo:end], a - lo if known else 2))
        done = b
    return out


def grams_of(t: str, out: Counter) -> None:
    done = -1
    for m in _NON.finditer(t):
        for i in range(max(m.start(), done + 1), min(m.end() + 2, len(t))):
            out[t[i]] += 1
            if i >= 1:
                out[t[i - 1 : i + 1]] += 1
            if i >= 2:
                out[t[i - 2 : i + 1]] += 1
            done = i


def _runs(t: str, stage: _Sloppy) -> str:
    """Sequences that are whole UTF-8 characters in this charset, re-read as such; the rest stays."""

    def one(m: re.Match) -> str:
        b = stage.encode(m.group())
        u = _strict(b, "utf-8") if b is not None else None
        return u if u is not None else m.group()

    return stage.utf8.sub(one, t)


#: Runs of other than ASCII characters met before, and in which stages they hold whole UTF-8 characters.
_HOLDS: dict[str, tuple[str, ...]] = {}


def _stages(t: str) -> set[str]:
    """Stages in which a run of the text reads as UTF-8 again."""
    out: set[str] = set()
    for run in _NON.findall(t):
        got = _HOLDS.get(run)
        if got is None:
            if len(_HOLDS) >= REMEMBERED:
                _HOLDS.clear()
            got = _HOLDS[run] = tuple(s for s in STAGES if len(run) > 1 and _runs(run, _SLOPPY[s]) != run)
        out.update(got)
    return out


def _length(part: tuple[str, int]) -> int:
    return -len(part[0])


def likeliest(model: Model, body: bytes, text: str, parts: list[tuple[str, int]], truncated: bool, least: float) -> tuple[float, str | None, str | None]:
    """(score, chain, text) of the likeliest candidate other than the declared reading that scores at least `least`, the
    first of equals."""
    found: tuple[float, str | None, str | None] = (-math.inf, None, None)
    met, layer = {text}, {text: ""}

    def add(u: str | None, chain: str, must: float) -> bool:
        """Whether the text is a new one that scores what it must."""
        nonlocal found
        if u is None or u in met:
            return False
        met.add(u)
        s = model.score(u, must)
        if s > found[0]:
            found = (s, chain, u)
        return s > -math.inf

    raw = body.decode("latin-1")
    # the longest runs first: a wrong reading falls below what it must reach at once
    by_byte, by_char = sorted(segments(raw), key=_length), sorted(parts, key=_length)
    for name, to in CHAINS.items():
        again = name[0] == ">"
        if model.total(name, to, by_char if again else by_byte, least) > -math.inf:
            u = "".join([c if c < "\x80" else to[c] for c in (text if again else raw)])
            if add(u, name, least):
                layer[u] = name
    whole = [(_strict(body, c, truncated), c) for c in MULTI]
    if b"\x1b$" in body or b"\x1b(" in body:
        whole.append((_strict(body, "iso2022_jp_ext", truncated), "iso2022_jp_ext"))
    for s in STAGES:  # text that was read wrongly and written again
        b = _SLOPPY[s].encode(text)
        if b is not None:
            whole += [(_strict(b, target, truncated), f">{s}>{target}") for target in MULTI_TARGETS]
    for u, chain in whole:
        if add(u, chain, least):
            layer[u] = chain
    while layer:  # ends, as a text that is read again gets shorter
        grown: dict[str, str] = {}
        for t, chain in layer.items():
            holds = _stages(t)
            for s in STAGES:
                if s in holds:
                    u, c = _runs(t, _SLOPPY[s]), f"{chain}>{s}>utf-8"
                    # what is still garbled may score low: it is given up if nothing that comes of it can be the likeliest
                    if u not in met and model.bound(u, max(least, found[0])) > -math.inf:
                        add(u, c, max(least, found[0]))
                        grown[u] = c
                    met.add(u)
        layer = grown
    return found


def looks_clean(text: str) -> bool:
    """No replacement or control characters, and nothing that reads as UTF-8 again in the charsets in which ordinary
    text hardly ever does by chance."""
    if "�" in text or re.search(r"[\x80-\x9f]", text):
        return False
    return not _stages(text) & {"cp1252", "latin-1", "iso8859-15", "cp1250", "cp437"}


def _trusted(content_type: str | None, body: bytes) -> str | None:
    """The text of a clean record: other than ASCII, text, declared and valid as UTF-8 (which other charsets hardly
    ever are by chance), and not encoded twice."""
    if body.isascii() or not is_text(content_type, body) or declared(content_type) != "utf-8":
        return None
    t = _strict(body, "utf-8")
    return t if t is not None and looks_clean(t) else None


def best(model: Model, body: bytes, text: str, truncated: bool) -> tuple[float, str | None, str | None]:
    """(gain for each character in question, chain, restored text) of the likeliest other reading that is likelier than
    the declared one by the least margin."""
    parts = segments(text)
    base = model.total("", None, parts, -math.inf)
    score, chain, restored = likeliest(model, body, text, parts, truncated, base + LEAST_MARGIN)
    if restored is None:
        return -math.inf, None, None
    return (score - base) / max(1, _differing(text, restored)), chain, restored


def _differing(a: str, b: str) -> int:
    """Number of other than ASCII characters of the reading with more of them."""
    return max(sum(map(len, _NON.findall(a))), sum(map(len, _NON.findall(b))), 1) if len(a) == len(b) else max(1, abs(len(a) - len(b)))


def _prepared(df: DataFrame) -> DataFrame:
    return spread(df.where(F.col("body").isNotNull() & (F.length("body") > 0)).select("fetch_id", "content_type", "body", F.coalesce("truncated", F.lit(False)).alias("truncated")))


def train(df: DataFrame) -> tuple[Model, float]:
    """(model, margin). Grams are counted over all clean records but one in HELD, by task and then by key; the margin
    comes from those held out. What reaches the driver is bounded by GRAM_SHARE and by the sketch of gains."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        for pdf in batches:
            for ct, b in zip(pdf["content_type"], pdf["body"]):
                t = _trusted(ct, b)
                if t is not None:
                    grams_of(t, c)
            if len(c) > 500_000:
                yield pd.DataFrame(list(c.items()), columns=["gram", "n"])
                c = Counter()
        if c:
            yield pd.DataFrame(list(c.items()), columns=["gram", "n"])

    rows = _prepared(df)
    held = F.pmod(F.xxhash64("fetch_id"), F.lit(HELD)) == 0
    grams = staged(rows.where(~held).mapInPandas(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    total = grams.agg(F.sum("n")).first()[0] or 0
    model = Model({r.gram: r.n for r in grams.where(F.col("n") >= total * GRAM_SHARE).collect()})
    unstage(grams)
    if model.empty:
        return model, LEAST_MARGIN
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def gains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for ct, b, tr in zip(pdf["content_type"], pdf["body"], pdf["truncated"]):
                t = _trusted(ct, b)
                if t is not None:
                    out.append(max(best(shipped.value, b, t, tr)[0], 0.0))
            yield pd.DataFrame({"gain": out}, dtype="float64")

    r = rows.where(held).mapInPandas(gains, "gain double").agg(F.percentile_approx("gain", 0.97, 10000)).first()
    return model, max(LEAST_MARGIN, float(r[0] if r[0] is not None else 0.0))


def judge(model: Model, margin: float, content_type: str | None, body: bytes, truncated: bool) -> tuple[bool, str | None, str | None]:
    """(garbled, chain, restored text or None)."""
    if body.isascii() and not (b"\x1b$" in body or b"\x1b(" in body) or not is_text(content_type, body):
        return False, None, None
    t = read(body, declared(content_type), truncated)
    if "�" in t and _strict(body, declared(content_type)) is not None:
        return True, None, None  # the replacement character itself is stored: what it replaced is lost
    broken = "�" in t or re.search(r"[\x80-\x9f]|\x1b[$(]", t) is not None
    gain, chain, restored = best(model, body, t, truncated)
    if gain > margin:
        return True, chain, restored
    return broken, None, None


def judged(df: DataFrame) -> DataFrame:
    """fetch_id, garbled, chain, restored for every body."""
    model, margin = train(df)
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple, tuple] = {}
        for pdf in batches:
            rows = []
            for ct, b, tr in zip(pdf["content_type"], pdf["body"], pdf["truncated"]):
                key = (ct, tr, xxhash.xxh3_128_digest(b))
                got = seen.get(key)
                if got is None:
                    if len(seen) >= REMEMBERED // 10:
                        seen.clear()
                    got = judge(shipped.value, margin, ct, b, tr)
                    if not got[0]:  # restored texts aren't held
                        seen[key] = got
                rows.append(got)
            g, c, r = zip(*rows) if rows else ((), (), ())
            yield pd.DataFrame({"fetch_id": pdf["fetch_id"], "garbled": g, "chain": c, "restored": [x.replace("\0", "�").encode("utf-8", "replace").decode() if x is not None else None for x in r]})

    kind = df.schema["fetch_id"].dataType.simpleString()
    return _prepared(df).mapInPandas(run, f"fetch_id {kind}, garbled boolean, chain string, restored string")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "fetch_results")).where("garbled").select("fetch_id").distinct()


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled records with the chain that restores them and the restored text, NULL where it is lost."""
    return judged(table(spark, sf_dir, "fetch_results")).where("garbled").select("fetch_id", "chain", "restored")


QUERIES = {"p5_found": p5_found, "p5_restored": p5_restored}
