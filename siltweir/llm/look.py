"""Problem 2: visually identical text in different characters.

A transducer over grapheme clusters (UAX 29) is compiled once from rules of the Unicode database (widths and other
compatibility forms, canonical decomposition and composition of accents, blanks, characters that show nothing) and a
short list of look-alike letters. Its keys are single characters and whole sequences of a base and its marks; each
cluster, canonically decomposed, is rewritten by longest match in one pass and composed again. So canonically
equivalent texts come out alike whatever the script. Compilation checks for conflicts: every output is a fixed point,
and no plain ASCII letter or digit, case, visible accent or raised digit is changed; verify() checks all code points.

Joiners (U+200C, U+200D) stay where they change what is shown: in scripts that join letters, after a virama and in
emoji sequences. NULL stays NULL, '' stays ''. Texts of any length are read whole. Plain ASCII without blanks at the
ends is its own form and never leaves the JVM; only the rest is passed to Python, in Arrow batches.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltweir.session import staged, table

#: Letters and signs that look like an ASCII one in common fonts and are no compatibility form of it.
LOOK_ALIKES = {
    # Cyrillic, small
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    # Cyrillic, capital
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ӏ": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ԝ": "W", "Х": "X", "Ү": "Y",
    # Greek
    "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϳ": "j", "ϲ": "c",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    # Armenian
    "օ": "o", "հ": "h", "ո": "n", "ս": "u", "ց": "g", "զ": "q", "յ": "j",
    # Latin
    "ɑ": "a", "ɡ": "g", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "ᴜ": "u", "ǃ": "!",
    # signs
    "⁄": "/", "∕": "/", "⧸": "/", "‐": "-", "‒": "-", "–": "-", "−": "-", "⁃": "-", "˗": "-", "∶": ":", "꞉": ":", "։": ":", "׃": ":", "‚": ",", "٫": ",", "∗": "*", "٪": "%", "⁓": "~", "∼": "~", "ˌ": ",", "ˍ": "_", "⸵": ";", "۔": ".", "٠": ".", "܁": ".",
}

#: Raised digits don't look like plain ones and are kept.
RAISED = "²³¹⁰⁴⁵⁶⁷⁸⁹"
#: Marks of category Cf that are drawn.
DRAWN_CF = {0x600, 0x601, 0x602, 0x603, 0x604, 0x605, 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
#: Characters of other categories that show nothing.
EMPTY = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x2065, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0), *range(0xFFF0, 0xFFF9)}
#: Controls that are blanks.
BLANK_CC = {9, 10, 11, 12, 13, 0x85, 0x2028, 0x2029, 0x2800}

PLAIN = r"^([!-~]([ -~]*[!-~])?)?\z"


_CLUSTER = regex.compile(r"\X")
#: Scripts whose letters join, so that a joiner between them is seen.
_JOINS = regex.compile(r"[\p{Arabic}\p{Syriac}\p{Mongolian}\p{Nko}\p{Mandaic}\p{Manichaean}\p{Phags_Pa}\p{Adlam}\p{Hanifi_Rohingya}\p{Sogdian}]")
_PICTURE = regex.compile(r"\p{Extended_Pictographic}")
JOINERS = "\u200c\u200d"
#: Ideographs, syllables and private characters, which stand for themselves or are composed by algorithm.
_PLAIN_RANGES = ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7A4), (0xD800, 0xF900), (0x17000, 0x18D80), (0x20000, 0x2F800), (0x2FA20, 0xE0000), (0xE01F0, 0x110000))


def code_points():
    at = 0
    for a, b in _PLAIN_RANGES:
        yield from range(at, a)
        at = b


class Transducer:
    """Longest-match rewriting of grapheme clusters."""

    def __init__(self) -> None:
        self.keys: dict[str, str] = {"\x7f": ""}
        for cp in range(32):
            self.keys[chr(cp)] = " " if cp in BLANK_CC else ""
        for cp in code_points():
            if cp < 0x80:
                continue
            ch = chr(cp)
            cat = unicodedata.category(ch)
            if cp in BLANK_CC or cat == "Zs":
                to = " "
            elif cp in EMPTY or cat == "Cc" or (cat == "Cf" and cp not in DRAWN_CF):
                to = ""
            elif cat == "Cn" or ch in RAISED:
                continue
            else:
                to = self._mapped(unicodedata.normalize("NFKC", ch))
            if to != ch:
                self.keys[ch] = to
        # sequences: what a composed character decomposes to is rewritten as one
        for cp in code_points():
            d = unicodedata.normalize("NFD", chr(cp)) if cp >= 0x80 else ""
            if len(d) > 1:
                to = unicodedata.normalize("NFC", "".join(self.keys.get(x, x) for x in d))
                if to != d:
                    self.keys[d] = to
        self.longest = max(map(len, self.keys))
        self.memo: dict[str, str] = {}
        self.check()

    @staticmethod
    def _mapped(s: str) -> str:
        """Compatibility forms and look-alikes of each character, until nothing changes."""
        for _ in range(8):
            d = unicodedata.normalize("NFKD", s) if not any(x in RAISED for x in s) else s
            t = unicodedata.normalize("NFC", "".join(" " if unicodedata.category(x) == "Zs" else LOOK_ALIKES.get(x, x) for x in d))
            if t == s:
                break
            s = t
        return s

    def check(self) -> None:
        """Raise if the mapping conflicts with itself or with what must stay apart."""
        for key, to in self.keys.items():
            if key.isascii() and key.isprintable():
                raise ValueError(f"{key!r} is plain and must stay")
            if self.apply(to, strip=False) != to:
                raise ValueError(f"{key!r} -> {to!r} is not a fixed point")
            if len(to) == 1 and key in LOOK_ALIKES and key.isupper() != to.isupper():
                raise ValueError(f"{key!r} -> {to!r} changes case")
        for x in RAISED:
            if x in self.keys:
                raise ValueError(f"{x!r} is raised and must stay")

    def verify(self) -> list[str]:
        """Characters whose form isn't that of their decomposition, or isn't its own form. Hangul syllables included."""
        bad = []
        for cp in (*code_points(), *range(0xAC00, 0xD7A4), *range(0x2F800, 0x2FA20)):
            ch = chr(cp)
            form = self.apply(ch, strip=False)
            if form != self.apply(unicodedata.normalize("NFD", ch), strip=False) or form != self.apply(form, strip=False):
                bad.append(ch)
        return bad

    def _joiner_stays(self, c: str, i: int, last: bool) -> bool:
        if i == 0 or last and i + 1 == len(c):
            return False
        before = c[i - 1]
        if unicodedata.combining(before) == 9 or _JOINS.match(c[0]):
            return True
        return c[i] == "\u200d" and i + 1 < len(c) and _PICTURE.match(c[0]) is not None and _PICTURE.match(c[i + 1]) is not None

    def cluster(self, c: str, last: bool) -> str:
        """One decomposed cluster: the longest key at each place is rewritten, then base and marks are composed."""
        out, i, n = [], 0, len(c)
        while i < n:
            if c[i] in JOINERS and self._joiner_stays(c, i, last):
                out.append(c[i])
                i += 1
                continue
            for j in range(min(n, i + self.longest), i, -1):
                to = self.keys.get(c[i:j])
                if to is not None:
                    out.append(to)
                    i = j
                    break
            else:
                out.append(c[i])
                i += 1
        return unicodedata.normalize("NFC", "".join(out))

    def apply(self, text: str, strip: bool = True) -> str:
        parts = _CLUSTER.findall(unicodedata.normalize("NFD", text))
        out, memo = [], self.memo
        for k, c in enumerate(parts):
            if len(c) == 1 and " " <= c <= "~":
                out.append(c)
                continue
            last = k + 1 == len(parts)
            m = None if last else memo.get(c)
            if m is None:
                m = self.cluster(c, last)
                if not last and len(memo) < 65536:
                    memo[c] = m
            out.append(m)
        s = unicodedata.normalize("NFC", "".join(out))  # what showed nothing may have stood between base and mark
        return s.strip(" ") if strip else s


@lru_cache(1)
def transducer() -> Transducer:
    return Transducer()


@F.pandas_udf(T.StringType())
def _form(s: pd.Series) -> pd.Series:
    t = transducer()
    return s.map(lambda x: None if x is None else t.apply(x))


def plain(text: Column) -> Column:
    return text.rlike(PLAIN)


def shown_form(text: Column) -> Column:
    """The one form of all texts that look like this one."""
    return F.coalesce(_form(F.when(~plain(text), text)), text)


def consistent(df: DataFrame, fields: tuple[str, ...] = ("url", "domain"), suffix: str = "_form") -> DataFrame:
    """df with a column <field>_form for each field. A column of that name in the input is replaced."""
    return df.withColumns({f + suffix: shown_form(F.col(f)) for f in fields})


def look_pairs(df: DataFrame, key: str = "row_id", fields: tuple[str, ...] = ("url", "domain"), salts: int = 8) -> DataFrame:
    """(field, key_a, key_b): rows whose values differ but look the same.

    A value that is its own form is called settled. Of two values that look alike at least one is unsettled, and
    these are few, so only (unsettled, settled) and (unsettled, unsettled) pairs are joined, on a 128-bit fingerprint
    of the form. The settled side of a hot form is spread over `salts` parts, the small side repeated on each."""
    longs = [df.select(F.lit(f).alias("field"), F.col(key).alias("id"), F.col(f).alias("v")).where(F.col("v").isNotNull()) for f in fields]
    odd = longs[0].where(~plain(F.col("v")))
    for x in longs[1:]:
        odd = odd.unionByName(x.where(~plain(F.col("v"))))
    odd = staged(odd.withColumn("form", _form(F.col("v"))), "odd-forms")
    fp = lambda c: [F.xxhash64("field", F.lit(17), c).alias("h1"), F.xxhash64("field", F.lit(91), c).alias("h2")]
    loose = odd.where("v <> form").select("field", "id", *fp("form"), F.xxhash64("v").alias("hv"), F.xxhash64("v", F.lit(5)).alias("hv2"))
    settled = [x.where(plain(F.col("v"))).select("field", "id", *fp("v")) for x in longs]
    fixed = odd.where("v = form").select("field", "id", *fp("form"))
    for x in settled:
        fixed = fixed.unionByName(x)
    fixed = fixed.withColumn("salt", F.pmod(F.col("id"), F.lit(salts)).cast("int"))
    spread = loose.select("field", F.col("id").alias("id2"), "h1", "h2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    one = fixed.join(spread, ["field", "h1", "h2", "salt"]).select("field", "id", "id2")
    # two unsettled rows: pair the distinct values of a form first, then expand to rows
    values = loose.select("field", "h1", "h2", "hv", "hv2").distinct()
    other = values.withColumnsRenamed({"hv": "gv", "hv2": "gv2"})
    each = F.sequence(F.lit(0), F.lit(salts - 1))
    vp = values.join(other, ["field", "h1", "h2"]).where("(hv, hv2) < (gv, gv2)").withColumn("s", F.explode(each)).withColumn("t", F.explode(each))
    salt = F.pmod(F.col("id"), F.lit(salts)).cast("int")
    left = loose.select("field", "h1", "h2", "hv", "hv2", "id", salt.alias("s"))
    right = loose.select("field", "h1", "h2", F.col("hv").alias("gv"), F.col("hv2").alias("gv2"), F.col("id").alias("id2"), salt.alias("t"))
    two = vp.join(left, ["field", "h1", "h2", "hv", "hv2", "s"]).join(right, ["field", "h1", "h2", "gv", "gv2", "t"]).select("field", "id", "id2")
    return one.unionByName(two).select("field", F.least("id", "id2").alias(f"{key}_a"), F.greatest("id", "id2").alias(f"{key}_b"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_pairs(table(spark, sf_dir, "run_b6_experiments"))


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's url and domain in their one form, and whether they were changed."""
    x = consistent(table(spark, sf_dir, "run_b6_experiments").select("row_id", "url", "domain"))
    return x.select("row_id", "url_form", "domain_form", (F.col("url") != F.col("url_form")).alias("url_changed"), (F.col("domain") != F.col("domain_form")).alias("domain_changed"))


QUERIES = {"p2_found": p2_found, "p2_forms": p2_forms}
