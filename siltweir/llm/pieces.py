"""Problem 9: splitting oversized items at natural boundaries.

Lexical-cohesion segmentation (Hearst 1997): at every natural boundary (paragraph, line, sentence) the vocabulary of
the sentences before is compared with that of the sentences after; valleys of this similarity mark topic boundaries.
Within each window of the size limit the deepest valley is cut; each piece begins with the last bytes of the one
before.

Sizes are UTF-8 bytes. NULL and empty texts, and texts within the limit, yield no pieces. Where a window has no
sentence boundary the last blank is cut, else the last character that fits; no character is ever split. A piece never
exceeds the limit and repeats at least the overlap (up to three bytes more, to begin at a character). Work and memory
follow the window, so a text of any length is read whole. Repeated rows yield repeated pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltweir.llm.mixing import byte_size
from siltweir.session import table

#: Ends of paragraphs, lines and sentences, in UTF-8; the cut lies behind the match.
BOUNDARY = re.compile(rb"\n[ \t\r]*\n\s*|\n|(?:[.!?\xe2\x80\xa6]+[\"')\]]*|[.!?][\"')\]]*(?:\xe2\x80[\x9c\x9d\x99]|\xc2\xbb))[ \t]+|(?:\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)(?:\xe3\x80[\x8d\x8f])?")
BLANK = re.compile(rb"[ \t]+|\xe3\x80\x80|\xe3\x80\x81|\xef\xbc\x8c")
#: Words of one- and two-byte letters; three- and four-byte characters one by one.
WORD = re.compile(rb"(?:[A-Za-z0-9]|[\xc3-\xdf][\x80-\xbf])+|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
SIDE = 4
#: A piece is filled at least this far where a boundary allows; the deepest valley beyond is cut.
LEAST_FILL = 0.5
#: Added to the depth of a valley at a line or paragraph end.
LINE, PARAGRAPH = 0.15, 0.4


def _depths(window: bytes, ends: list[int]) -> np.ndarray:
    """Depth of the similarity valley at each boundary but for the window's own ends."""
    k = len(ends)
    marks = np.array(ends)
    at, dim = [], []
    for m in WORD.finditer(window):
        at.append(m.start())
        dim.append(crc32(m.group().lower()))
    rows = np.searchsorted(marks, np.array(at, dtype=np.int64), side="right")
    words, ids = np.unique(np.array(dim, dtype=np.int64), return_inverse=True)  # each word of the window is a dimension
    n = max(len(words), 1)
    counts = np.bincount(rows * n + ids, minlength=(k + 1) * n).reshape(k + 1, n).astype(np.float32)
    total = np.zeros((k + 2, n), np.float32)
    np.cumsum(counts, axis=0, out=total[1:])
    i = np.arange(1, k + 1)
    before = total[i] - total[np.maximum(i - SIDE, 0)]
    after = total[np.minimum(i + SIDE, k + 1)] - total[i]
    norm = np.sqrt((before**2).sum(1) * (after**2).sum(1))
    sim = np.divide((before * after).sum(1), norm, out=np.zeros(k, np.float32), where=norm > 0)
    # the nearest peak on either side, climbing while the similarity rises
    left, right = sim.copy(), sim.copy()
    for j in range(1, k):
        if sim[j - 1] >= sim[j]:
            left[j] = left[j - 1]
    for j in range(k - 2, -1, -1):
        if sim[j + 1] >= sim[j]:
            right[j] = right[j + 1]
    return (left - sim) + (right - sim)


def _cut(b: bytes, start: int, least: int, limit: int) -> int:
    """Where the piece that begins at start ends: in (least, start + limit]."""
    stop = start + limit
    window = b[start : min(len(b), stop + 2048)]
    found = [(m.end(), m.group()) for m in BOUNDARY.finditer(window)]
    ends = [e for e, _ in found if e < len(window)]
    for low in (max(least, start + int(limit * LEAST_FILL)), least):
        ok = [j for j, e in enumerate(ends) if low < start + e <= stop]
        if ok:
            depth = _depths(window, ends)
            kind = [PARAGRAPH if found[j][1].count(b"\n") > 1 else LINE if b"\n" in found[j][1] else 0.0 for j in ok]
            best = max(range(len(ok)), key=lambda x: (round(float(depth[ok[x]]) + kind[x], 6), ok[x]))
            return start + ends[ok[best]]
    blanks = [m.end() for m in BLANK.finditer(window) if least < start + m.end() <= stop]
    if blanks:
        return start + blanks[-1]
    e = stop
    while e > least + 1 and (b[e] & 0xC0) == 0x80:
        e -= 1
    return e


def cut_text(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Byte ranges of the pieces; one range if the text is within the limit."""
    if not 0 <= overlap + 4 < limit:
        raise ValueError("the overlap must be smaller than the limit by more than a character")
    b = text.encode("utf-8", "surrogatepass")
    out, start, end = [], 0, 0
    while len(b) - start > limit:
        end = _cut(b, start, end, limit)
        out.append((start, end))
        start = end - overlap
        while start > 0 and (b[start] & 0xC0) == 0x80:
            start -= 1
        start = max(start, 0)
    if not out or end < len(b):
        out.append((start, len(b)))
    return out


def pieces(docs: DataFrame, limit: int, overlap: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece_no, start, end (bytes), piece for every text above the limit. No shuffle: one pass over the rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["k"], pdf["t"]):
                b = t.encode("utf-8", "surrogatepass")
                rows += [(k, i, s, e, b[s:e].decode("utf-8", "replace")) for i, (s, e) in enumerate(cut_text(t, limit, overlap), 1)]
            yield pd.DataFrame(rows, columns=[key, "piece_no", "start", "end", "piece"])

    big = docs.where(byte_size(F.col(text)) > limit).select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = docs.schema[key].dataType.simpleString()
    return big.mapInPandas(run, f"{key} {kind}, piece_no int, start long, end long, piece string")


def _limits(spark: SparkSession, sf_dir: str, purpose: str) -> tuple[int, int]:
    r = table(spark, sf_dir, "size_limits").where(F.col("purpose") == purpose).agg(F.min("limit_tokens"), F.min("overlap_tokens")).first()
    return int(r[0]), int(r[1] or 0)


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(table(spark, sf_dir, "documents"), *_limits(spark, sf_dir, "cut"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that had to be cut: those with a first piece."""
    return p9_pieces(spark, sf_dir).where("piece_no = 1").select("doc_id").distinct()


QUERIES = {"p9_found": p9_found, "p9_pieces": p9_pieces}

SQL = {"p9_found": "SELECT DISTINCT doc_id FROM documents WHERE octet_length(encode(text)) > (SELECT min(limit_tokens) FROM size_limits WHERE purpose = 'cut')"}
