"""Problem 7: filling fixed-capacity containers with items.

Lexical retrieval packing (Shi et al. 2023): documents are dealt to shards of bounded size, by language and then by
hash. Each shard gets a BM25 inverted index; the largest unused document seeds a container, its unused neighbours by
BM25 are taken greedily while they fit, and what space is left is closed by the unused item that fills it best.
A document larger than the capacity is cut into full containers and a rest, and only the rest is packed.

Sizes are UTF-8 bytes. NULL and empty texts have size 0 and ride along in the shard's first containers. Every item
comes out exactly once, in one container; no container exceeds the capacity. Ties are broken by key. Rows with the same key are
items of their own. Memory and time follow the shard: a shard takes whole documents up to SHARD_BYTES, and a hot
language or source is spread over as many shards as it needs.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltweir.llm.mixing import byte_size
from siltweir.llm.pieces import _limits
from siltweir.session import table

#: Bytes of text in one shard.
SHARD_BYTES = 4_000_000
#: Terms are hashed into this many slots.
TERMS = 1 << 20
K1, B = 1.2, 0.75
WORD = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_]+")


class Index:
    """BM25 over the documents of a shard: postings by term, weights precomputed."""

    def __init__(self, texts: list[str]) -> None:
        n = len(texts)
        doc, term = [], []
        for i, t in enumerate(texts):
            words = WORD.findall(t.lower())
            term.append(np.fromiter((crc32(w.encode("utf-8", "surrogatepass")) % TERMS for w in words), np.int64, len(words)))
            doc.append(np.full(len(words), i, np.int64))
        length = np.array([len(x) for x in term], float)
        key, tf = np.unique(np.concatenate(term) * n + np.concatenate(doc), return_counts=True) if n else (np.zeros(0, np.int64), np.zeros(0))
        t, self.doc = key // max(n, 1), (key % max(n, 1)).astype(np.int32)
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, np.int64)
        self.start, df = first, np.diff(np.append(first, len(t)))
        self.end = first + df
        idf = np.log((n - df + 0.5) / (df + 0.5))
        row = np.repeat(np.arange(len(first)), df)
        norm = K1 * (1 - B + B * length / max(length.mean() if n else 1, 1e-9))
        # a term in half of the documents or more has no positive weight and retrieves nothing
        self.weight = (np.maximum(idf, 0)[row] * tf * (K1 + 1) / (tf + norm[self.doc])).astype(np.float32)
        order = np.argsort(self.doc, kind="stable")
        self.of = row[order][(idf > 0)[row[order]]]
        counts = np.bincount(self.doc[order][(idf > 0)[row[order]]], minlength=n)
        self.at = np.concatenate([[0], np.cumsum(counts)])
        self.n = n

    def scores(self, i: int) -> np.ndarray:
        """BM25 of all documents for the whole text of document i."""
        out = np.zeros(self.n, np.float32)
        for r in self.of[self.at[i] : self.at[i + 1]].tolist():
            a, b = self.start[r], self.end[r]
            out[self.doc[a:b]] += self.weight[a:b]
        return out


def pack(texts: list[str], sizes: list[int], capacity: int, how: dict[int, str] | None = None) -> list[list[int]]:
    """Containers as lists of item numbers, for items no larger than the capacity. `how` gets for each item whether it
    was a seed, was retrieved as a neighbour, or was taken because it fits."""
    how = {} if how is None else how
    ix = Index(texts)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    unused = np.ones(len(sizes), bool)
    size = np.array(sizes, np.int64)
    left = sorted((s, i) for i, s in enumerate(sizes) if s > 0)  # unused items by size
    zero = [i for i, s in enumerate(sizes) if s == 0]
    out: list[list[int]] = []

    count: dict[int, int] = {}  # unused items of each size
    for s, _ in left:
        count[s] = count.get(s, 0) + 1

    def take(i: int, as_: str) -> None:
        unused[i] = False
        how[i] = as_
        count[sizes[i]] -= 1
        j = bisect_left(left, (sizes[i], i))
        del left[j]

    def first_of_two(room: int, j: int) -> int | None:
        """The larger of two unused items that close the room exactly, from the largest that fits."""
        while j >= 0 and 2 * left[j][0] >= room:
            a = left[j][0]
            if a != room and count.get(room - a, 0) > (room - a == a):
                return left[j][1]
            j = bisect_left(left, (a, -1)) - 1
        return None

    for seed in order:
        if not unused[seed] or sizes[seed] == 0:
            continue
        take(seed, "seed")
        box, room = [seed], capacity - sizes[seed]
        if left and left[0][0] <= room:
            s = ix.scores(seed)
            fit = np.flatnonzero(unused & (size <= room) & (size > 0) & (s > 0))
            near = fit[np.lexsort((fit, -s[fit]))]
            for i in near.tolist():
                # keep for the end what closes the gap best
                if sizes[i] <= room:
                    # stop retrieval when one unused item closes what is left exactly
                    j = bisect_left(left, (room, -1))
                    if j < len(left) and left[j][0] == room:
                        break
                    take(i, "retrieved")
                    box.append(i)
                    room -= sizes[i]
                    if room == 0 or not left or left[0][0] > room:
                        break
            while left and left[0][0] <= room:  # best fit for the rest, from the largest that fits
                j = bisect_right(left, (room, len(sizes))) - 1
                i = left[j][1]
                # two items that close the gap exactly are better than the largest one alone
                if left[j][0] != room and (first := first_of_two(room, j)) is not None:
                    i = first
                take(i, "fit")
                box.append(i)
                room -= sizes[i]
        out.append(box)
    if zero:
        if not out:
            out.append([])
        for k, i in enumerate(zero):
            out[k % len(out)].append(i)
    return out


def containers(docs: DataFrame, capacity: int, key: str = "doc_id", text: str = "text", language: str = "lang", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """container, place (order in it), key, piece_no (0: the whole document), start, end (bytes), how (seed, retrieved,
    fit, cut, empty), size. Tasks are as many as shards, so none grows with the input."""
    d = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.lower(F.coalesce(F.substring(F.trim(language), 1, 2), F.lit(""))).alias("l"), byte_size(F.col(text)).alias("n"))
    # shards by running bytes over languages; within one the place is drawn from the key
    per = d.groupBy("l").agg(F.sum(F.col("n") + 1).alias("bytes")).withColumn("begin", F.coalesce(F.sum("bytes").over(W.orderBy("l").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    place = F.col("begin") + F.pmod(F.xxhash64("k", "t"), F.lit(1 << 20)) / F.lit(float(1 << 20)) * F.col("bytes")
    shards = d.join(per, "l").withColumn("shard", F.floor(place / shard_bytes).cast("long")).select("shard", "k", "t")
    total = d.agg(F.sum(F.col("n") + 1)).first()[0] or 0
    shards = shards.repartition(int(total // shard_bytes) + 1, "shard")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "t"], kind="stable")
        shard, keys = int(pdf["shard"].iloc[0]), pdf["k"].tolist()
        rows, texts, items = [], [], []
        box = 0
        for k, t in zip(keys, pdf["t"]):
            b = t.encode("utf-8", "surrogatepass")
            if len(b) <= capacity:
                items.append((k, 0, 0, len(b)))
                texts.append(t)
                continue
            start, no = 0, 0
            while len(b) - start > capacity:
                end = start + capacity
                while (b[end] & 0xC0) == 0x80:  # at a character
                    end -= 1
                no += 1
                rows.append((f"{shard}-{box}", 1, k, no, start, end, "cut"))
                box += 1
                start = end
            items.append((k, no + 1, start, len(b)))
            texts.append(b[start:].decode("utf-8", "replace"))
        how: dict[int, str] = {}
        for c in pack(texts, [x[3] - x[2] for x in items], capacity, how):
            rows += [(f"{shard}-{box}", p, *items[i], how.get(i, "empty")) for p, i in enumerate(c, 1)]
            box += 1
        out = pd.DataFrame(rows, columns=["container", "place", key, "piece_no", "start", "end", "how"])
        return out.assign(size=out["end"] - out["start"])

    kind = docs.schema[key].dataType.simpleString()
    return shards.groupBy("shard").applyInPandas(run, f"container string, place int, {key} {kind}, piece_no int, start long, end long, how string, size long")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers(table(spark, sf_dir, "documents"), _limits(spark, sf_dir, "fill")[0])


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, bytes, unused share and the shares of the bytes that were retrieved as neighbours or taken to fit."""
    capacity = _limits(spark, sf_dir, "fill")[0]
    c = p7_containers(spark, sf_dir)
    of = lambda h: F.coalesce(F.sum(F.when(F.col("how") == h, F.col("size"))), F.lit(0))
    per = c.groupBy("container").agg(F.sum("size").alias("size"), of("retrieved").alias("r"), of("fit").alias("f"))
    per = per.agg(F.count("*").alias("containers"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.sum("r").alias("r"), F.sum("f").alias("f"))
    n = F.nullif(F.col("bytes"), F.lit(0))
    return per.select("containers", "bytes", (F.col("r") / n).alias("retrieved_share"), (F.col("f") / n).alias("fit_share"), (1 - F.col("bytes") / F.nullif(F.col("containers") * F.lit(capacity), F.lit(0))).alias("unused_share"))


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill}
