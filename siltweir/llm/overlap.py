"""Problem 3: same or near-same records across splits.

Evaluation texts are packed into shards of bounded size, by their number of distinct shingles, and each shard gets a
compressed full-text index (fmindex.py). Training texts stream through the shards by backward search. A training text
is cut, from its end, into factors that are extended until few places of the shard match: maximal stretches that are
still rare. The matching spans are merged and counted for each pair of texts, and pairs with enough factors in common
are checked exactly.

Why enough factors suffice: if two texts share at least t of all distinct k-character substrings found in either,
then at most s * (1 - t) / t of them (s those of the training text) are in one text only. Every edit that breaks an
inner factor leaves four or more of them in one text only; the outermost factor may break for one. So of the K
factors at least K - (1 + (H - 1 + r) // 4) are whole in the other text, where H is that bound and r the number of
repeated substrings. Where K is too small for this, longer lists of places are allowed (8 times as many) until it is
large enough; nothing is dropped.

Nulls: rows without split or text take no part. A text shorter than k is its own only substring. Equal texts are
searched once, then expanded to rows. Empty input gives an empty result. Case is folded with Spark's lower().
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from siltweir.llm.fmindex import FMIndex, code_points
from siltweir.operators.dedup import near_pairs
from siltweir.session import shared_dir, staged, table

#: Characters of evaluation text in one shard; bounds the memory of the task that indexes it (about 60 bytes each).
SHARD_CHARS = 5_000_000
#: Training texts that a task holds at once.
CHUNK = 25_000


def shingles(text: str, k: int = 4) -> set[str]:
    return {text[i : i + k] for i in range(len(text) - k + 1)} if len(text) >= k else {text}


def _grams(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the text, hash) of every k-character substring, and the number of texts."""
    points = code_points(texts).astype(np.uint64)
    end = np.flatnonzero(points == 0)
    who = np.repeat(np.arange(len(end)), np.diff(end, prepend=-1))
    n = max(len(points) - k + 1, 0)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = (h ^ points[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    whole = end[who[:n]] - np.arange(n) >= k
    return who[:n][whole], h[whole], len(end)


def distinct_counts(texts: list[str], k: int = 4) -> np.ndarray:
    """Number of distinct k-character substrings of each text; 1 for a text shorter than k. Substrings are told apart by
    40 bits of a hash, so a count may be short by one in about a billion texts; what is reported is counted exactly."""
    who, h, n = _grams(texts, k)
    key = (who.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))
    return np.maximum(np.bincount((_distinct(key) >> np.uint64(40)).astype(np.int64), minlength=n), 1)


#: Bits that stand for the substrings of a text.
BITS = 256


def bitmaps(texts: list[str], k: int = 4) -> np.ndarray:
    """One bit of BITS for each substring of a text, as rows of words. A bit that the partner lacks is a substring that it
    lacks."""
    out = []
    for at in range(0, len(texts), 20_000):
        who, h, n = _grams(texts[at : at + 20_000], k)
        m = np.zeros((n, BITS), bool)
        m[who, (h >> np.uint64(40)).astype(np.int64) % BITS] = True
        out.append(np.packbits(m, axis=1).view(np.uint64))
    return np.concatenate(out) if out else np.zeros((0, BITS // 64), np.uint64)


def _may_share(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Whether texts of a and b substrings with these bitmaps can have so many in common."""
    lack = np.bitwise_count(x & ~y).sum(1, dtype=np.int64)
    lack2 = np.bitwise_count(y & ~x).sum(1, dtype=np.int64)
    return (a - lack >= common - 1e-9) & (b - lack2 >= common - 1e-9)


def _distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting in place; faster here than hashing."""
    a.sort()
    return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def distinct_texts(rows: DataFrame) -> DataFrame:
    """One row a text: 128-bit fingerprint and the text."""
    return rows.groupBy("h1", "h2").agg(F.first("text").alias("text"))


def build_shards(texts: DataFrame, folder: str, shard_chars: int) -> list[dict]:
    """Index the texts in shards under the folder; the driver gets a line of figures for each shard."""
    sized = texts.withColumn("n", F.length("text"))
    # texts of about equal length share a shard; lengths are bucketed, so this list is short whatever the corpus
    width = F.when(F.col("n") < 4096, F.col("n")).otherwise(4096 + F.log2(F.col("n")).cast("int"))
    sized = sized.withColumn("w", width.cast("int"))
    per = sized.groupBy("w").agg(F.sum(F.col("n") + 1).alias("chars"))
    upto = F.sum("chars").over(W.orderBy("w").rowsBetween(W.unboundedPreceding, -1))
    begin = per.select("w", "chars", F.coalesce(upto, F.lit(0)).alias("begin"))
    # within a bucket the place is drawn from the fingerprint, so a bucket larger than a shard is spread over several
    place = F.col("begin") + F.pmod("h1", F.lit(1 << 20)) / F.lit(float(1 << 20)) * F.col("chars")
    shards = sized.join(begin, "w").withColumn("shard", F.floor(place / shard_chars).cast("long")).select("shard", "h1", "h2", "text")

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        _KEPT.clear()
        texts_ = pdf["text"].tolist()
        blob = FMIndex.build(texts_).dump()
        s = distinct_counts(texts_).tolist()
        path = f"{folder}/{uuid.uuid4().hex}"
        f, p = _open(path)
        f.create_dir(p.rsplit("/", 1)[0], recursive=True)
        with f.open_output_stream(p + ".fm") as out:
            out.write(blob)
        import pyarrow as pa
        import pyarrow.parquet as pq

        pq.write_table(pa.Table.from_pandas(pdf[["h1", "h2", "text"]].assign(n=s, bits=[r.tobytes() for r in bitmaps(texts_)]), preserve_index=False), p + ".texts", filesystem=f)
        return pd.DataFrame({"path": [path], "least": [min(s)], "most": [max(s)], "texts": [len(s)]})

    out = shards.groupBy("shard").applyInPandas(index, "path string, least long, most long, texts long")
    return [r.asDict() for r in out.collect()]


#: Shards that a Python worker keeps for its next task, newest last, and their bytes in all.
_KEPT: dict[str, tuple[FMIndex, pd.DataFrame]] = {}
KEEP_BYTES = 200_000_000


def _load(path: str) -> tuple[FMIndex, pd.DataFrame]:
    if path not in _KEPT:
        got = _read(path)
        while _KEPT and sum(x.nbytes() for x, _ in _KEPT.values()) + got[0].nbytes() > KEEP_BYTES:
            del _KEPT[next(iter(_KEPT))]
        _KEPT[path] = got
    return _KEPT[path]


def _read(path: str) -> tuple[FMIndex, pd.DataFrame]:
    import pyarrow.parquet as pq

    f, p = _open(path)
    with f.open_input_stream(p + ".fm") as x:
        blob = x.read()
    return FMIndex.load(blob), pq.read_table(p + ".texts", filesystem=f).to_pandas()


def _candidates(ix: FMIndex, texts: list[str], s: np.ndarray, t: float, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(training number, evaluation number) of pairs that share enough factors."""
    points = code_points(texts)
    codes = ix.alphabet.codes(points)
    end = np.flatnonzero(points == 0)
    start = np.concatenate([[0], end[:-1] + 1]).astype(np.int64)
    n = end - start
    bound = np.floor(s * (1 - t) / t + 1e-9).astype(np.int64) + np.maximum(n - k + 1 - s, 0)
    broken = 1 + np.maximum(bound - 1, 0) // 4
    todo, most = np.flatnonzero(n > 0), 8
    while len(todo):
        who, lo, hi, _ = ix.factors(codes, start[todo], end[todo], most)
        got = np.bincount(who, minlength=len(todo))
        enough = (got > broken[todo]) | (most >= ix.n)
        need = np.maximum(got - broken[todo], 1)
        use = enough[who] & (hi > lo)
        w, a, b = who[use], lo[use], hi[use]
        # merge the spans: one line per (text, factor, evaluation text), then count factors by pair
        size = (b - a).astype(np.int64)
        if len(size):
            at = np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            doc = ix.doc[at].astype(np.int64)
            factor = np.repeat(np.arange(len(w)), size)
            width = int(ix.doc.max()) + 1
            factor, doc = np.divmod(_distinct(factor * width + doc), width)
            each = w[factor].astype(np.int64) * width + doc
            each.sort()
            first = np.flatnonzero(np.concatenate([[True], each[1:] != each[:-1]]))
            hits = np.diff(np.append(first, len(each)))
            who_, doc_ = np.divmod(each[first], width)
            keep = hits >= need[who_]
            yield todo[who_[keep]], doc_[keep]
        todo, most = todo[~enough], most * 8


def exact_texts(train: DataFrame, evaluation: DataFrame, threshold: float = 0.8, k: int = 4) -> DataFrame:
    """What near_texts gives, by an exact join on rare substrings instead of the index: nothing is missed whatever the
    order of substrings, at several times the cost and disk."""
    side = lambda df, n: df.select(F.col("text").alias("t"), F.struct("h1", "h2").alias(n))
    both = train.select("text").union(evaluation.select("text")).distinct().withColumn("k", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit(5), "text"))
    ids = both.withColumn("id", F.concat_ws("-", F.hex("k"), F.hex("k2"))).select("id", "text")
    pairs = near_pairs(ids, "id", "text", threshold, k)
    pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity")).unionByName(ids.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity")))
    a = side(train, "x").join(ids.withColumnRenamed("text", "t"), "t").select(F.col("id").alias("a"), "x")
    b = side(evaluation, "y").join(ids.withColumnRenamed("text", "t"), "t").select(F.col("id").alias("b"), "y")
    return pairs.join(a, "a").join(b, "b").select(F.col("x.h1").alias("a1"), F.col("x.h2").alias("a2"), F.col("y.h1").alias("b1"), F.col("y.h2").alias("b2"), "similarity")


def near_texts(train: DataFrame, evaluation: DataFrame, threshold: float = 0.8, k: int = 4, shard_chars: int = SHARD_CHARS, exact: bool = False) -> DataFrame:
    """(a1, a2, b1, b2, similarity): fingerprints of training and evaluation texts that share at least `threshold` of
    all distinct k-character substrings. Both inputs have h1, h2, text, one row a text. With `exact` the bound on broken
    factors isn't relied on (see exact_texts)."""
    if exact:
        return exact_texts(train, evaluation, threshold, k)
    spark = train.sparkSession
    folder = f"{shared_dir(spark)}/fm-{uuid.uuid4().hex}"
    shards = sorted(build_shards(evaluation.where(F.length("text") >= k), folder, shard_chars), key=lambda x: (x["least"], x["path"]))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def run(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
            s, own_bits = distinct_counts(pdf["text"].tolist(), k), bitmaps(pdf["text"].tolist(), k)
            for sh in sorted(shards, key=lambda x: x["path"] not in _KEPT):
                fit = np.flatnonzero((s * threshold <= sh["most"] + 1e-9) & (sh["least"] * threshold <= s + 1e-9))
                if not len(fit):
                    continue
                ix, there = _load(sh["path"])
                bits = np.frombuffer(b"".join(there["bits"]), np.uint64).reshape(-1, BITS // 64)
                th1, th2, tt, size = there["h1"].to_numpy(), there["h2"].to_numpy(), there["text"].tolist(), there["n"].to_numpy()
                other: dict[int, set[str]] = {}
                own: dict[int, set[str]] = {}
                texts = pdf["text"].tolist()
                for x in range(0, len(fit), CHUNK):
                    part = fit[x : x + CHUNK]
                    rows = []
                    for a, b in _candidates(ix, [texts[i] for i in part], s[part], threshold, k):
                        u, v = s[part[a]], size[b]
                        may = _may_share(own_bits[part[a]], bits[b], u, v, threshold / (1 + threshold) * (u + v))
                        for i, j in zip(part[a[may]].tolist(), b[may].tolist()):
                            y = other.get(j)
                            if y is None:
                                if len(other) > 20_000:
                                    other.clear()
                                y = other[j] = shingles(tt[j], k)
                            if i not in own:
                                own.clear()
                                own[i] = shingles(texts[i], k)
                            both = len(own[i] & y)
                            sim = both / (len(own[i]) + len(y) - both)
                            if sim >= threshold - 1e-12:
                                rows.append((i, j, sim))
                    if rows:
                        i, j, sim = (np.array(c) for c in zip(*rows))
                        yield pd.DataFrame({"a1": pdf["h1"].to_numpy()[i], "a2": pdf["h2"].to_numpy()[i], "b1": th1[j], "b2": th2[j], "similarity": sim})

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= 4 * CHUNK:
                yield from run(pd.concat(held, ignore_index=True))
                held, n = [], 0
        if held:
            yield from run(pd.concat(held, ignore_index=True))

    found = train.where(F.length("text") >= k).select("h1", "h2", "text").mapInPandas(search, "a1 long, a2 long, b1 long, b2 long, similarity double")
    # a text shorter than k is its own only substring, which no other text has
    short = F.length("text") < k
    x, y = train.where(short).select(F.col("h1").alias("a1"), F.col("h2").alias("a2")), evaluation.where(short).select(F.col("h1").alias("b1"), F.col("h2").alias("b2"))
    equal = x.join(y, (F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2"))).select("a1", "a2", "b1", "b2", F.lit(1.0).alias("similarity"))
    out = staged(found.unionByName(equal), "near")
    f, p = _open(folder)
    if f.get_file_info(p).type == fs.FileType.Directory:
        f.delete_dir(p)
    return out


def _rows(df: DataFrame, text: str, split: str, key: str) -> DataFrame:
    t = F.lower(F.col(text))
    return df.where(F.col(split).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(split).alias("split"), F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(3), t).alias("h2"), t.alias("text"))


def cross_split(df: DataFrame, text: str = "url", split: str = "split", key: str = "row_id", train: str = "train", evaluation: tuple[str, ...] = ("validation", "test"), **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs of texts, training rows, evaluation rows); the rows carry id, split and the fingerprint."""
    rows = _rows(df, text, split, key)
    a, b = rows.where(F.col("split") == train), rows.where(F.col("split").isin(*evaluation))
    parts = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ta = distinct_texts(a).repartition(parts, "h1")
    pairs = near_texts(ta, distinct_texts(b), **how)
    return pairs, a.drop("text"), b.drop("text")


def expand(pairs: DataFrame, a: DataFrame, b: DataFrame, key: str, salts: int = 8) -> DataFrame:
    """Row pairs of the text pairs. A text that many rows share is spread over `salts` parts of its rows."""
    p = pairs.select("a1", "a2", "b1", "b2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    x = a.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("id").alias("x"), F.pmod("id", F.lit(salts)).cast("int").alias("salt"))
    y = b.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("id").alias("y"))
    return p.join(x, ["a1", "a2", "salt"]).join(y, ["b1", "b2"]).select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, a, b = cross_split(table(spark, sf_dir, "run_b6_experiments"))
    return expand(pairs, a, b, "row_id")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each evaluation split and source: rows, rows left when those that stand in train are dropped, and the rate
    of the dropped ones, beside the rate last reported."""
    df = table(spark, sf_dir, "run_b6_experiments")
    pairs, _, b = cross_split(df)
    seen = pairs.select(F.col("b1").alias("h1"), F.col("b2").alias("h2")).distinct().withColumn("seen", F.lit(1))
    b = b.join(df.select(F.col("row_id").alias("id"), "source"), "id").join(seen, ["h1", "h2"], "left")
    now = b.groupBy("split", "source").agg(F.count("*").alias("n_before"), F.count_if(F.col("seen").isNull()).alias("n_after"))
    old = table(spark, sf_dir, "duplicate_accuracy").groupBy(F.col("split").alias("s"), F.col("corpus").alias("c")).agg(F.max_by("near_duplicate_rate", "reported_at").alias("reported_rate"))
    return now.join(old, F.col("split").eqNullSafe(F.col("s")) & F.col("source").eqNullSafe(F.col("c")), "left").select("split", "source", "n_before", "n_after", (1 - F.col("n_after") / F.col("n_before")).alias("near_duplicate_rate"), "reported_rate")


QUERIES = {"p3_found": p3_found, "p3_report": p3_report}

SQL = {
    # exact set join by prefix filter: the rarest substrings of a text, as many as can be missing from its partner and one
    "p3_found": """
WITH src AS (SELECT row_id, split, lower(url) AS t FROM run_b6_experiments WHERE split IS NOT NULL AND url IS NOT NULL),
one AS (SELECT t, min(row_id) AS k FROM src GROUP BY t),
g AS (SELECT k, list_distinct(list_transform(range(1, greatest(length(t) - 3, 1)::BIGINT + 1), lambda i: substr(t, i, 4))) AS g FROM one),
e AS (SELECT k, unnest(g) AS x FROM g), f AS (SELECT x, count(*) AS df FROM e GROUP BY x),
r AS (SELECT e.k, e.x, row_number() OVER (PARTITION BY e.k ORDER BY df, e.x) AS r, count(*) OVER (PARTITION BY e.k) AS n FROM e JOIN f ON e.x = f.x),
p AS (SELECT k, x FROM r WHERE r <= n - ceil(0.8 * n - 1e-9) + 1),
c AS (SELECT DISTINCT a.k AS a, b.k AS b FROM p a JOIN p b ON a.x = b.x AND a.k < b.k),
j AS (SELECT a, b, len(list_intersect(ga.g, gb.g)) AS i, len(ga.g) + len(gb.g) AS n FROM c JOIN g ga ON c.a = ga.k JOIN g gb ON c.b = gb.k),
near AS (SELECT a, b FROM j WHERE 5 * i >= 4 * (n - i) UNION ALL SELECT k, k FROM one),
pairs AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
m AS (SELECT row_id, split, k FROM src JOIN one ON src.t = one.t)
SELECT DISTINCT least(x.row_id, y.row_id) AS row_id_a, greatest(x.row_id, y.row_id) AS row_id_b FROM pairs JOIN m x ON x.k = pairs.a JOIN m y ON y.k = pairs.b WHERE x.split = 'train' AND y.split IN ('validation', 'test')
""",
}
