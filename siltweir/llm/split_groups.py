"""Problem 1: splits that keep related records together.

Records and the sources and entities they name form a bipartite graph. Its components are found by parallel hooking
and shortcutting over a parent table (Shiloach and Vishkin 1982); whole components go to a split, chosen by subset-sum
bitsets over the multiplicities of component sizes.

Nulls: a record without a source is joined by its entity alone, one without an entity by its source alone, and one
without both is a component of its own. Empty input gives an empty result. Repeated rows count as records. Ties of
size are broken by the order of component labels. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from siltweir.functions import hosts
from siltweir.session import staged, table, unstage

#: Sizes up to this total are summed exactly; larger components are first placed greedily (see choose_sizes).
MAX_BITS = 1 << 29
#: Hash buckets in which components of one size are numbered, so that no window holds them all.
RANK_BUCKETS = 256


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the edge table; root is the smallest node of the component.

    Each round hooks every root to the smallest neighbouring root, shortcuts the parents until all trees are stars,
    and rewrites the edges onto roots; edges within a tree fall away. Edges are pre-aggregated before each shuffle
    (distinct, min), so a hub of any degree is combined map-side."""
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    nodes = e.select(F.col("a").alias("node")).union(e.select(F.col("b").alias("node"))).distinct()
    live = staged(e.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    parent = staged(nodes.select("node", F.col("node").alias("root")), "parents")
    while True:  # each round at least halves the roots that touch another
        # hook: the larger root of an edge takes the smallest root it touches
        hook = staged(live.groupBy(F.col("hi").alias("v")).agg(F.min("lo").alias("p")), "hook")
        if hook.isEmpty():
            unstage(hook)
            unstage(live)
            return parent
        while True:  # shortcut: p(v) = p(p(p(v))) until nothing changes
            up = hook
            for i in (2, 3):
                up = up.join(hook.select(F.col("v").alias(f"v{i}"), F.col("p").alias(f"p{i}")), F.col("p") == F.col(f"v{i}"), "left").withColumn("p", F.coalesce(f"p{i}", "p")).drop(f"v{i}")
            nxt = staged(up.select("v", "p", F.col("p3").isNotNull().alias("moved")), "hook")
            moved = not nxt.where("moved").isEmpty()
            unstage(hook)
            hook = nxt.drop("moved")
            if not moved:
                break
        to = hook.select(F.col("v").alias("root"), F.col("p").alias("new"))
        parent2 = staged(parent.join(to, "root", "left").select("node", F.coalesce("new", "root").alias("root")), "parents")
        lo = live.join(to.select(F.col("root").alias("lo"), F.col("new").alias("lo2")), "lo", "left").select("hi", F.coalesce("lo2", "lo").alias("lo"))
        hi = lo.join(to.select(F.col("root").alias("hi"), F.col("new").alias("hi2")), "hi", "left").select(F.coalesce("hi2", "hi").alias("x"), F.col("lo").alias("y"))
        live2 = staged(hi.where("x <> y").select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(), "edges")
        unstage(parent)
        unstage(live)
        unstage(hook)
        parent, live = parent2, live2


def source_edges(rows: DataFrame) -> DataFrame:
    """Source pairs that share an entity, as a star per entity: (smallest source, source). One aggregate and one join
    on distinct (source, entity); an entity with many sources is never gathered."""
    se = rows.where("source is not null and entity is not null").select("source", "entity").distinct()
    first = se.groupBy("entity").agg(F.min("source").alias("first"))
    return se.join(first, "entity").select(F.col("first").alias("a"), F.col("source").alias("b"))


def with_entity(df: DataFrame, suffixes: DataFrame) -> DataFrame:
    """row_id, source, entity of each record."""
    rows = df.select("row_id", "source", "domain", "url")
    return hosts.with_entity(rows, "domain", "url", "entity", hosts.suffix_list(suffixes)).select("row_id", "source", "entity")


def related_sources(df: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(source, component) for every source; component is its smallest source. Self edges keep sources that stand
    alone."""
    return components(source_edges(staged(with_entity(df, suffixes), "entities"))).select(F.col("node").alias("source"), F.col("root").alias("component"))


def _reach(items: list[tuple[int, int]], cap: int) -> int:
    """Bitset of the sums up to cap that subsets of the items (size, copies taken together) reach."""
    mask, bits = (1 << (cap + 1)) - 1, 1
    for s, k in items:
        if s * k <= cap:
            bits |= (bits << (s * k)) & mask
    return bits


def _meet(a: int, b: int, total: int, width: int = 1 << 20) -> int:
    """The least s in a whose complement total - s is in b, found piece by piece."""
    for off in range(0, total + 1, width):
        w = min(width, total + 1 - off)
        x = (a >> off) & ((1 << w) - 1)
        if x:
            y = (b >> (total - off - w + 1)) & ((1 << w) - 1)
            x &= int(bin(y)[2:].zfill(w)[::-1], 2)
            if x:
                return off + (x & -x).bit_length() - 1
    raise ValueError("no such sum")


def _subset_counts(sizes: list[tuple[int, int]], target: int) -> dict[int, int]:
    """How many components of each (size, multiplicity) to take so that the total comes closest to target. Bitset
    subset sum over binary-split multiplicities, up to 2 x target, as no nearest sum lies beyond. Which items make up
    the sum is found by halving the items: two bitsets are held at a time, whatever their number."""
    if target <= 0 or not sizes:
        return {}
    cap = 2 * target + 1
    items = []
    for s, m in sizes:
        k, m = 1, min(m, cap // s)
        while m > 0:
            k = min(k, m)
            items.append((s, k))
            m -= k
            k *= 2
    reach = _reach(items, cap)
    best = (reach & ((1 << (target + 1)) - 1)).bit_length() - 1
    above = reach >> target
    if above:
        up = target + (above & -above).bit_length() - 1
        best = up if up - target < target - best else best
    del reach, above
    taken: dict[int, int] = {}
    todo = [(items, best)]
    while todo:
        part, total = todo.pop()
        if total == 0:
            continue
        if len(part) == 1:
            s, k = part[0]
            taken[s] = taken.get(s, 0) + k
            continue
        half = len(part) // 2
        s = _meet(_reach(part[:half], total), _reach(part[half:], total), total)
        todo += [(part[:half], s), (part[half:], total - s)]
    return taken


def choose_sizes(hist: list[tuple[int, int]], shares: tuple[float, ...]) -> list[dict[int, int]]:
    """For each split but the first: size -> number of components. hist is (size, multiplicity) and is small by
    nature: distinct sizes s that add up to n records number at most sqrt(2 n).

    Splits are filled from the smallest share up. Where a target exceeds MAX_BITS, components are first placed
    largest first until the rest fits the bitset; the bitset then settles the remainder exactly."""
    left = dict(sorted(hist, reverse=True))
    n = sum(s * m for s, m in left.items())
    out: list[dict[int, int]] = [{} for _ in shares]
    for i in sorted(range(1, len(shares)), key=lambda j: shares[j]):
        target = round(n * shares[i])
        got: dict[int, int] = {}
        for s in list(left):
            if target <= MAX_BITS:
                break
            k = min(left[s], (target - MAX_BITS // 2) // s)
            if k > 0:
                got[s] = k
                target -= k * s
        rest = [(s, m - got.get(s, 0)) for s, m in left.items() if m > got.get(s, 0)]
        for s, k in _subset_counts(rest, target).items():
            got[s] = got.get(s, 0) + k
        for s, k in got.items():
            left[s] -= k
        out[i] = got
    return out


def assign_splits(df: DataFrame, suffixes: DataFrame, names: tuple[str, ...] = ("train", "validation", "test"), shares: tuple[float, ...] = (0.8, 0.1, 0.1)) -> DataFrame:
    """row_id, source, entity, component, split. No source and no entity lies in two splits."""
    spark = df.sparkSession
    rows = staged(with_entity(df, suffixes), "entities")
    src = components(source_edges(rows)).withColumnRenamed("node", "source").withColumnRenamed("root", "comp")
    se = rows.where("source is not null and entity is not null").groupBy("entity").agg(F.min("source").alias("source"))
    ent = se.join(src, "source").select("entity", F.col("comp").alias("ecomp"))
    # sources without any entity aren't in the graph; they stand for themselves
    comp = (
        rows.join(src, "source", "left").join(ent, "entity", "left")
        .select("row_id", "source", "entity", F.coalesce(
            F.when(F.col("source").isNotNull(), F.concat(F.lit("s:"), F.coalesce("comp", "source"))),
            F.when(F.col("ecomp").isNotNull(), F.concat(F.lit("s:"), "ecomp")),
            F.concat(F.lit("e:"), "entity"), F.concat(F.lit("r:"), F.col("row_id").cast("string"))).alias("component"))
    )
    comp = staged(comp, "components")
    sizes = staged(comp.groupBy("component").agg(F.count("*").alias("size")).withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(RANK_BUCKETS))), "sizes")
    hist = [(r["size"], r["n"]) for r in sizes.groupBy("size").agg(F.count("*").alias("n")).collect()]
    chosen = choose_sizes(hist, shares)
    cuts, rows_ = {}, []
    for i, got in enumerate(chosen):
        for s, k in got.items():
            start = cuts.get(s, 0)
            rows_.append((int(s), int(start), int(start + k), names[i]))
            cuts[s] = start + k
    plan = spark.createDataFrame(rows_, T.StructType([T.StructField("size", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("split", T.StringType())]))
    # rank within a size: offset of its hash bucket plus rank in the bucket
    per = sizes.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    offset = per.withColumn("offset", F.sum("n").over(W.partitionBy("size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))).select("size", "bucket", F.coalesce("offset", F.lit(0)).alias("offset"))
    ranked = sizes.withColumn("r", F.row_number().over(W.partitionBy("size", "bucket").orderBy("component")) - 1).join(offset, ["size", "bucket"]).withColumn("r", F.col("r") + F.col("offset"))
    # at most two cuts a size: an equi-join on size, then a range test
    split = ranked.join(plan, (ranked["size"] == plan["size"]) & (F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi")), "left").select("component", F.coalesce("split", F.lit(names[0])).alias("split"))
    return comp.join(split, "component").select("row_id", "source", "entity", "component", "split")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources that must share a split. The pairs of a component are the result that is asked for."""
    c = staged(related_sources(table(spark, sf_dir, "run_axis_s"), table(spark, sf_dir, "public_suffix")), "related")
    n = c.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    c = c.join(n, "component", "left_semi")
    a, b = c.select("component", F.col("source").alias("source_a")), c.select("component", F.col("source").alias("source_b"))
    return a.join(b, "component").where("source_a < source_b").select("source_a", "source_b")


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_splits(table(spark, sf_dir, "run_axis_s"), table(spark, sf_dir, "public_suffix"))


def p1_split_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, components and share of each split."""
    s = staged(p1_splits(spark, sf_dir), "splits")
    n = s.groupBy("split").agg(F.count("*").alias("records"), F.count_distinct("component").alias("components"))
    return n.withColumn("share", F.col("records") / F.sum("records").over(W.partitionBy()))


QUERIES = {"p1_found": p1_found, "p1_splits": p1_splits, "p1_split_shares": p1_split_shares}
