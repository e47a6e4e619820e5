"""Relational verbs over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltweir.operators import relational as R
from siltweir.operators.ordered import ranked
from siltweir.session import table as t


def filter_project(s, d):
    return t(s, d, "lineitem").where((F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("l_discount") >= 0.05)).select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


def pricing_summary(s, d):
    x = t(s, d, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(net), 2).alias("sum_net"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count("*").alias("n"))


def inner_join_nation(s, d):
    x = t(s, d, "orders").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.groupBy("r_name", "n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def anti_join_customers(s, d):
    big = t(s, d, "orders").where("o_totalprice > 200000")
    return t(s, d, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


def semi_join_suppliers(s, d):
    big = t(s, d, "lineitem").where("l_quantity >= 45")
    return t(s, d, "supplier").join(big, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey", "s_nationkey")


def reserved_sets(s, d):
    """Chained exclusion: rows go to the first set that claims them."""
    x = t(s, d, "part").select("p_partkey", "p_size", "p_brand")
    a = x.where("p_size > 40")
    b = x.where("p_size > 20").join(a, "p_partkey", "left_anti")
    c = x.join(a, "p_partkey", "left_anti").join(b, "p_partkey", "left_anti")
    return a.withColumn("set", F.lit("a")).unionByName(b.withColumn("set", F.lit("b"))).unionByName(c.withColumn("set", F.lit("c"))).groupBy("set").agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))


def distinct_keep_first(s, d):
    return R.keep_first(t(s, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity"), ["l_partkey"], ["l_orderkey", "l_linenumber"])


def value_counts_top(s, d):
    return t(s, d, "part").groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type").limit(10)


def sources_per_domain(s, d):
    return t(s, d, "run_b6_experiments").where("domain is not null").groupBy("domain").agg(F.count_distinct("source").alias("sources"), F.count("*").alias("n")).where("sources >= 3")


def rank_slice(s, d):
    """Ranks 11 to 30: the best 30 are taken by partition first, only these are ranked."""
    best = t(s, d, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(30)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("s_acctbal"), "s_suppkey"))).where("rank > 10").select("rank", "s_suppkey")


def top_k_per_group(s, d):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t(s, d, "orders").withColumn("r", F.row_number().over(w)).where("r <= 3").select("o_custkey", "o_orderkey", "r")


def stratified_sample(s, d):
    return R.sample_per_stratum(t(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 50)


def stratified_split(s, d):
    x = R.split_per_stratum(t(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 0.2)
    return x.groupBy("o_orderpriority", "part").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def pivot_status(s, d):
    return t(s, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


def fill_and_days(s, d):
    x = t(s, d, "run_b6_experiments")
    return x.select("row_id", F.coalesce("domain", F.lit("")).alias("domain"), R.days_between(F.col("submission_time"), F.col("ingested_at")).alias("days"))


def every_nth(s, d):
    return ranked(t(s, d, "customer").select("c_custkey"), ["c_custkey"], "r").where((F.col("r") - 1) % 7 == 0).select("c_custkey")


def interleave(s, d):
    """Two streams of records as one, in order of time: each row with its place in the merged order."""
    a = t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("at"), F.lit("c").alias("kind"))
    b = t(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("at"), F.lit("s").alias("kind"))
    return ranked(a.unionByName(b), ["at", "kind", "id"], "place").select("place", "kind", "id")


def ordered_distinct_list(s, d):
    x = t(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("l"))
    return x.select("l_orderkey", F.array_join(F.array_distinct(F.transform("l", lambda v: v["l_returnflag"])), ",").alias("flags"))


def equal_chunks(s, d):
    return R.chunks(t(s, d, "events").select("event_id", "ts", "value"), ["ts", "event_id"], 6).groupBy("chunk").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


def rank_bins(s, d):
    return R.quantile_bins(t(s, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey", 4).groupBy("bin").agg(F.count("*").alias("n"))


def unordered_pairs(s, d):
    n = t(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    m = n.withColumnsRenamed({"n_nationkey": "k", "n_name": "m_name", "n_regionkey": "r"})
    return n.join(m, (F.col("n_regionkey") == F.col("r")) & (F.col("n_name") < F.col("m_name"))).select("n_name", "m_name")


def constants_product(s, d):
    p = s.createDataFrame([(0.01,), (0.001,), (0.0001,)], "prevalence double")
    return t(s, d, "region").select("r_name").crossJoin(F.broadcast(p))


def set_operations(s, d):
    o, l = t(s, d, "orders").select(F.col("o_custkey").alias("k")), t(s, d, "customer").select(F.col("c_custkey").alias("k"))
    f = lambda df, n: df.agg(F.count("*").alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("keys")).withColumn("op", F.lit(n))
    return f(o.union(l).distinct(), "union").unionByName(f(l.subtract(o), "except")).unionByName(f(o.intersect(l), "intersect")).unionByName(f(o.union(l), "union_all"))


def suffix_filter(s, d):
    return t(s, d, "run_axis_s").where(F.col("domain").endswith(".com.example")).groupBy("source").agg(F.count("*").alias("n"))


def running_totals(s, d):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, 0)
    return t(s, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("running"))


def rollup_sales(s, d):
    x = t(s, d, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return x


def merge_sink(s, d):
    old = t(s, d, "duplicate_accuracy").where("reported_at < timestamp_ntz'2024-01-01'").select("corpus", "split", "n_before")
    new = t(s, d, "duplicate_accuracy").where("reported_at >= timestamp_ntz'2024-01-01' and corpus <> 'Tranco'").select("corpus", "split", "n_before")
    return R.merge_by_key(old, new, "corpus")


def json_props(s, d):
    x = t(s, d, "events").select("event_type", F.get_json_object("props", "$.k").alias("k"))
    return x.groupBy("event_type").agg(F.count("k").alias("with_k"), F.count("*").alias("n"))


def range_lookup(s, d):
    """Age bins as a range join against a small table of edges."""
    b = s.createDataFrame([(0, 100000, "low"), (100000, 200000, "mid"), (200000, 10**9, "high")], "lo long, hi long, bin string")
    return t(s, d, "orders").join(F.broadcast(b), (F.col("o_totalprice") >= F.col("lo")) & (F.col("o_totalprice") < F.col("hi"))).groupBy("bin").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (filter_project, pricing_summary, inner_join_nation, anti_join_customers, semi_join_suppliers, reserved_sets, distinct_keep_first, value_counts_top, sources_per_domain, rank_slice, top_k_per_group, stratified_sample, stratified_split, pivot_status, fill_and_days, every_nth, interleave, ordered_distinct_list, equal_chunks, rank_bins, unordered_pairs, constants_product, set_operations, suffix_filter, running_totals, rollup_sales, merge_sink, json_props, range_lookup)}

_H = "((o_orderkey * 1103515245 + 12345) % 2147483647)"
SQL = {
    "filter_project": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' AND l_discount >= 0.05",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, round(avg(l_discount), 6) AS avg_discount, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "inner_join_nation": "SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "anti_join_customers": "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
    "semi_join_suppliers": "SELECT s_suppkey, s_nationkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 45)",
    "reserved_sets": "SELECT CASE WHEN p_size > 40 THEN 'a' WHEN p_size > 20 THEN 'b' ELSE 'c' END AS set, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size FROM part GROUP BY 1",
    "distinct_keep_first": "SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1",
    "value_counts_top": "SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 10",
    "sources_per_domain": "SELECT domain, count(DISTINCT source) AS sources, count(*) AS n FROM run_b6_experiments WHERE domain IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) >= 3",
    "rank_slice": "SELECT rank, s_suppkey FROM (SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS INT) AS rank FROM supplier) WHERE rank > 10 AND rank <= 30",
    "top_k_per_group": "SELECT o_custkey, o_orderkey, CAST(r AS INT) AS r FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3",
    "stratified_sample": f"SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_H}, o_orderkey) AS r FROM orders) WHERE r <= 50",
    "stratified_split": f"SELECT o_orderpriority, CASE WHEN r <= floor(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS part, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_H}, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) GROUP BY 1, 2",
    "pivot_status": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1",
    "fill_and_days": "SELECT row_id, coalesce(domain, '') AS domain, coalesce(CAST(floor((epoch_us(ingested_at) - epoch_us(submission_time)) / 86400000000) AS BIGINT), -1) AS days FROM run_b6_experiments",
    "every_nth": "SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) WHERE (r - 1) % 7 = 0",
    "interleave": "SELECT row_number() OVER (ORDER BY ts, kind, id) AS place, kind, id FROM (SELECT c_acctbal AS ts, 'c' AS kind, c_custkey AS id FROM customer UNION ALL SELECT s_acctbal, 's', s_suppkey FROM supplier)",
    "ordered_distinct_list": "SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY f, l_returnflag) AS flags FROM (SELECT l_orderkey, l_returnflag, min(l_linenumber) AS f FROM lineitem GROUP BY 1, 2) GROUP BY 1",
    "equal_chunks": "SELECT CAST(chunk AS INT) AS chunk, count(*) AS n, min(event_id) AS first FROM (SELECT event_id, ntile(6) OVER (ORDER BY ts, event_id) AS chunk FROM events) GROUP BY 1",
    "rank_bins": "SELECT CAST(greatest(ceil((r - 1) * 4 / (n - 1)::DOUBLE) - 1, 0) AS INT) AS bin, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY p_retailprice, p_partkey) AS r, count(*) OVER () AS n FROM part) GROUP BY 1",
    "unordered_pairs": "SELECT a.n_name, b.n_name AS m_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name",
    "constants_product": "SELECT r_name, prevalence FROM region, (VALUES (0.01::DOUBLE), (0.001::DOUBLE), (0.0001::DOUBLE)) p(prevalence)",
    "set_operations": """WITH o AS (SELECT o_custkey AS k FROM orders), l AS (SELECT c_custkey AS k FROM customer)
SELECT 'union' AS op, count(*) AS n, CAST(coalesce(sum(k), 0) AS BIGINT) AS keys FROM (SELECT k FROM o UNION SELECT k FROM l) UNION ALL SELECT 'except', count(*), CAST(coalesce(sum(k), 0) AS BIGINT) FROM (SELECT k FROM l EXCEPT SELECT k FROM o)
UNION ALL SELECT 'intersect', count(*), CAST(coalesce(sum(k), 0) AS BIGINT) FROM (SELECT k FROM o INTERSECT SELECT k FROM l) UNION ALL SELECT 'union_all', count(*), CAST(coalesce(sum(k), 0) AS BIGINT) FROM (SELECT k FROM o UNION ALL SELECT k FROM l)""",
    "suffix_filter": "SELECT source, count(*) AS n FROM run_axis_s WHERE suffix(domain, '.com.example') GROUP BY 1",
    "running_totals": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders",
    "rollup_sales": "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)",
    "merge_sink": "WITH a AS (SELECT corpus, split, n_before FROM duplicate_accuracy WHERE reported_at < TIMESTAMP '2024-01-01'), b AS (SELECT corpus, split, n_before FROM duplicate_accuracy WHERE reported_at >= TIMESTAMP '2024-01-01' AND corpus <> 'Tranco') SELECT * FROM a WHERE corpus NOT IN (SELECT corpus FROM b) UNION ALL SELECT * FROM b",
    "json_props": "SELECT event_type, count(json_extract_string(props, '$.k')) AS with_k, count(*) AS n FROM events GROUP BY 1",
    "range_lookup": "SELECT CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 200000 THEN 'mid' ELSE 'high' END AS bin, count(*) AS n FROM orders WHERE o_totalprice >= 0 AND o_totalprice < 1000000000 GROUP BY 1",
}
