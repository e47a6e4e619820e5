"""Model queries over the lexical columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltweir.functions import hosts, lexical as L
from siltweir.operators import evaluation as E
from siltweir.operators import models as M
from siltweir.session import staged, table

FEATURES = ["url_length", "num_dots", "num_hyphens", "num_digits", "num_params", "entropy_url", "digit_ratio", "num_suspicious_tokens", "num_subdomains"]


def _data(s, d):
    x = table(s, d, "run_b6_experiments").where("split is not null and url is not null").select("row_id", "url", "label", "source", "split")
    return staged(L.lexical(x, "url", hosts.suffix_list(table(s, d, "public_suffix")), fuzzy=False).select("row_id", "label", "source", "split", *FEATURES), "features")


def model_linear(s, d):
    x = _data(s, d)
    m = M.fit_linear(x.where("split = 'train'"), FEATURES, "label")
    return E.roc_auc(M.score(m, x), "score", "label", ("split",))


def model_cascade(s, d):
    x = _data(s, d)
    t = x.where("split = 'train'")
    c = M.cascade(M.fit_linear(t, FEATURES, "label"), M.fit_trees(t, FEATURES, "label", 5, 3), x.where("split = 'test'"), 0.5)
    return c.groupBy("routed").agg(F.count("*").alias("n"), F.avg("score").alias("avg_score"))


def model_contributions(s, d):
    x = _data(s, d)
    m = M.fit_linear(x.where("split = 'train'"), FEATURES, "label")
    c = M.contributions(m, FEATURES, x.where("split = 'test'").select("row_id", "label", *FEATURES), "row_id")
    return c.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))


def leave_one_source_out(s, d):
    x = _data(s, d)
    out = None
    for (src,) in x.groupBy("source").agg(F.count_distinct("label").alias("k")).where("source is not null and k = 2").select("source").orderBy("source").collect():
        m = M.fit_linear(x.where(F.col("source") != src), FEATURES, "label")
        r = E.roc_auc(M.score(m, x.where(F.col("source") == src)), "score", "label").withColumn("source", F.lit(src))
        out = r if out is None else out.unionByName(r)
    return out if out is not None else s.createDataFrame([], "auc double, source string")


QUERIES = {f.__name__: f for f in (model_linear, model_cascade, model_contributions, leave_one_source_out)}
SQL: dict = {}
