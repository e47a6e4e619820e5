"""Fitting and scoring with Spark ML behind two callables, so that splits and cascades take any model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltweir.operators.evaluation import roc_auc

Fit = Callable[[DataFrame, list[str], str], object]


def fit_linear(df: DataFrame, features: list[str], label: str) -> object:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__f", handleInvalid="keep"), StandardScaler(inputCol="__f", outputCol="__x", withMean=True), LogisticRegression(featuresCol="__x", labelCol=label, probabilityCol="__p", rawPredictionCol="__r", predictionCol="__y", maxIter=50)]).fit(df)


def fit_trees(df: DataFrame, features: list[str], label: str, rounds: int = 20, depth: int = 4) -> object:
    """Boosted trees; a substitute for the boosters of other libraries, not equal to them bit by bit."""
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__x"), GBTClassifier(featuresCol="__x", labelCol=label, maxIter=rounds, maxDepth=depth, seed=0, predictionCol="__y").setRawPredictionCol("__r").setProbabilityCol("__p")]).fit(df)


def fit_perceptron(df: DataFrame, features: list[str], label: str, hidden: int = 64) -> object:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__f"), StandardScaler(inputCol="__f", outputCol="__x", withMean=True), MultilayerPerceptronClassifier(featuresCol="__x", labelCol=label, layers=[len(features), hidden, 2], seed=0, probabilityCol="__p", rawPredictionCol="__r", predictionCol="__y")]).fit(df)


def score(model: object, df: DataFrame, out: str = "score") -> DataFrame:
    x = model.transform(df).withColumn(out, vector_to_array("__p")[1])
    return x.drop(*[c for c in x.columns if c.startswith("__")])


def cascade(first: object, second: object, df: DataFrame, route: float = 0.1) -> DataFrame:
    """df with stage1, routed and score: rows from the routing threshold up get the second stage's score. Only routed
    rows reach the second model; the union needs no shuffle."""
    x = score(first, df, "stage1").withColumn("routed", F.col("stage1") >= route)
    return score(second, x.where("routed"), "score").unionByName(x.where("not routed").withColumn("score", F.col("stage1")))


def contributions(model: object, features: list[str], df: DataFrame, key: str) -> DataFrame:
    """(key, feature, contribution) of a linear model: coefficient times standardised value."""
    lin, scaler = model.stages[-1], model.stages[-2]
    mean, std, w = scaler.mean.toArray(), scaler.std.toArray(), lin.coefficients.toArray()
    parts = [F.struct(F.lit(f).alias("feature"), ((F.col(f) - float(mean[i])) / float(std[i] or 1.0) * float(w[i])).alias("contribution")) for i, f in enumerate(features)]
    return df.select(key, F.explode(F.array(*parts)).alias("c")).select(key, "c.feature", "c.contribution")


def importance_variance(fit: Fit, df: DataFrame, features: list[str], label: str, part: str, key: str, least: int = 20) -> DataFrame:
    """(feature, sigma2): variance over partitions of the loss of AUC when the feature is permuted within the
    partition. One fit; per feature one pass. Partitions with few rows or one class are left out."""
    model = fit(df, features, label)
    ok = df.groupBy(part).agg(F.count("*").alias("n"), F.count_distinct(label).alias("k")).where((F.col("n") >= least) & (F.col("k") == 2)).select(part)
    d = df.join(F.broadcast(ok), part)
    base = roc_auc(score(model, d), "score", label, (part,)).withColumnRenamed("auc", "base")
    out = None
    from pyspark.sql import Window as W

    for f in features:
        # permutation: the value of the row at the same place in another order
        a = d.withColumn("__i", F.row_number().over(W.partitionBy(part).orderBy(key)))
        b = d.select(part, F.row_number().over(W.partitionBy(part).orderBy(F.xxhash64(F.lit(f), key), key)).alias("__i"), F.col(f).alias("__v"))
        x = a.join(b, [part, "__i"]).withColumn(f, F.col("__v")).drop("__i", "__v")
        loss = base.join(roc_auc(score(model, x), "score", label, (part,)), part).agg(F.coalesce(F.var_pop(F.col("base") - F.col("auc")), F.lit(0.0)).alias("sigma2")).withColumn("feature", F.lit(f))
        out = loss if out is None else out.unionByName(loss)
    return out.select("feature", "sigma2")
