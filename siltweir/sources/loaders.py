"""Sources and sinks with explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltweir.operators.relational import merge_by_key


def labelled_csv(spark: SparkSession, path: str, released: str, source: str, url: str = "URL", label: str = "label") -> DataFrame:
    """CSV of addresses and labels in which 0 marks the harmful ones; one release date for all rows."""
    x = spark.read.option("header", True).schema(f"{url} string, {label} int").option("enforceSchema", False).csv(path)
    return x.select(F.col(url).alias("url"), F.when(F.col(label) == 0, 1).otherwise(0).alias("label"), F.lit(released).cast("timestamp_ntz").alias("timestamp"), F.lit(source).alias("source"))


def feed_csv(spark: SparkSession, path: str, source: str) -> DataFrame:
    """CSV of url and submission_time (UTC); all rows harmful. Unreadable times become NULL."""
    x = spark.read.option("header", True).csv(path, schema="url string, submission_time string")
    t = F.try_to_timestamp(F.col("submission_time"))
    return x.select("url", F.lit(1).alias("label"), F.to_utc_timestamp(t, "UTC").cast("timestamp_ntz").alias("timestamp"), F.lit(source).alias("source"))


def ranked_csv(spark: SparkSession, path: str, source: str, lo: int = 0, hi: int = 100_000, stamp: str | None = None) -> DataFrame:
    """Headerless rank, domain; ranks above lo up to hi, by the rank column. All rows harmless."""
    x = spark.read.csv(path, schema="rank int, domain string").where((F.col("rank") > lo) & (F.col("rank") <= hi))
    return x.select(F.concat(F.lit("https://"), "domain").alias("url"), F.lit(0).alias("label"), F.lit(stamp).cast("timestamp_ntz").alias("timestamp"), F.lit(source).alias("source"))


def corpus(*parts: DataFrame, rename: dict[str, str] | None = None) -> DataFrame:
    """Bag union of the parts; sources may be merged by renaming."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if rename:
        out = out.replace(rename, subset=["source"])
    return out


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """One value a line, gzip or plain; a missing file is an empty list."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "value string")
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("value")).distinct()


def write_word_list(df: DataFrame, path: str) -> None:
    df.select(F.col(df.columns[0]).cast("string")).write.mode("overwrite").option("compression", "gzip").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """One row of counts and settings as JSON, beside the list it describes."""
    df.coalesce(1).write.mode("overwrite").json(path)


def append_in_batches(stream: DataFrame, path: str, checkpoint: str, files_a_batch: int = 20) -> None:
    """Append what is new since the last run; a run that is broken off goes on where it stopped."""
    stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def write_results(df: DataFrame, path: str, key: str) -> None:
    """Rows of keys that are in df replace those written before; others stay. Each write is a folder of its own, and a
    pointer file names the newest whole one, so a run that is broken off loses nothing."""
    spark = df.sparkSession
    old = read_results(spark, path)
    import uuid

    name = f"v-{uuid.uuid4().hex}"
    (merge_by_key(old, df, key) if old is not None else df).write.parquet(f"{path}/{name}")
    P = spark._jvm.org.apache.hadoop.fs.Path
    f = P(path).getFileSystem(spark._jsc.hadoopConfiguration())
    out = f.create(P(f"{path}/current.txt"), True)
    out.writeBytes(name)
    out.close()


def read_results(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest whole table that write_results left, or None."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/current.txt")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.parquet(f"{path}/{spark.read.text(str(p)).first()[0]}")
