"""Streaming queries over the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siltweir.session import shared_dir, table
from siltweir.streaming import state as S


def _stream(s, d):
    schema = table(s, d, "events").schema
    return s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _run(s, df, mode="append"):
    return S.drain(df, f"{shared_dir(s)}/stream-{uuid.uuid4().hex}", mode)


def stream_drift(s, d):
    x = _stream(s, d).select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.least(F.col("value") / 100, F.lit(1.0)).alias("v"))
    return _run(s, S.drift_stream(x, "event_type", "at", "v"))


def stream_rate_limit(s, d):
    x = _stream(s, d).select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    y = _run(s, S.rate_limited(x, "user_id", "t", 2, 86400.0))
    return y.groupBy("client").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("refused"))


def stream_windows(s, d):
    x = _stream(s, d).withColumn("ts", F.col("ts").cast("timestamp"))
    y = _run(s, S.windowed_counts(x, "ts", "event_type", "1 day"), "complete")
    return y.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


QUERIES = {f.__name__: f for f in (stream_drift, stream_rate_limit, stream_windows)}
SQL = {"stream_windows": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"}
