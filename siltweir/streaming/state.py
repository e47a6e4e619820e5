"""Structured Streaming operators: drift detection, sliding-window rate limit, windowed counts with late data."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltweir.operators.drift import Adwin


def drift_stream(stream: DataFrame, key: str, order: str, value: str, delta: float = 0.002) -> DataFrame:
    """(key, position, at) of each alarm. The detector of a key is kept as state between batches; within a batch rows are
    taken by `order`, rows of later batches count as later. The buckets, and so the state, grow with log n."""

    def step(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        a = Adwin(delta)
        if state.exists:
            a.__dict__.update(json.loads(state.get[0]))
        pdf = pd.concat(list(pdfs)).sort_values("o", kind="stable")
        out = [(k[0], a.seen, o) for o, v in zip(pdf["o"], pdf["v"]) if a.update(float(v))]
        state.update((json.dumps(a.__dict__),))
        yield pd.DataFrame(out, columns=["key", "position", "at"])

    x = stream.where(F.col(value).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(order).cast("long").alias("o"), F.col(value).cast("double").alias("v"))
    return x.groupBy("k").applyInPandasWithState(step, "key string, position long, at long", "state string", "append", GroupStateTimeout.NoTimeout)


def rate_limited(stream: DataFrame, client: str, at_seconds: str, limit: int = 30, window_s: float = 60.0) -> DataFrame:
    """(client, at, allowed): requests older than the window are forgotten, a request is refused at the limit and then
    not counted. State holds at most `limit` times a client."""

    def step(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(pdfs)).sort_values("t", kind="stable")
        out = []
        for t in pdf["t"]:
            times = [x for x in times if t - x <= window_s]
            ok = len(times) < limit
            if ok:
                times.append(float(t))
            out.append((k[0], float(t), ok))
        state.update((times,))
        yield pd.DataFrame(out, columns=["client", "at", "allowed"])

    x = stream.select(F.col(client).cast("string").alias("c"), F.col(at_seconds).cast("double").alias("t"))
    return x.groupBy("c").applyInPandasWithState(step, "client string, at double, allowed boolean", "times array<double>", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, ts: str, by: str, width: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """Counts by event-time window with a watermark. The watermark is an addition of this engine."""
    return stream.withWatermark(ts, lateness).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"))


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there into a table under the folder, written by the executors; complete results replace
    each other."""
    path, spark = f"{folder}/out", stream.sparkSession
    w = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").outputMode("append").start(path)
    else:
        q = w.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(path)).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def each_batch(stream: DataFrame, checkpoint: str, body: Callable[[DataFrame, int], None]) -> None:
    """Chunked loop: body(batch, number) for each batch in order; batch n is read by what n - 1 left."""
    q = stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
