"""Structured Streaming forms: resumable ingest, deduplication, buckets, sessions, ranks, side outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet_stream(spark: SparkSession, path: str, schema: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; its checkpoint remembers what was read."""
    r = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(path)


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Reads what is new since the last run, writes it, stops."""
    q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def run_complete(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Keeps the whole aggregate in a table, written anew by the executors after each micro-batch, and stops when all is read."""
    q = stream.writeStream.foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(sink)).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()


def utc(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling(df: DataFrame, ts: str, keys: list[str], width: str, late: str, **aggs) -> DataFrame:
    """Buckets of one width, closed once the watermark passes."""
    w = utc(df, ts).withWatermark(ts, late).groupBy(F.window(ts, width), *keys)
    return w.agg(*[v.alias(k) for k, v in aggs.items()]).select(F.col("window.start").alias("bucket"), *keys, *aggs)


def sliding(df: DataFrame, ts: str, keys: list[str], width: str, step: str, late: str, **aggs) -> DataFrame:
    w = utc(df, ts).withWatermark(ts, late).groupBy(F.window(ts, width, step), *keys)
    return w.agg(*[v.alias(k) for k, v in aggs.items()]).select(F.col("window.end").alias("at"), *keys, *aggs)


def sessions(df: DataFrame, ts: str, keys: list[str], gap: str, late: str, **aggs) -> DataFrame:
    """Runs of events no further apart than the gap."""
    w = utc(df, ts).withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys)
    return w.agg(*[v.alias(k) for k, v in aggs.items()]).select(F.col("session_window.start").alias("first"), F.col("session_window.end").alias("last"), *keys, *aggs)


def distinct_within(df: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """The first row of each key within the watermark's reach."""
    return utc(df, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def insert_new_batches(stream: DataFrame, path: str, keys: list[str], checkpoint: str) -> None:
    """Each micro-batch appends only rows whose key the table doesn't hold yet."""
    from ..sources.sinks import insert_new

    q = stream.writeStream.foreachBatch(lambda b, _: insert_new(b, path, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def split_batches(stream: DataFrame, bad, good_path: str, bad_path: str, checkpoint: str) -> None:
    """Good rows to one table, failed rows with their reason to another, for a later retry. bad: reason or null."""

    def write(b: DataFrame, _: int) -> None:
        x = b.withColumn("reason", bad)
        x.filter("reason is null").drop("reason").write.mode("append").parquet(good_path)
        x.filter("reason is not null").write.mode("append").parquet(bad_path)

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def running_rank(stream: DataFrame, key: str, id_col: str) -> DataFrame:
    """(key, id, rank, weight): each key's rows numbered in order of id within a micro-batch and on across them, weight 1/rank; the count is the state.

    A task holds the ids of one key in one micro-batch; files_per_batch of the source bounds them.
    """
    import numpy as np
    import pandas as pd

    schema = f"{key} string, {id_col} long, rank long, weight double"

    def number(k, frames, state):
        n = state.get[0] if state.exists else 0
        ids = np.sort(np.concatenate([f[id_col].to_numpy("int64") for f in frames]))
        ranks = np.arange(n + 1, n + 1 + len(ids))
        state.update((n + len(ids),))
        yield pd.DataFrame({key: [k[0]] * len(ids), id_col: ids, "rank": ranks, "weight": 1.0 / ranks})

    return stream.select(key, id_col).groupBy(key).applyInPandasWithState(number, schema, "n long", "append", "NoTimeout")
