"""Streams over growing folders: micro-batch scoring, keyed upserts, deduplication by day, change capture.

Each job reads what is there, in micro-batches, and ends; started again with the same checkpoint it goes on with what is new.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.streaming import upserts


def follow(spark: SparkSession, path: str, schema, files: int = 4) -> DataFrame:
    """A stream of the Parquet files under ``path``, some files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def append_all(stream: DataFrame, out: str) -> None:
    """Write all that is there as Parquet and end; every row is written once."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).outputMode("append").start().awaitTermination()


def once_a_day(stream: DataFrame, keys: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """First row of each key a day; the state of a day is dropped once the watermark has passed it."""
    day = stream.withColumn("day", F.date_trunc("day", F.col(ts).cast("timestamp")))
    return (day.withWatermark("day", late) if stream.isStreaming else day).dropDuplicates([*keys, "day"])


def each_batch(stream: DataFrame, out: str, act: Callable[[DataFrame, int], None]) -> None:
    """Run ``act`` on every micro-batch; a batch that is repeated after a failure has the same number."""
    stream.writeStream.foreachBatch(act).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()


def keep_newest(spark: SparkSession, stream: DataFrame, out: str, keys: list[str], newest: list[Column]) -> DataFrame:
    """Idempotent upserts: each batch is a delta under its own number, and the newest row of each key is taken when read.

    A job started again, with or without new files, goes on from the folder; a repeated batch changes nothing.
    """
    schema = stream.schema
    each_batch(stream, out, lambda batch, number: upserts.put_batch(spark, batch, number, out, keys, newest))
    return upserts.current(spark, out, schema, keys, newest)


def breaker(log: DataFrame, key: str, ts: str, failed: str, order: list[str], least: int, recovery_s: int) -> DataFrame:
    """When a circuit breaker opens and when it would try again: runs of ``least`` failures, from the failure that reaches it."""
    w = Window.partitionBy(key).orderBy(ts, *order)
    x = log.withColumn("_island", F.sum(F.when(F.col(failed), 0).otherwise(1)).over(w)).where(F.col(failed))
    x = x.withColumn("_k", F.row_number().over(Window.partitionBy(key, "_island").orderBy(ts, *order))).where(F.col("_k") == least)
    return x.select(key, F.col(ts).alias("opened"), (F.col(ts) + F.expr(f"interval {recovery_s} seconds")).alias("half_open"))


def late_policy(df: DataFrame, ts: str, seen: str, late_s: int, ahead_s: int) -> DataFrame:
    """``df`` with ``policy``: future rows are rejected, late ones quarantined, rows without a time not measured, the rest accepted."""
    lag = F.unix_timestamp(seen) - F.unix_timestamp(ts)
    return df.withColumn("policy", F.when(F.col(ts).isNull(), "not_measured").when(lag < -ahead_s, "rejected_future").when(lag > late_s, "quarantined_late").otherwise("accepted"))
