"""Alert and event streams: windowed volumes, throttling with a cooldown, deduplication, sessions, and their batch twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def window_counts(events: DataFrame, ts: str, key: str, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events per window and key; on a stream late rows are dropped by the watermark, on a table it has no effect."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    src = events.withWatermark(ts, late) if events.isStreaming else events
    g = src.groupBy(w, key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n", "total")


def dedupe_alerts(alerts: DataFrame, ts: str, ttl: str = "30 minutes") -> DataFrame:
    """One alert per key within the TTL: exact per watermark on a stream."""
    return alerts.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(["alert_key"])


def throttle_stream(events: DataFrame, key: str, ts: str, cooldown_s: int) -> DataFrame:
    """Let an event of a key pass if none passed within the cooldown before it; the last pass is kept as state."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(ts)
        keep = []
        for t in rows[ts]:
            s = int(t.timestamp())
            keep.append(last is None or s - last >= cooldown_s)
            if keep[-1]:
                last = s
        if last is not None:
            state.update((last,))
        yield rows[keep]

    schema = events.schema
    return events.groupBy(key).applyInPandasWithState(run, schema, "last long", "append", "NoTimeout")


def throttle(events: DataFrame, keys: list[str], ts: str, order: list[str], cooldown_s: int) -> DataFrame:
    """Batch twin of the throttle: events of a key in time order pass greedily, at least ``cooldown_s`` after the last that passed.

    One sorted pass over each partition; what is kept from one batch to the next is the last key and the time of its last pass,
    so a key of any size streams through. Null times never pass.
    """
    dealt = events.where(F.col(ts).isNotNull()).repartition(*keys).sortWithinPartitions(*keys, ts, *order)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, last = None, None
        for b in batches:
            if not len(b):
                continue
            seconds = (b[ts].astype("datetime64[us]").astype("int64") // 1_000_000).tolist()
            keep = []
            for key, t in zip(zip(*(b[k].tolist() for k in keys)), seconds):
                if key != last_key:
                    last_key, last = key, None
                keep.append(last is None or t - last >= cooldown_s)
                if keep[-1]:
                    last = t
            yield b[keep]

    return dealt.mapInPandas(scan, events.schema)


def ttl_first(events: DataFrame, keys: list[str], ts: str, order: list[str], ttl_s: int) -> DataFrame:
    """An event is new if its key was not seen within ``ttl_s`` before it (every sighting renews the mark)."""
    w = Window.partitionBy(*keys).orderBy(ts, *order)
    gap = F.unix_timestamp(ts) - F.lag(F.unix_timestamp(ts)).over(w)
    return events.withColumn("is_new", gap.isNull() | (gap > ttl_s))


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a key by inactivity (an extension of this engine)."""
    g = events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def failure_runs(log: DataFrame, key: str, ts: str, failed: str, order: list[str], least: int) -> DataFrame:
    """Gaps and islands: runs of at least ``least`` consecutive failures, when a breaker would be open."""
    w = Window.partitionBy(key).orderBy(ts, *order)
    x = log.withColumn("_island", F.sum(F.when(F.col(failed), 0).otherwise(1)).over(w)).where(F.col(failed))
    g = x.groupBy(key, "_island").agg(F.count(F.lit(1)).alias("failures"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    return g.where(F.col("failures") >= least).drop("_island")


def freshness(df: DataFrame, ts: str, asof: str, fresh_h: int = 48, stale_h: int = 720) -> DataFrame:
    age = (F.unix_timestamp(F.lit(asof).cast("timestamp")) - F.unix_timestamp(ts)) / 3600
    state = F.when(F.col(ts).isNull(), "NOT_MEASURED").when(age < 0, "FUTURE").when(age <= fresh_h, "FRESH").when(age <= stale_h, "STALE").otherwise("HISTORICAL")
    return df.withColumn("age_hours", age).withColumn("freshness", state)
