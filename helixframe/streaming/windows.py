"""Streaming forms of the sweep operators: binned counts and depth over event time with a watermark."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """A stream gets its watermark, which asks for timestamps with a time zone; a batch stays as it is."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", size: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events by (sliding) window and key: window_start, window_end, key, n.  On a stream, events later than ``late`` are left out."""
    rows = _timed(events, time, late)
    window = F.window(time, size, slide) if slide else F.window(time, size)
    got = rows.groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return got.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n")


def binned_positions(events: DataFrame, position: str, size: int, time: str = "ts", late: str = "10 minutes", span: str = "1 hour") -> DataFrame:
    """Events by time window and bin of a position."""
    rows = _timed(events, time, late)
    start = (F.floor(F.col(position) / size) * size).cast("long")
    got = rows.groupBy(F.window(time, span).alias("w"), start.alias("start")).agg(F.count(F.lit(1)).alias("n"))
    return got.select(F.col("w.start").alias("window_start"), "start", (F.col("start") + size).alias("end"), "n")


def sessions(events: DataFrame, key: str = "user_id", time: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each key: key, session_start, session_end, n."""
    rows = _timed(events, time, late)
    got = rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return got.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def concurrency(events: DataFrame, time: str = "ts", minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """How many events are open in each minute, an event being open for ``minutes``: depth on a stream, as each event adds to
    the minutes it covers."""
    rows = _timed(events, time, late)
    at = F.explode(F.sequence(F.date_trunc("minute", time), F.date_trunc("minute", F.col(time)) + F.expr(f"interval {minutes - 1} minutes"), F.expr("interval 1 minute")))
    if events.isStreaming:
        return rows.select(time, at.alias("minute")).groupBy(F.window("minute", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("depth")).select(F.col("w.start").alias("minute"), "depth")
    return rows.select(at.alias("minute")).groupBy("minute").agg(F.count(F.lit(1)).alias("depth"))
