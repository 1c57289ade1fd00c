"""Event-time windows, the same over batch and streaming DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(df: DataFrame, ts: str, length: str, slide: str | None, keys: Sequence[str], late: str | None = None, **aggregates: Column) -> DataFrame:
    """(window_start, window_end, keys..., aggregates...) over tumbling or, with ``slide``, sliding windows.

    ``late`` is the watermark of a stream: rows later than that are dropped and finished windows leave its state.
    """
    rows = df.withColumn(ts, F.col(ts).cast("timestamp"))
    if late is not None:
        rows = rows.withWatermark(ts, late)
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = rows.groupBy(window.alias("_w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("_w.start").cast("timestamp_ntz").alias("window_start"), F.col("_w.end").cast("timestamp_ntz").alias("window_end"), *keys, *aggregates)


def sessions(df: DataFrame, ts: str, gap: str, keys: Sequence[str], late: str | None = None, **aggregates: Column) -> DataFrame:
    """(session_start, session_end, keys..., aggregates...): runs whose neighbours are less than ``gap`` apart; the end is the last time plus the gap."""
    rows = df.withColumn(ts, F.col(ts).cast("timestamp"))
    if late is not None:
        rows = rows.withWatermark(ts, late)
    out = rows.groupBy(F.session_window(ts, gap).alias("_w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("_w.start").cast("timestamp_ntz").alias("session_start"), F.col("_w.end").cast("timestamp_ntz").alias("session_end"), *keys, *aggregates)
