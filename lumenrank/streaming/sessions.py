"""Bursts in a stream: a session window for each burst, late shots let in up to a delay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrank.operators.dedup import GAP_SECONDS


def burst_windows(shots: DataFrame, key: str, time: str = "ts", gap: float = GAP_SECONDS, delay: str = "1 minute") -> DataFrame:
    """(key, start, end, shots) of bursts: shots of a key at most gap apart. Works on a stream and on a table.

    end is the last shot's time plus gap. On a stream a burst comes out once the watermark has passed its end.
    """
    rows = shots.withWatermark(time, delay) if shots.isStreaming else shots
    window = F.session_window(F.col(time), f"{round(gap * 1000)} milliseconds")
    return rows.groupBy(F.col(key), window.alias("w")).agg(F.count("*").alias("shots")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "shots")
