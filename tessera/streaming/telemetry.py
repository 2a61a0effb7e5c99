"""Telemetry as streams: watermarked windows, sessions and sustained conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How late a sample may come.
LATE = "168 hours"


def rates(events: DataFrame, at: str, *by: str, size: str = "5 minutes", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Events and their rate in each window; state goes when the watermark passes."""
    from tessera.operators.telemetry import seconds

    w = F.window(at, size, slide) if slide else F.window(at, size)
    out = events.withWatermark(at, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), *by, "n", F.round(F.col("n") / seconds(size), 6).alias("rate"))


def ratios(events: DataFrame, at: str, bad, *by: str, size: str = "5 minutes", late: str = LATE) -> DataFrame:
    out = events.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), *by).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    return out.select(F.col("w.start").alias("window_start"), *by, "n", "bad", F.round(F.col("bad") / F.col("n"), 6).alias("ratio"))


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    out = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")
