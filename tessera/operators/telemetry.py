"""Windowed telemetry over event tables: rates, ratios, quantiles, trends, sustained conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bounds of the latency histogram, in seconds.
BUCKETS = [0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0]


def _windowed(df: DataFrame, at: str, size: str, slide: str | None, *by: str):
    w = F.window(F.col(at), size, slide) if slide else F.window(F.col(at), size)
    return df.groupBy(w.alias("w"), *by)


def seconds(interval: str) -> int:
    n, unit = interval.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def rate(df: DataFrame, at: str, *by: str, size: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Events a second in each window that has some."""
    return _windowed(df, at, size, slide, *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n", F.round(F.col("n") / seconds(size), 6).alias("rate"))


def ratio(df: DataFrame, at: str, bad: Column, *by: str, size: str = "5 minutes", smooth: int = 0) -> DataFrame:
    """Share of bad events in each window: summed first, then divided."""
    out = _windowed(df, at, size, None, *by).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    return out.select(F.col("w.start").alias("window_start"), *by, "n", "bad", F.round(F.col("bad") / (F.col("n") + smooth), 6).alias("ratio"))


def quantiles(df: DataFrame, at: str, value: str, *by: str, size: str = "1 hour", at_share: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Exact quantiles of each window."""
    out = _windowed(df, at, size, None, *by).agg(F.percentile(value, F.array(*[F.lit(q) for q in at_share])).alias("p"))
    return out.select(F.col("w.start").alias("window_start"), *by, *[F.round(F.get("p", F.lit(i)), 6).alias(f"p{round(q * 100)}") for i, q in enumerate(at_share)])


def histogram_quantile(df: DataFrame, value: str, q: float, *by: str, bounds: list[float] | None = None) -> DataFrame:
    """Quantile interpolated in a histogram: what dashboards show. A sum over fixed buckets, so its
    state doesn't grow with the values. Values above the last bound give that bound."""
    bounds = bounds or BUCKETS
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    agg = df.groupBy(*by).agg(F.count(value).alias("n"), *counts)
    wanted = F.col("n") * q
    out = F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        low, below = (bounds[i - 1], F.col(f"b{i - 1}")) if i else (0.0, F.lit(0))
        inside = F.col(f"b{i}") - below
        out = F.when(F.col(f"b{i}") >= wanted, F.when(inside > 0, low + (bounds[i] - low) * (wanted - below) / inside).otherwise(F.lit(float(bounds[i])))).otherwise(out)
    return agg.select(*by, "n", F.round(out, 6).alias("quantile"))


def increase(df: DataFrame, at: str, *by: str, value: str | None = None, size: str = "24 hours") -> DataFrame:
    """Events (or the sum of a value) in each window."""
    total = F.round(F.sum(value), 4) if value else F.count("*")
    return _windowed(df, at, size, None, *by).agg(total.alias("increase")).select(F.col("w.start").alias("window_start"), *by, "increase")


def monthly_projection(df: DataFrame, at: str, value: str, budget: float, *by: str) -> DataFrame:
    """The last hour's sum carried on for 730 hours, and its share of a budget in per cent."""
    last = df.agg(F.max(F.date_trunc("hour", at)).alias("last"))  # one row
    hour = df.join(F.broadcast(last), F.date_trunc("hour", F.col(at)) == F.col("last"))
    month = F.sum(value) * 730
    return hour.groupBy(*by).agg(F.round(month, 4).alias("projected"), F.round(month / budget * 100, 4).alias("budget_pct"))


def predict_linear(df: DataFrame, at: str, value: str, ahead_s: int, *by: str, size: str = "6 hours") -> DataFrame:
    """Least-squares line of each window, and where it is ``ahead_s`` after the window's end."""
    t = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    w = F.window(F.col(at), size)
    rows = df.select(w.alias("w"), *by, F.col(value).alias("__v"), (t - F.unix_micros(w["start"].cast("timestamp")) / 1e6).alias("__t"))
    out = rows.groupBy("w", *by).agg(F.regr_slope("__v", "__t").alias("slope"), F.regr_intercept("__v", "__t").alias("intercept"))
    return out.select(F.col("w.start").alias("window_start"), *by, F.round("slope", 8).alias("slope"), F.round(F.col("intercept") + F.col("slope") * (seconds(size) + ahead_s), 4).alias("predicted"))


def top_by(df: DataFrame, by: str, most: int = 10, name: str = "n") -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias(name)).orderBy(F.desc(name), by).limit(most)


def aggregate_by(df: DataFrame, value: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("most"))


def staleness(df: DataFrame, at: str, now, limit_s: int, *by: str) -> DataFrame:
    """Seconds since the last event of each group, and whether that is beyond the limit."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.max(F.col(at).cast("timestamp")))
    return df.groupBy(*by).agg(age.alias("age_s")).withColumn("stale", F.col("age_s") > limit_s)


def sustained(windows: DataFrame, start: str, condition: Column, size_s: int, for_s: int, *by: str) -> DataFrame:
    """Spans in which a condition held in consecutive windows for at least ``for_s`` seconds.

    Gaps and islands over windows, which are few: one for each ``size_s`` of time and group.
    """
    held = windows.filter(condition)
    order = Window.partitionBy(*by).orderBy(start)
    at = F.unix_timestamp(F.col(start).cast("timestamp"))
    island = at - F.row_number().over(order) * size_s
    return held.withColumn("__i", island).groupBy(*by, "__i").agg(F.min(start).alias("since"), F.count("*").alias("n_windows")).filter(F.col("n_windows") * size_s >= for_s).drop("__i")
