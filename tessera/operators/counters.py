"""Counters that are scraped: rates and increases that know resets, and quantiles from mergeable sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.telemetry import seconds

#: Seconds of a slice: the samples of a series in one slice are one task's, whole series are not.
SLICE = 3600
#: A window's end farther from its last sample than so many mean gaps isn't extrapolated to.
NEAR = 1.1


def _sliced(samples: DataFrame, at: str, value: str, by: tuple[str, ...], slice_s: int) -> DataFrame:
    """by, slice and the partial state: n, first and last time and value, and the increase within, resets added."""
    t = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    rows = samples.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & F.col(at).isNotNull())
    rows = rows.select(*by, t.alias("__t"), F.col(value).cast("double").alias("__v")).withColumn("__s", F.floor(F.col("__t") / slice_s))
    # Of samples of one time the largest counts.
    rows = rows.groupBy(*by, "__s", "__t").agg(F.max("__v").alias("__v"))
    before = F.lag("__v").over(Window.partitionBy(*by, "__s").orderBy("__t"))
    grown = F.when(before.isNull(), 0.0).when(F.col("__v") < before, F.col("__v")).otherwise(F.col("__v") - before)
    ends = [F.min_by("__v", "__t").alias("first_v"), F.max_by("__v", "__t").alias("last_v"), F.min("__t").alias("first_t"), F.max("__t").alias("last_t")]
    return rows.withColumn("__g", grown).groupBy(*by, "__s").agg(F.count("*").alias("n"), F.sum("__g").alias("grown"), *ends)


def increase(samples: DataFrame, at: str, value: str, *by: str, size: str = "5 minutes", slice_s: int = SLICE) -> DataFrame:
    """What counters have grown in each window: window_start, by, samples, increase, rate.

    Samples (of a running total) may be missing, and a value below the one before it means that the counter began
    again at 0. Growth between the first and last sample is carried on to the edges of the window: to an edge
    within 1.1 mean gaps of a sample wholly, else half a mean gap far, and never to before the total would have
    been 0. Windows of fewer than two samples have none. Slices of a window are summed up first and joined
    by their ends, so that a long window of a hot series is many tasks.
    """
    span = seconds(size)
    part = min(span, slice_s)
    while span % part:
        part -= 1
    rows = _sliced(samples, at, value, by, part).withColumn("w", F.floor(F.col("__s") * part / span))
    before = F.lag("last_v").over(Window.partitionBy(*by, "w").orderBy("__s"))
    joint = F.when(before.isNull(), 0.0).when(F.col("first_v") < before, F.col("first_v")).otherwise(F.col("first_v") - before)
    found = rows.withColumn("joint", joint).groupBy(*by, "w").agg(F.sum("n").alias("n"), F.sum(F.col("grown") + F.col("joint")).alias("grown"), F.min_by("first_v", "__s").alias("first_v"), F.min("first_t").alias("first_t"), F.max("last_t").alias("last_t"))
    found = found.filter("n >= 2")
    start, end = F.col("w") * span, (F.col("w") + 1) * span
    sampled = F.col("last_t") - F.col("first_t")
    gap = sampled / (F.col("n") - 1)

    def reach(far: Column) -> Column:
        return F.when(far < gap * NEAR, far).otherwise(gap / 2)

    to_zero = F.when((F.col("grown") > 0) & (F.col("first_v") >= 0), sampled * F.col("first_v") / F.col("grown"))
    early = F.least(reach(F.col("first_t") - start), to_zero)
    total = F.col("grown") * (sampled + early + reach(end - F.col("last_t"))) / sampled
    window = F.timestamp_seconds(F.col("w") * span).alias("window_start")
    return found.select(window, *by, F.col("n").alias("samples"), total.alias("increase"), (total / span).alias("rate"))


# ---- quantiles ---------------------------------------------------------------------------------

#: Size of a sketch: a rank is within about 1.33 % of the truth with 99 % confidence.
K, RANK_ERROR = 200, 0.0133


def sketched(df: DataFrame, at: str, value: str, *by: str, size: str = "1 hour") -> DataFrame:
    """A quantile sketch of each window: window_start, by, n, sketch. To be stored: longer windows are made of it."""
    w = F.window(F.col(at), size)
    rows = df.filter(F.col(value).isNotNull()).withColumn("__v", F.col(value).cast("double"))
    return rows.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.kll_sketch_agg_double("__v", F.lit(K)).alias("sketch")).select(F.col("w.start").alias("window_start"), *by, "n", "sketch")


def merged(sketches: DataFrame, *by: str, size: str = "24 hours") -> DataFrame:
    """Sketches of longer windows from those of shorter ones, without the events."""
    w = F.window(F.col("window_start"), size)
    out = sketches.groupBy(w.alias("w"), *by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return out.select(F.col("w.start").alias("window_start"), *by, "n", "sketch")


def quantiles(sketches: DataFrame, *at_share: float) -> DataFrame:
    """The quantiles of sketches as columns p50, p95 and so on."""
    named = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(f"p{round(q * 100)}") for q in at_share]
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], *named)
