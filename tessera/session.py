"""A session with the settings that results depend on, and sensible ones for scale."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tessera", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """UTC, adaptive execution with skew joins and coalescing, ISO-strict parsing without ANSI errors.

    ``shuffle_partitions`` stays Spark's unless given: adaptive execution coalesces small ones, and a
    large cluster sets it to a few times its cores.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
