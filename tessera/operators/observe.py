"""Counts and health beside the data path: observations of a running query, and the catalog."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """``df`` and an observation of its rows (and other aggregates), filled when an action runs it."""
    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in metrics.items()]), o


def tracked(name: str, sink: Callable[[str, Observation], None]):
    """Decorates a function DataFrame -> DataFrame: ``sink`` gets the observation of what it returns."""

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(f)
        def run(*args, **kwargs) -> DataFrame:
            df, o = observed(f(*args, **kwargs), name)
            sink(name, o)
            return df

        return run

    return wrap


def health(spark: SparkSession, tables: list[str]) -> DataFrame:
    """Whether a query runs at all, and whether each table exists."""
    rows = [("session", spark.sql("SELECT 1").first()[0] == 1), *((t, spark.catalog.tableExists(t)) for t in tables)]
    return spark.createDataFrame(rows, "what string, ok boolean")
