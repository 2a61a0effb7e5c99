"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, longs: tuple[str, ...] = ()):
    """Registers a function (tables) -> DataFrame under its name; ``tables`` reads a table by name.

    Columns ``longs`` are widened to the type that the oracle has.
    """

    def register(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
            return df.withColumns({c: F.col(c).cast("long") for c in longs}) if longs else df

        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)
