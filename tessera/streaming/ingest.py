"""Ingestion as streams: a landing folder whose checkpoint is the crawl state, and dedup on arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.sources import sinks


def landing(spark: SparkSession, path: str, schema: str, format: str = "json", most_files: int = 1000) -> DataFrame:
    """New files of a folder, each once: the stream's checkpoint remembers them."""
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", most_files).load(path)


def distinct(rows: DataFrame, keys: list[str], at: str, late: str = "168 hours") -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def into_table(rows: DataFrame, path: str, keys: list[str], order: str, checkpoint: str):
    """Writes each micro-batch as an insert if absent: a batch that runs twice changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        sinks.insert_if_absent(batch, path, keys, order)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
