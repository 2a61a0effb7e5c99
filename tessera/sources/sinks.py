"""Sinks: append, insert if absent, upsert, JSON lines, run log, lineage and structured logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import dedup


def append(df: DataFrame, path: str, *by: str) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def insert_if_absent(new: DataFrame, path: str, keys: list[str], order: str) -> None:
    """Appends the rows of ``new`` whose key the table lacks; blank keys are always appended."""
    spark = new.sparkSession
    old = spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], new.schema)
    blank = F.lit(False)
    for k in keys:
        blank = blank | F.col(k).isNull() | (F.col(k).cast("string") == "")
    fresh = dedup.first_by(new.filter(~blank), keys, order).join(old.select(*keys).distinct(), keys, "left_anti").select(*new.columns)
    append(fresh.unionByName(new.filter(blank)), path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def positions(df: DataFrame, array: str, index: str, value: str) -> DataFrame:
    """Array elements as rows with their index, for append."""
    return df.select("*", F.posexplode(array).alias(index, value)).drop(array)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def texts(df: DataFrame, path: str, text: str, by: str) -> None:
    """One folder of text for each value of ``by``."""
    df.select(F.col(text).alias("value"), F.col(by)).write.mode("append").partitionBy(by).text(path)


def run_log(results: DataFrame, pipeline: str, started, completed) -> DataFrame:
    """One row about a run from its results (status, error, key)."""
    from tessera.operators.relational import run_summary

    out = run_summary(results, "status", "error", "key")
    return out.select(F.lit(pipeline).alias("pipeline_name"), "status", F.lit(started).cast("timestamp").alias("started_at"), F.lit(completed).cast("timestamp").alias("completed_at"), "source_count", "processed_count", "failed_count", "skipped_count", F.col("first_errors").alias("errors"))


def lineage(rows: DataFrame, job: str, source: Column, target: Column, at: Column, namespace: str = "tessera") -> DataFrame:
    """A lineage event for each row: eventType, eventTime, run, job, inputs, outputs."""
    dataset = lambda c: F.array(F.struct(F.lit(namespace).alias("namespace"), c.alias("name")))
    run = F.sha2(F.concat_ws(":", F.lit(job), source, target, at.cast("string")), 256)
    return rows.select(F.lit("COMPLETE").alias("eventType"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("eventTime"), F.struct(run.alias("runId")).alias("run"), F.struct(F.lit(namespace).alias("namespace"), F.lit(job).alias("name")).alias("job"), dataset(source).alias("inputs"), dataset(target).alias("outputs"))


def lineage_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(F.col("job.name").alias("job")).agg(F.count("*").alias("n"))


def log_lines(rows: DataFrame, level: str, component: str, event: str, at: Column, correlation: Column, data: Column) -> DataFrame:
    return rows.select(at.alias("timestamp"), F.lit(level).alias("level"), F.lit(component).alias("component"), F.lit(event).alias("event"), correlation.alias("correlation_id"), data.alias("data"))


def vectors_from_json(df: DataFrame, metadata: str = "metadata", vector: str = "embedding_vector") -> DataFrame:
    """Vectors that older rows keep inside JSON, as a column; others keep theirs."""
    held = F.from_json(F.get_json_object(metadata, f"$.{vector}"), "array<float>")
    own = F.col(vector) if vector in df.columns else F.lit(None).cast("array<float>")
    return df.withColumn(vector, F.coalesce(own, held))


def set_status(df: DataFrame, key: str, value, status: str, error: str | None, now) -> DataFrame:
    """Status of one row; completed and failed rows get a time."""
    mine = F.col(key) == value
    ended = status in ("completed", "failed")
    return df.withColumns({
        "processing_status": F.when(mine, status).otherwise(F.col("processing_status")),
        "error_message": F.when(mine, F.lit(error)).otherwise(F.col("error_message")),
        "processed_at": F.when(mine & F.lit(ended), F.lit(now).cast("timestamp")).otherwise(F.col("processed_at")),
    })


def create_table(spark: SparkSession, name: str, schema: str, path: str | None = None, by: tuple[str, ...] = ()) -> None:
    """An empty Parquet table, if there is none."""
    location = f" LOCATION '{path}'" if path else ""
    parts = f" PARTITIONED BY ({', '.join(by)})" if by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet{parts}{location}")


def reset_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"TRUNCATE TABLE {name}")


def migrate(spark: SparkSession, path: str, schema: T.StructType) -> list[str]:
    """Adds an empty file with ``schema`` to a table that lacks columns of it, and names those columns: older
    rows have them as null when the table is read with :func:`current`, and no row is rewritten."""
    have = set(spark.read.option("mergeSchema", "true").parquet(path).columns)
    new = [f.name for f in schema if f.name not in have]
    if new:
        append(spark.createDataFrame([], schema).coalesce(1), path)
    return new


def current(spark: SparkSession, path: str) -> DataFrame:
    """A table whose files may be of several versions, with the columns of all."""
    return spark.read.option("mergeSchema", "true").parquet(path)
