"""Agent traces: from events to the state of each trace, and totals over sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tool_calls(events: DataFrame) -> DataFrame:
    """State of each call from events (trace_id, call_id, kind, at, tool, tokens, cost, error): started,
    retried, completed. A call without completion is still retrying."""
    done = F.max(F.when(F.col("kind") == "complete_tool_call", F.struct("at", "error", "tokens", "cost")))
    begun = F.min(F.when(F.col("kind") == "record_tool_call", F.struct("at", "tool")))
    out = events.filter(F.col("kind").isin("record_tool_call", "complete_tool_call", "record_tool_retry")).groupBy("trace_id", "call_id").agg(begun.alias("b"), done.alias("d"), F.count_if(F.col("kind") == "record_tool_retry").alias("retry_count"))
    status = F.when(F.col("d").isNull(), "retrying").when(F.col("d.error").isNotNull(), "failed").otherwise("success")
    return out.select("trace_id", "call_id", "b.tool", status.alias("status"), "retry_count", latency_ms("b.at", "d.at").alias("latency_ms"), F.coalesce("d.tokens", F.lit(0)).alias("tokens"), F.coalesce("d.cost", F.lit(0.0)).alias("cost"))


def latency_ms(begin: str, end: str):
    """Milliseconds between two times; null where one is missing."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return ((micros(end) - micros(begin)) / 1000).cast("double")


def plan_steps(events: DataFrame) -> DataFrame:
    """Steps of a plan: pending until completed, failed with an error."""
    kind = F.col("kind")
    out = events.filter(kind.isin("record_plan_step", "complete_plan_step")).groupBy("trace_id", "step_id").agg(F.min(F.when(kind == "record_plan_step", F.struct("at", "description"))).alias("b"), F.max(F.when(kind == "complete_plan_step", F.struct("at", "error"))).alias("d"))
    return out.select("trace_id", "step_id", "b.description", F.when(F.col("d").isNull(), "pending").when(F.col("d.error").isNotNull(), "failed").otherwise("completed").alias("status"), latency_ms("b.at", "d.at").alias("latency_ms"))


def provenance(events: DataFrame) -> DataFrame:
    """Claims (cut to 200 characters) and memories (to 500) that a trace used."""
    kind = F.col("kind")
    text = F.when(kind == "record_provenance", F.substring("description", 1, 200)).otherwise(F.substring("description", 1, 500))
    return events.filter(kind.isin("record_provenance", "record_memory_access")).select("trace_id", "kind", "at", text.alias("text"))


def totals(calls: DataFrame, steps: DataFrame, traces: DataFrame) -> DataFrame:
    """Sums for each trace; parts are summed before they are joined, so nothing multiplies."""
    c = calls.groupBy("trace_id").agg(F.count("*").alias("n_calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 6).alias("cost"))
    s = steps.groupBy("trace_id").agg(F.count("*").alias("planned"), F.count_if(F.col("status") == "completed").alias("completed"), F.round(F.sum("latency_ms"), 3).alias("latency_ms"))
    out = traces.join(c, "trace_id", "left").join(s, "trace_id", "left").fillna(0)
    return out.withColumn("completion_rate", F.round(F.col("completed") / F.greatest(F.col("planned"), F.lit(1)), 6))


def sessions(totalled: DataFrame) -> DataFrame:
    return totalled.groupBy("session_id").agg(F.count("*").alias("n_traces"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 6).alias("cost"))
