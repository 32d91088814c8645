"""Trace events and conversations, as batch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.scores import r6, top_k


def health_status(total: Column, failed: Column) -> Column:
    """Unhealthy from half of operations failed, degraded from a tenth."""
    rate = failed / total
    return F.when(total == 0, "unknown").when(rate >= 0.50, "unhealthy").when(rate >= 0.10, "degraded").otherwise("healthy")


def component_health(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Operations, failures, success rate, mean duration and status."""
    n, bad = F.count(F.lit(1)), F.count_if("failed")
    return events.groupBy(*(keys or ["component"])).agg(
        n.alias("total"), (n - bad).alias("successful"), bad.alias("failed"), r6((n - bad) / n).alias("success_rate"),
        r6(F.sum(F.greatest(F.lit(0.0), F.col("duration_ms"))) / n).alias("mean_ms"), health_status(n, bad).alias("status"))


def overall_health(health: DataFrame) -> DataFrame:
    """The worst status of all components; unknown when there are none."""
    worst = F.max(F.when(F.col("status") == "unhealthy", 3).when(F.col("status") == "degraded", 2).when(F.col("status") == "unknown", 1).otherwise(0))
    return health.agg(F.count(F.lit(1)).alias("components"), worst.alias("w")).select(
        "components", F.when(F.col("w").isNull(), "unknown").when(F.col("w") == 3, "unhealthy").when(F.col("w") == 2, "degraded").when(
            F.col("w") == 1, "unknown").otherwise("healthy").alias("status"))


def trace_rollup(events: DataFrame) -> DataFrame:
    """Start, end, span and error counts and summed durations of every trace."""
    return events.groupBy("trace_id").agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("spans"), F.count_if("failed").alias("errors"),
        F.round(F.sum("duration_ms"), 4).alias("busy_ms")).withColumn(
        "duration_s", F.round((F.unix_micros("ended") - F.unix_micros("started")) / 1e6, 3))


def recent_events(events: DataFrame, last: int = 100, trace: object | None = None, kind: str | None = None, per: str = "trace_id") -> DataFrame:
    """Last events of every trace after the filters. Each task keeps ``last`` per trace before the shuffle."""
    kept = events
    if trace is not None:
        kept = kept.filter(F.col("trace_id") == trace)
    if kind is not None:
        kept = kept.filter(F.col("event_type") == kind)
    return top_k(kept, per, last, F.desc("ts"), F.desc("event_id"))


def strategy_performance(events: DataFrame, middle: Column, edge: float = 0.05) -> DataFrame:
    """Runs, success, mean score and latency of every strategy, and whether the later half scores better."""
    late = F.avg(F.when(F.col("ts") >= middle, F.col("score")))
    early = F.avg(F.when(F.col("ts") < middle, F.col("score")))
    per = events.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("executions"), F.count_if(~F.col("failed")).alias("successes"), r6(F.count_if(~F.col("failed")) / F.count(F.lit(1))).alias("success_rate"),
        r6(F.avg("score")).alias("mean_score"), r6(F.avg("duration_ms")).alias("mean_ms"), r6(late / early - 1.0).alias("improvement"))
    return per.withColumn("trend", F.when(F.col("improvement") > edge, "improving").when(F.col("improvement") < -edge, "declining").otherwise("stable"))


def history_window(turns: DataFrame, last: int = 30) -> DataFrame:
    """Last messages of every conversation."""
    return top_k(turns, "conv_id", last, F.desc("turn"), rank="back")


def qa_pairs(turns: DataFrame) -> DataFrame:
    """User turns with the assistant turn right after them.

    Turns are numbered, so the follower is found by an equi-join: a conversation of any length
    spreads over tasks.
    """
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), (F.col("turn") + 1).alias("next"))
    told = turns.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("next"), F.col("text").alias("answer"))
    return asked.join(told, ["conv_id", "next"]).select("conv_id", "turn", "question", "answer")
