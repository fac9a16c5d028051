"""Reasoning traces: reasoning, action, observation and reflection events to task outcomes."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.plans.ordered import DEFAULT_LIMITS, SliceLimits, with_previous

TASK = ("run_id", "task_id")


def outcome_columns(ts: str = "timestamp") -> list[Column]:
    """Aggregates that fold a task's events; order of arrival does not matter."""
    stage, p = F.col("stage"), F.col("payload")
    acted, reflected = stage == "action", stage == "reflection"
    tried = reflected & (p["attempt"] > 0)
    parts = F.struct(
        p["success"].alias("success"), p["latency_s"].alias("latency_s"),
        p["completion_preview"].alias("preview"),
    )
    return [
        F.max_by(parts, F.when(acted, F.col(ts))).alias("action"),
        F.max_by(parts, F.when(tried, F.struct(p["attempt"], F.col(ts)))).alias("last_reflection"),
        F.coalesce(
            F.sum(F.when(reflected, F.coalesce(p["latency_s"], F.lit(0.0)))), F.lit(0.0)
        ).alias("reflection_latency_s"),
        F.count_if(tried).alias("reflection_attempts"),
        F.count_if(reflected & (p["enabled"] == F.lit(False))).alias("disabled"),
        F.count(F.lit(1)).alias("events"),
    ]


def outcome_fields() -> list[Column]:
    a, r = F.col("action"), F.col("last_reflection")
    at_once = F.coalesce(a["success"], F.lit(False))
    repaired = ~at_once & F.coalesce(r["success"], F.lit(False))
    kind = (
        F.when(a.isNull(), "incomplete")
        .when(at_once, "first_attempt")
        .when(repaired, "repaired")
        .when(F.col("reflection_attempts") > 0, "exhausted")
        .when(F.col("disabled") > 0, "reflection_disabled")
        .otherwise("pending")
    )
    return [
        (at_once | repaired).alias("success"),
        (F.coalesce(a["latency_s"], F.lit(0.0)) + F.col("reflection_latency_s")).alias(
            "latency_s"
        ),
        F.col("reflection_attempts"),
        F.when(at_once, a["preview"])
        .when(repaired, r["preview"])
        .otherwise(F.lit(""))
        .alias("completion"),
        F.coalesce(r["preview"], F.lit("")).alias("reflection_completion"),
        F.col("events"),
        kind.alias("outcome"),
    ]


def task_outcomes(events: DataFrame, keys: Sequence[str] = TASK) -> DataFrame:
    """Final outcome per task.

    Success is the action's, else the last reflection's; latency is the action's plus all
    reflections'; a failed task has an empty completion. A task with millions of events still
    folds by partial aggregation.
    """
    return events.groupBy(*keys).agg(*outcome_columns()).select(*keys, *outcome_fields())


def outcome_classes(outcomes: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    return outcomes.groupBy(*keys, "outcome").agg(
        F.count(F.lit(1)).alias("tasks"),
        F.sum("reflection_attempts").alias("reflections"),
        F.avg("latency_s").alias("avg_latency_s"),
    )


def reflection_rate(outcomes: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    needed = F.count_if(F.col("outcome") != "first_attempt")
    return outcomes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tasks"),
        needed.alias("needed_reflection"),
        (needed / F.count(F.lit(1))).alias("reflection_rate"),
    )


def stage_latency(
    events: DataFrame,
    keys: Sequence[str] = TASK,
    ts: str = "timestamp",
    ties: Sequence[str] = (),
    limits: SliceLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """Each event with the stage before it and the seconds in between."""
    paired = with_previous(
        events, keys, [ts, *ties], {"previous_stage": "stage", "__before": ts}, limits
    )
    return paired.withColumn("stage_latency_s", F.col(ts) - F.col("__before")).drop("__before")
