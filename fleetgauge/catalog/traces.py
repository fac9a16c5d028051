"""Trace queries."""

from fleetgauge.catalog.adapters import TRACE, trace_events, with_
from fleetgauge.catalog.registry import query
from fleetgauge.operators import trace as tr

OUTCOMES = """folded AS (SELECT run_id, task_id, count(*) AS events,
  max(success::INT) FILTER (stage = 'action') = 1 AS acted_ok,
  count(*) FILTER (stage = 'action') AS actions,
  arg_max(success, attempt) FILTER (stage = 'reflection' AND attempt > 0) AS last_ok,
  arg_max(preview, attempt) FILTER (stage = 'reflection' AND attempt > 0) AS last_preview,
  max(preview) FILTER (stage = 'action') AS action_preview,
  coalesce(sum(latency_s), 0) AS latency_s,
  count(*) FILTER (stage = 'reflection' AND attempt > 0) AS reflection_attempts,
  count(*) FILTER (off) AS disabled
  FROM trace GROUP BY 1, 2),
outcomes AS (SELECT run_id, task_id, coalesce(acted_ok, false) OR coalesce(last_ok, false) AS success, latency_s,
  reflection_attempts, events,
  CASE WHEN coalesce(acted_ok, false) THEN action_preview WHEN coalesce(last_ok, false) THEN last_preview ELSE '' END AS completion,
  coalesce(last_preview, '') AS reflection_completion,
  CASE WHEN actions = 0 THEN 'incomplete' WHEN coalesce(acted_ok, false) THEN 'first_attempt'
    WHEN coalesce(last_ok, false) THEN 'repaired' WHEN reflection_attempts > 0 THEN 'exhausted'
    WHEN disabled > 0 THEN 'reflection_disabled' ELSE 'pending' END AS outcome
  FROM folded)"""


@query("task_outcomes", "R1", "R4", sql=with_(TRACE, OUTCOMES) + "SELECT * FROM outcomes")
def task_outcomes(t):
    return tr.task_outcomes(trace_events(t))


@query(
    "outcome_classes",
    "R3",
    sql=with_(TRACE, OUTCOMES)
    + """SELECT run_id, outcome, count(*) AS tasks, CAST(sum(reflection_attempts) AS BIGINT) AS reflections,
  avg(latency_s) AS avg_latency_s FROM outcomes GROUP BY 1, 2""",
)
def outcome_classes(t):
    return tr.outcome_classes(tr.task_outcomes(trace_events(t)))


@query(
    "reflection_rate",
    "R3",
    sql=with_(TRACE, OUTCOMES)
    + """SELECT run_id, count(*) AS tasks, count(*) FILTER (outcome <> 'first_attempt') AS needed_reflection,
  count(*) FILTER (outcome <> 'first_attempt') / count(*) AS reflection_rate FROM outcomes GROUP BY 1""",
)
def reflection_rate(t):
    return tr.reflection_rate(tr.task_outcomes(trace_events(t)))


@query(
    "stage_latency",
    "R5",
    "R2",
    sql=with_(TRACE)
    + """SELECT task_id, stage, timestamp, lag(stage) OVER w AS previous_stage, timestamp - lag(timestamp) OVER w AS stage_latency_s
FROM trace WINDOW w AS (PARTITION BY run_id, task_id ORDER BY timestamp)""",
)
def stage_latency(t):
    return tr.stage_latency(trace_events(t)).drop("payload", "run_id")
