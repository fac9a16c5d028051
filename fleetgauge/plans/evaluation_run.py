"""The evaluation run as one plan: attempts and problems to agent summaries with pass@k."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.fixed_values import MIN_SECONDS, PASS_KS
from fleetgauge.functions.numbers import pass_at_k, throughput
from fleetgauge.operators.evaluation import attempt_rank


def agent_evaluation(
    attempts: DataFrame,
    problems: DataFrame | None = None,
    ks: Sequence[int] = tuple(PASS_KS),
    min_seconds: float = MIN_SECONDS,
    run: Sequence[str] = (),
) -> DataFrame:
    """Per agent, or per run and agent where ``run`` names run columns: tasks, successes, latency, throughput and pass@k.

    Attempts are scanned once and shuffled once, already reduced to one row of numbers per
    (agent, task): the chosen attempt's latency, whether it succeeded, samples and correct
    samples. Only those rows meet the problem ids and are averaged per agent. Composing
    ``first_success``, ``agent_summary``, ``pass_at_ks`` and ``with_scores`` gives the same rows
    from two scans. A pass@k that cannot be reported, or an agent without known tasks, scores 0.
    """
    passed = F.coalesce("passed", F.lit(False))
    keys = [*run, "agent_id"]
    items = attempts.groupBy(*keys, "task_id").agg(
        F.min_by("latency_s", attempt_rank()).alias("latency_s"),
        F.coalesce(F.bool_or("ok"), F.lit(False)).alias("ok"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(passed).alias("c"),
    )
    if problems is None:
        items = items.withColumn("known", F.lit(True))
    else:
        ids = problems.select("task_id").distinct().withColumn("known", F.lit(True))
        items = items.join(ids, "task_id", "left")
    known, n, c = F.col("known"), F.col("n"), F.col("c")
    scored = items.select(
        *keys,
        "latency_s",
        "ok",
        F.when(known, n).alias("n"),
        *[F.when(known, pass_at_k(n, c, k)).alias(f"__p{k}") for k in ks],
    )
    total = F.count(F.lit(1))
    seconds = F.coalesce(F.sum("latency_s"), F.lit(0.0))
    return scored.groupBy(*keys).agg(
        total.alias("total_tasks"),
        F.count_if("ok").alias("successes"),
        F.coalesce(F.avg("latency_s"), F.lit(0.0)).alias("avg_latency_s"),
        seconds.alias("total_time_s"),
        throughput(total, seconds, min_seconds).alias("throughput_rps"),
        *[
            F.coalesce(F.when(F.min("n") >= k, F.avg(f"__p{k}")), F.lit(0.0)).alias(f"pass@{k}")
            for k in ks
        ],
    )
