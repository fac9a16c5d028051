"""Work grids: prompts, agents x tasks, sweeps and sampling of ordered rows."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.fixed_values import (
    CORRECTION_TAIL,
    PROMPT_HEAD,
    PROMPT_TAIL,
    SYSTEM_MESSAGE,
)
from fleetgauge.plans.ordered import DEFAULT_LIMITS, SliceLimits, first_rows, with_ordinal


def first_tasks(
    problems: DataFrame, count: int, order: str = "ordinal", limits: SliceLimits = DEFAULT_LIMITS
) -> DataFrame:
    """The first ``count`` problems in file order; 0 means all.

    Up to ``limits.rows_per_task`` they are collected from all tasks into one. More are cut off where
    they lie: problems are dealt by ranges of the order, ranges are counted, and only the one that the last
    row falls in is looked into.
    ``order`` must identify a row there.
    """
    if not count:
        return problems
    if count <= limits.rows_per_task:
        return problems.orderBy(order).limit(count)
    return first_rows(problems, [order], count, limits)


def prompts(problems: DataFrame) -> DataFrame:
    """Prompt rows around each problem; missing texts count as empty."""
    text = F.coalesce("prompt", F.lit(""))
    return problems.select(
        text.alias("prompt_text"),
        F.coalesce("task_id", F.lit("")).alias("task_id"),
        F.coalesce("entry_point", F.lit("")).alias("entry_point"),
        F.lit(SYSTEM_MESSAGE).alias("system_msg"),
        F.concat(F.lit(PROMPT_HEAD), text, F.lit(PROMPT_TAIL)).alias("user_msg"),
    )


def corrective_prompts(prompt_rows: DataFrame, failed: DataFrame) -> DataFrame:
    """Prompts of failed tasks with the corrective message; ``failed`` has ``task_id``."""
    again = prompt_rows.join(failed.select("task_id").distinct(), "task_id", "left_semi")
    return again.withColumn(
        "user_msg", F.concat(F.lit(PROMPT_HEAD), F.col("prompt_text"), F.lit(CORRECTION_TAIL))
    )


def numbered_tasks(
    problems: DataFrame, order: Sequence[str], limits: SliceLimits = DEFAULT_LIMITS
) -> DataFrame:
    """``task_idx``: 0-based position of each problem in the list."""
    placed = with_ordinal(problems, [], order, "__pos", limits=limits)
    return placed.withColumn("task_idx", F.col("__pos") - 1).drop("__pos")


def work_items(tasks: DataFrame, num_agents: int, devices: int | None = None) -> DataFrame:
    """Every agent with every task, agent-major, dealt to devices in turn.

    Agents are generated beside each task, in blocks so that no row holds a list of all of them;
    nothing is shuffled and neither side needs to fit in memory. ``tasks`` has ``task_idx``
    (0-based, gapless).
    """
    if num_agents <= 0:
        tasks, num_agents = tasks.limit(0), 1
    count, block = tasks.count(), 10_000
    last = (num_agents - 1) // block
    items = (
        tasks.withColumn("__block", F.explode(F.expr(f"sequence(0L, {last}L)")))
        if last
        else tasks.withColumn("__block", F.lit(0).cast("bigint"))
    )
    first = F.col("__block") * block
    upto = F.least(first + block - 1, F.lit(num_agents - 1))
    items = items.withColumn("agent_id", F.explode(F.sequence(first, upto))).drop("__block")
    items = items.withColumn("work_index", F.col("agent_id") * count + F.col("task_idx"))
    if devices:
        items = items.withColumn("gpu_id", F.pmod("work_index", F.lit(devices)).cast("int"))
    return items


def items_of_agent(items: DataFrame, agent_id: int) -> DataFrame:
    return items.where(F.col("agent_id") == agent_id)


def sweep_grid(benchmarks: DataFrame, agent_counts: Sequence[int]) -> DataFrame:
    """Each benchmark with each agent count (a fixed short list)."""
    counts = F.array(*[F.lit(int(n)) for n in agent_counts])
    return benchmarks.withColumn("num_agents", F.explode(counts))


def every_nth(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    n: int,
    from_first: bool = False,
    limits: SliceLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """Rows n, 2n, ... of each key; ``from_first`` takes rows 1, n+1, 2n+1, ... instead."""
    numbered = with_ordinal(df, keys, order, "ordinal", limits=limits)
    shift = 1 if from_first else 0
    return numbered.where(F.pmod(F.col("ordinal") - shift, F.lit(n)) == 0)


def with_step(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    limits: SliceLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """0-based step counter per run."""
    numbered = with_ordinal(df, keys, order, "__pos", limits=limits)
    return numbered.withColumn("step", F.col("__pos") - 1).drop("__pos")
