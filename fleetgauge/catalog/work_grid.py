"""Prompt and work-grid queries."""

from pyspark.sql import functions as F

from fleetgauge.catalog.adapters import problems
from fleetgauge.catalog.registry import query
from fleetgauge.fixed_values import (
    CORRECTION_TAIL,
    PROMPT_HEAD,
    PROMPT_TAIL,
    REASONING_HEAD,
    SWEEP_AGENT_COUNTS,
    SYSTEM_MESSAGE,
)
from fleetgauge.functions.text import preview
from fleetgauge.operators import grid
from fleetgauge.plans.ordered import SliceLimits


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


@query(
    "prompts",
    "P1",
    "S4",
    sql=f"""SELECT p_partkey AS task_id, p_name AS prompt_text, replace(p_brand, '#', '_') AS entry_point,
  {_text(SYSTEM_MESSAGE)} AS system_msg,
  {_text(PROMPT_HEAD)} || p_name || {_text(PROMPT_TAIL)} AS user_msg FROM part""",
)
def prompts(t):
    return grid.prompts(problems(t))


@query(
    "corrective_prompts",
    "P2",
    sql=f"""SELECT p_partkey AS task_id, p_name AS prompt_text, replace(p_brand, '#', '_') AS entry_point,
  {_text(SYSTEM_MESSAGE)} AS system_msg,
  {_text(PROMPT_HEAD)} || p_name || {_text(CORRECTION_TAIL)} AS user_msg
FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'R') < 10)""",
)
def corrective_prompts(t):
    failed = (
        t.lineitem.groupBy(F.col("l_partkey").alias("task_id"))
        .agg(F.count_if(F.col("l_returnflag") == "R").alias("ok"))
        .where("ok < 10")
    )
    return grid.corrective_prompts(grid.prompts(problems(t)), failed)


@query(
    "text_previews",
    "P13",
    sql=f"""SELECT doc_id, {_text(REASONING_HEAD)} || left(text, 120) AS reasoning, left(text, 160) AS preview_160,
  left(text, 200) AS preview_200, left(text, 500) AS preview_500 FROM documents""",
)
def text_previews(t):
    text = F.col("text")
    return t.documents.select(
        "doc_id",
        F.concat(F.lit(REASONING_HEAD), preview(text, 120)).alias("reasoning"),
        *[preview(text, n).alias(f"preview_{n}") for n in (160, 200, 500)],
    )


_ITEMS = """items AS (SELECT a.agent_id, task_idx, a.agent_id * n + task_idx AS work_index,
    task_id, CAST((a.agent_id * n + task_idx) % 4 AS INT) AS gpu_id
  FROM (SELECT unnest(range(7)) AS agent_id) a,
       (SELECT p_partkey AS task_id, row_number() OVER (ORDER BY p_partkey) - 1 AS task_idx,
               count(*) OVER () AS n FROM part) p)"""


def _items(t):
    tasks = grid.numbered_tasks(problems(t).select("task_id"), ["task_id"])
    return grid.work_items(tasks, 7, devices=4)


@query("work_items", "J1", "F3", sql=f"WITH {_ITEMS} SELECT * FROM items")
def work_items(t):
    return _items(t)


@query("items_of_agent", "J7", sql=f"WITH {_ITEMS} SELECT * FROM items WHERE agent_id = 3")
def items_of_agent(t):
    return grid.items_of_agent(_items(t), 3)


@query(
    "items_per_device",
    "F3",
    "A16",
    sql=f"WITH {_ITEMS} SELECT agent_id, gpu_id, count(*) AS tasks FROM items GROUP BY 1, 2",
)
def items_per_device(t):
    return _items(t).groupBy("agent_id", "gpu_id").agg(F.count(F.lit(1)).alias("tasks"))


@query(
    "sweep_grid",
    "J2",
    sql="""SELECT benchmark, CAST(num_agents AS INT) AS num_agents
FROM (SELECT DISTINCT o_orderpriority AS benchmark FROM orders) b,
     (SELECT unnest([500, 1000, 1500, 2000]) AS num_agents) n""",
)
def sweep_grid(t):
    benchmarks = t.orders.select(F.col("o_orderpriority").alias("benchmark")).distinct()
    return grid.sweep_grid(benchmarks, SWEEP_AGENT_COUNTS)


@query(
    "first_tasks",
    "L1",
    sql="SELECT p_partkey AS task_id, p_name AS prompt FROM part ORDER BY p_partkey LIMIT 100",
)
def first_tasks(t):
    return grid.first_tasks(problems(t).select("task_id", "prompt"), 100, "task_id")


@query(
    "first_half_of_tasks",
    "L1",
    sql="SELECT p_partkey AS task_id, p_name AS prompt FROM part ORDER BY p_partkey LIMIT (SELECT count(*) // 2 FROM part)",
)
def first_half_of_tasks(t):
    """Too many for one task, as the limit is set here."""
    tasks = problems(t).select("task_id", "prompt")
    return grid.first_tasks(tasks, t.part.count() // 2, "task_id", SliceLimits(rows_per_task=50))


@query("all_tasks", "L1", sql="SELECT p_partkey AS task_id, p_name AS prompt FROM part")
def all_tasks(t):
    return grid.first_tasks(problems(t).select("task_id", "prompt"), 0, "task_id")
