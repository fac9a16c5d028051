"""Domain tables from the given tables, in Spark and as SQL for the comparison.

Measures are whole numbers held as doubles, so sums do not depend on the order of addition and
both engines give the same bits. Times are epoch seconds computed without the session time zone.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.catalog.registry import Tables

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_micros(column: str) -> Column:
    seconds = f"CAST(CAST(CAST({column} AS TIMESTAMP_NTZ) - {_EPOCH} AS INTERVAL SECOND) AS DECIMAL(20, 6))"
    return F.expr(f"CAST({seconds} * 1000000 AS BIGINT)")


def epoch_seconds(column: str) -> Column:
    return epoch_micros(column) / 1e6


def snapshots(t: Tables) -> DataFrame:
    """Memory snapshots from events: the event type is the stage tag."""
    gpu = (F.col("user_id") % 4).cast("int")
    name = gpu.cast("string")
    tag = (
        F.when(F.col("event_type") == "signup", F.concat(F.lit("before_model_load_gpu"), name))
        .when(F.col("event_type") == "view", F.concat(F.lit("after_model_load_gpu"), name))
        .when(F.col("event_type") == "click", F.concat(F.lit("before_inference_gpu"), name))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("after_inference_gpu"), name))
        .otherwise(F.lit("before_model_load_cpu_only"))
    )
    used = F.floor("value").cast("double")
    return t.events.select(
        F.floor(F.col("user_id") / 25).cast("int").alias("run_id"),
        F.when(F.col("event_type") != "error", gpu).alias("gpu_id"),
        tag.alias("tag"),
        epoch_seconds("ts").alias("ts"),
        F.col("event_id").alias("ordinal"),
        used.alias("gpu_vram_used_gb"),
        (512 - used).alias("gpu_vram_free_gb"),
        F.lit(512.0).alias("gpu_vram_total_gb"),
        F.when(F.col("event_id") % 7 != 0, used * 2).alias("gpu_mem_allocated_gb"),
        (used * 3).alias("gpu_mem_reserved_gb"),
        F.lit(0.0).alias("cpu_ram_used_gb"),
        F.lit(64.0).alias("cpu_ram_total_gb"),
        F.least(used, F.lit(100.0)).alias("cpu_ram_percent"),
    )


SNAPSHOTS = """snapshots AS (
  SELECT CAST(floor(user_id / 25) AS INT) AS run_id,
         CASE WHEN event_type <> 'error' THEN CAST(user_id % 4 AS INT) END AS gpu_id,
         CASE event_type WHEN 'signup' THEN 'before_model_load_gpu' || (user_id % 4)
              WHEN 'view' THEN 'after_model_load_gpu' || (user_id % 4)
              WHEN 'click' THEN 'before_inference_gpu' || (user_id % 4)
              WHEN 'purchase' THEN 'after_inference_gpu' || (user_id % 4)
              ELSE 'before_model_load_cpu_only' END AS tag,
         epoch_us(ts) / 1000000.0::DOUBLE AS ts, event_id AS ordinal,
         floor(value) AS gpu_vram_used_gb, 512 - floor(value) AS gpu_vram_free_gb,
         512.0::DOUBLE AS gpu_vram_total_gb,
         CASE WHEN event_id % 7 <> 0 THEN floor(value) * 2 END AS gpu_mem_allocated_gb,
         floor(value) * 3 AS gpu_mem_reserved_gb,
         0.0::DOUBLE AS cpu_ram_used_gb, 64.0::DOUBLE AS cpu_ram_total_gb,
         least(floor(value), 100.0::DOUBLE) AS cpu_ram_percent
  FROM events)"""


def samples(t: Tables) -> DataFrame:
    """System samples from events, with zero to three devices per sample."""
    base = F.floor("value").cast("int")
    gpus = F.transform(
        F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), F.lit(1), (F.col("event_id") % 4).cast("int")),
        lambda i: F.struct(
            i.alias("gpu_index"), ((base + i * 37) % 101).cast("double").alias("util_percent")
        ),
    )
    return t.events.select(
        F.floor(F.col("user_id") / 25).cast("int").alias("run_id"),
        "event_id",
        epoch_seconds("ts").alias("ts"),
        F.when(F.col("event_type") != "error", (base % 101).cast("double")).alias("cpu_percent"),
        ((base * 3) % 101).cast("double").alias("mem_percent"),
        gpus.alias("gpu"),
    )


SAMPLES = """samples AS (
  SELECT CAST(floor(user_id / 25) AS INT) AS run_id, event_id,
         epoch_us(ts) / 1000000.0::DOUBLE AS ts,
         CASE WHEN event_type <> 'error' THEN CAST(CAST(floor(value) AS INT) % 101 AS DOUBLE) END
           AS cpu_percent,
         CAST(CAST(floor(value) AS INT) * 3 % 101 AS DOUBLE) AS mem_percent,
         CAST(floor(value) AS INT) AS base, CAST(event_id % 4 AS INT) AS gpus
  FROM events)"""


def gpu_infos(t: Tables) -> DataFrame:
    """Resource samples with device details, from events."""
    base = F.floor("value").cast("int")
    infos = F.transform(
        F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), F.lit(1), (F.col("event_id") % 4).cast("int")),
        lambda i: F.struct(
            i.alias("id"),
            F.concat(F.lit("device "), i.cast("string")).alias("name"),
            F.when((base + i) % 5 != 0, ((base + i * 37) % 101).cast("double")).alias("load_%"),
            ((base * 7 + i) % 1000).cast("double").alias("mem_used_mb"),
            F.when((base + i) % 3 != 0, F.lit(1000) - (base * 7 + i) % 1000)
            .cast("double")
            .alias("mem_free_mb"),
            F.lit(1000.0).alias("mem_total_mb"),
            (((base * 7 + i) % 1000) / 10.0).alias("mem_percent"),
            F.when((base + i) % 4 != 0, ((base + i * 11) % 100).cast("double")).alias("temp_c"),
        ),
    )
    return t.events.select(
        F.floor(F.col("user_id") / 25).cast("int").alias("run_id"),
        "event_id",
        epoch_seconds("ts").alias("ts"),
        infos.alias("gpu_info"),
    )


GPU_ROWS = """gpu_rows AS (
  SELECT CAST(floor(user_id / 25) AS INT) AS run_id, event_id,
         epoch_us(ts) / 1000000.0::DOUBLE AS ts, CAST(event_id % 4 AS INT) AS gpu_count, i,
         'device ' || i AS name,
         CASE WHEN (b + i) % 5 <> 0 THEN CAST((b + i * 37) % 101 AS DOUBLE) END AS raw_load,
         CAST((b * 7 + i) % 1000 AS DOUBLE) AS mem_used_mb,
         CASE WHEN (b + i) % 3 <> 0 THEN CAST(1000 - (b * 7 + i) % 1000 AS DOUBLE) END AS raw_free,
         1000.0::DOUBLE AS mem_total_mb, ((b * 7 + i) % 1000) / 10.0::DOUBLE AS mem_percent,
         CASE WHEN (b + i) % 4 <> 0 THEN CAST((b + i * 11) % 100 AS DOUBLE) END AS temp_c
  FROM (SELECT *, CAST(floor(value) AS INT) AS b FROM events) e,
       (SELECT unnest([0, 1, 2]) AS i) d
  WHERE i < e.event_id % 4)"""


def attempts(t: Tables) -> DataFrame:
    """Attempts from line items: supplier is the agent, part the task.

    The attempt number is row-local, so building the table needs no ordering.
    """
    start = epoch_seconds("l_shipdate") + F.col("l_linenumber") * 3600
    return t.lineitem.select(
        F.col("l_suppkey").alias("agent_id"),
        F.col("l_partkey").alias("task_id"),
        (
            F.col("l_orderkey") * 64
            + F.col("l_linenumber") * 8
            + F.col("l_quantity").cast("bigint") % 8
        ).alias("attempt"),
        (F.col("l_orderkey") % 4).cast("int").alias("gpu_id"),
        F.concat(F.lit("answer "), F.col("l_orderkey").cast("string")).alias("completion"),
        F.col("l_quantity").alias("latency_s"),
        (F.col("l_returnflag") == "R").alias("ok"),
        (F.col("l_returnflag") == "R").alias("passed"),
        (F.col("l_linestatus") == "O").alias("is_reflection"),
        start.alias("start_s"),
        (start + F.col("l_quantity") * 600).alias("end_s"),
    )


ATTEMPTS = """attempts AS (
  SELECT l_suppkey AS agent_id, l_partkey AS task_id,
         l_orderkey * 64 + l_linenumber * 8 + CAST(l_quantity AS BIGINT) % 8 AS attempt,
         CAST(l_orderkey % 4 AS INT) AS gpu_id, 'answer ' || l_orderkey AS completion,
         l_quantity AS latency_s, l_returnflag = 'R' AS ok, l_returnflag = 'R' AS passed,
         l_linestatus = 'O' AS is_reflection,
         epoch(l_shipdate) + l_linenumber * 3600 AS start_s,
         epoch(l_shipdate) + l_linenumber * 3600 + l_quantity * 600 AS end_s
  FROM lineitem)"""


def problems(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("task_id"),
        F.col("p_name").alias("prompt"),
        F.regexp_replace("p_brand", "#", "_").alias("entry_point"),
    )


def raw_answers(t: Tables) -> DataFrame:
    """Model answers made of whole documents: fence, preface, signature, docstring and prose.

    Which parts a text gets depends on its id, so every clean-up branch meets every language.
    """
    d = F.col("doc_id")
    nl = F.lit("\n")
    body = F.array_join(
        F.transform(
            F.split("text", "\n", -1),
            lambda line, i: F.concat(F.repeat(F.lit(" "), ((i % 3) * 4 + d % 3).cast("int")), line),
        ),
        "\n",
    )
    entry = F.concat(F.lit("f"), (d % 10).cast("string"))
    answer = F.concat(
        F.when(d % 2 == 0, F.lit("```python\n")).when(d % 5 == 0, F.lit("```\n")).otherwise(F.lit("")),
        F.when(d % 3 == 0, F.lit("Here is: ")).when(d % 7 == 0, F.lit("The  function.")).otherwise(F.lit("")),
        F.when(d % 4 == 0, F.lit("import os\nfrom sys import path\n")).otherwise(F.lit("")),
        F.when(
            d % 3 != 1,
            F.concat(F.lit("def "), entry, F.lit("(a,\n      b):\n")),
        ).otherwise(F.lit("")),
        F.when(d % 6 == 0, F.lit('    """One line."""\n'))
        .when(d % 6 == 2, F.lit("    '''Many\n    lines\n    '''\n"))
        .otherwise(F.lit("")),
        body,
        F.when(d % 5 == 1, F.lit("\n    items = []\n\n    return items")).otherwise(F.lit("")),
        F.when(d % 4 == 1, F.lit("\nThis function works.\nmore")).otherwise(F.lit("")),
        F.when(d % 2 == 0, F.lit("\n```")).otherwise(F.lit("")),
    )
    return t.documents.select("doc_id", "source", entry.alias("entry_point"), answer.alias("answer"))


ANSWERS = r"""answers AS (
  SELECT doc_id, source, 'f' || (doc_id % 10) AS entry_point,
    (CASE WHEN doc_id % 2 = 0 THEN '```python' || chr(10)
          WHEN doc_id % 5 = 0 THEN '```' || chr(10) ELSE '' END)
    || (CASE WHEN doc_id % 3 = 0 THEN 'Here is: ' WHEN doc_id % 7 = 0 THEN 'The  function.' ELSE '' END)
    || (CASE WHEN doc_id % 4 = 0 THEN 'import os' || chr(10) || 'from sys import path' || chr(10) ELSE '' END)
    || (CASE WHEN doc_id % 3 <> 1
        THEN 'def f' || (doc_id % 10) || '(a,' || chr(10) || '      b):' || chr(10) ELSE '' END)
    || (CASE WHEN doc_id % 6 = 0 THEN '    ""' || '"One line.""' || '"' || chr(10)
             WHEN doc_id % 6 = 2 THEN '    ' || repeat(chr(39), 3) || 'Many' || chr(10) || '    lines'
                  || chr(10) || '    ' || repeat(chr(39), 3) || chr(10) ELSE '' END)
    || array_to_string(list_transform(string_split(text, chr(10)),
         lambda line, i: repeat(' ', CAST(((i - 1) % 3) * 4 + doc_id % 3 AS INT)) || line), chr(10))
    || (CASE WHEN doc_id % 5 = 1 THEN chr(10) || '    items = []' || chr(10) || chr(10) || '    return items'
        ELSE '' END)
    || (CASE WHEN doc_id % 4 = 1 THEN chr(10) || 'This function works.' || chr(10) || 'more' ELSE '' END)
    || (CASE WHEN doc_id % 2 = 0 THEN chr(10) || '```' ELSE '' END) AS answer
  FROM documents)"""


def trace_events(t: Tables) -> DataFrame:
    """Trace events from conversations, one stage per turn."""
    turn, c = F.col("turn"), F.col("conv_id")
    stage = (
        F.when(turn == 0, "reasoning")
        .when(turn == 1, "action")
        .when(turn == 2, "observation")
        .otherwise("reflection")
    )
    size = F.length("text")
    acted = F.col("stage").isin("action", "reflection")
    off = (F.col("stage") == "reflection") & (c % 5 == 0)
    return t.conversations.withColumn("stage", stage).select(
        (c % 10).alias("run_id"),
        F.col("conv_id").alias("task_id"),
        (c * 4000 + turn * (c % 7 + 1)).cast("double").alias("timestamp"),
        "stage",
        F.struct(
            F.when(acted & ~off, (size % 50).cast("double")).alias("latency_s"),
            F.when(acted, ~off & (size % 3 == 0)).alias("success"),
            F.when(acted & ~off, F.left("text", F.lit(160))).alias("completion_preview"),
            F.when(F.col("stage") == "observation", F.lit(True)).alias("need_reflection"),
            F.when(F.col("stage") == "reflection", F.when(off, 0).otherwise(turn - 2))
            .cast("int")
            .alias("attempt"),
            F.when(off, F.lit(False)).alias("enabled"),
        ).alias("payload"),
    )


TRACE = """trace AS (
  SELECT *, stage IN ('action', 'reflection') AS acted,
         stage = 'reflection' AND conv_id % 5 = 0 AS off,
         CASE WHEN stage IN ('action', 'reflection') AND NOT (stage = 'reflection' AND conv_id % 5 = 0)
              THEN CAST(size % 50 AS DOUBLE) END AS latency_s,
         CASE WHEN stage IN ('action', 'reflection')
              THEN NOT (stage = 'reflection' AND conv_id % 5 = 0) AND size % 3 = 0 END AS success,
         CASE WHEN stage = 'reflection' THEN CASE WHEN conv_id % 5 = 0 THEN 0 ELSE turn - 2 END END
           AS attempt,
         CASE WHEN stage IN ('action', 'reflection') AND NOT (stage = 'reflection' AND conv_id % 5 = 0)
              THEN left(text, 160) END AS preview
  FROM (SELECT conv_id % 10 AS run_id, conv_id AS task_id, conv_id, turn, text,
               length(text) AS size,
               CAST(conv_id * 4000 + turn * (conv_id % 7 + 1) AS DOUBLE) AS timestamp,
               CASE turn WHEN 0 THEN 'reasoning' WHEN 1 THEN 'action' WHEN 2 THEN 'observation'
                    ELSE 'reflection' END AS stage
        FROM conversations) c)"""


def phases(t: Tables) -> DataFrame:
    """Phase metrics per order priority, before and after 1998."""
    price = F.floor("o_totalprice").cast("double")
    return (
        t.orders.select(
            F.col("o_orderpriority").alias("run_id"),
            F.when(F.col("o_orderdate") < F.expr("TIMESTAMP_NTZ'1998-01-01 00:00:00'"), "before")
            .otherwise("after")
            .alias("phase"),
            price.alias("price"),
            (price % 100).alias("pct"),
            (F.col("o_orderstatus") == "F").alias("ok"),
        )
        .groupBy("run_id", "phase")
        .agg(
            (F.avg("price") / 1000).alias("avg_latency_s"),
            (F.count(F.lit(1)) / F.lit(1000.0)).alias("throughput_rps"),
            F.count_if("ok").cast("double").alias("successes"),
            F.avg("pct").alias("gpu_idle"),
            F.sum("pct").alias("context_switches_per_sec"),
            F.max("pct").alias("cpu_util"),
            F.when(F.col("run_id") != "5-LOW", F.min("price") / 1000).otherwise(F.lit(0.0)).alias("avg_sched_latency_us"),
        )
    )


PHASES = """phases AS (
  SELECT run_id, phase, avg(price) / 1000 AS avg_latency_s, count(*) / 1000.0::DOUBLE AS throughput_rps,
         CAST(count(*) FILTER (ok) AS DOUBLE) AS successes, avg(pct) AS gpu_idle,
         sum(pct) AS context_switches_per_sec, max(pct) AS cpu_util,
         CASE WHEN run_id <> '5-LOW' THEN min(price) / 1000 ELSE 0.0 END AS avg_sched_latency_us
  FROM (SELECT o_orderpriority AS run_id,
               CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'before' ELSE 'after' END AS phase,
               floor(o_totalprice) AS price, floor(o_totalprice) % 100 AS pct, o_orderstatus = 'F' AS ok
        FROM orders) o
  GROUP BY run_id, phase)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
