"""Telemetry queries."""

from pyspark.sql import functions as F

from fleetgauge.catalog.adapters import (
    GPU_ROWS,
    SAMPLES,
    SNAPSHOTS,
    epoch_seconds,
    gpu_infos,
    samples,
    snapshots,
    with_,
)
from fleetgauge.catalog.registry import query
from fleetgauge.fixed_values import PROGRESS_EVERY, REPORT_EVERY
from fleetgauge.operators import grid
from fleetgauge.operators import telemetry as tm
from fleetgauge.plans.ordered import with_running_sum

SUMMARY = """count(*) AS samples, avg(coalesce(cpu_percent, 0)) AS cpu_percent_avg,
  max(coalesce(cpu_percent, 0)) AS cpu_percent_max, avg(mem_percent) AS mem_percent_avg,
  max(mem_percent) AS mem_percent_max,
  round(avg(CASE gpus WHEN 1 THEN base % 101 WHEN 2 THEN (base % 101 + (base + 37) % 101) / 2.0::DOUBLE
           WHEN 3 THEN (base % 101 + (base + 37) % 101 + (base + 74) % 101) / 3.0::DOUBLE END), 9)
    AS gpu_util_percent_avg,
  CAST(max(CASE gpus WHEN 1 THEN base % 101 WHEN 2 THEN greatest(base % 101, (base + 37) % 101)
           WHEN 3 THEN greatest(base % 101, (base + 37) % 101, (base + 74) % 101) END) AS DOUBLE)
    AS gpu_util_percent_max"""


@query("run_summary", "A1", sql=with_(SAMPLES) + f"SELECT run_id, {SUMMARY} FROM samples GROUP BY 1")
def run_summary(t):
    return tm.run_summary(samples(t)).withColumn(
        "gpu_util_percent_avg", F.round("gpu_util_percent_avg", 9)
    )


_LATEST = """latest AS (SELECT * FROM (SELECT *, row_number() OVER
  (PARTITION BY run_id, tag, gpu_id ORDER BY ts DESC, ordinal DESC) AS rn FROM snapshots) r WHERE rn = 1)"""


@query(
    "latest_snapshot",
    "F1",
    sql=with_(SNAPSHOTS, _LATEST)
    + "SELECT run_id, tag, gpu_id, ts, ordinal, gpu_vram_used_gb FROM latest",
)
def latest_snapshot(t):
    rows = snapshots(t).select("run_id", "tag", "gpu_id", "ts", "ordinal", "gpu_vram_used_gb")
    return tm.latest(rows, ["run_id", "tag", "gpu_id"], ["ts", "ordinal"])


_DELTAS = """gpus AS (SELECT DISTINCT run_id, gpu_id FROM snapshots WHERE gpu_id IS NOT NULL),
stages AS (SELECT * FROM (VALUES ('model_load'), ('inference')) v(stage)),
pairs AS (SELECT g.run_id, g.gpu_id, stage,
    'before_' || stage || '_gpu' || g.gpu_id AS btag, 'after_' || stage || '_gpu' || g.gpu_id AS atag,
    b.gpu_vram_used_gb AS bv, a.gpu_vram_used_gb AS av,
    b.gpu_mem_allocated_gb AS ba, a.gpu_mem_allocated_gb AS aa,
    b.gpu_mem_reserved_gb AS br, a.gpu_mem_reserved_gb AS ar
  FROM gpus g CROSS JOIN stages
  LEFT JOIN latest b ON b.run_id = g.run_id AND b.gpu_id = g.gpu_id AND b.tag = 'before_' || stage || '_gpu' || g.gpu_id
  LEFT JOIN latest a ON a.run_id = g.run_id AND a.gpu_id = g.gpu_id AND a.tag = 'after_' || stage || '_gpu' || g.gpu_id),
deltas AS (
  SELECT run_id, gpu_id, stage, 'before' AS kind, btag AS tag, bv AS vram_used_gb, ba AS allocated_gb, br AS reserved_gb FROM pairs
  UNION ALL SELECT run_id, gpu_id, stage, 'after', atag, av, aa, ar FROM pairs
  UNION ALL SELECT run_id, gpu_id, stage, 'delta', 'delta_' || stage,
    CASE WHEN ok THEN av - bv END, CASE WHEN ok THEN aa - ba END, CASE WHEN ok THEN ar - br END
  FROM (SELECT *, bv IS NOT NULL AND av IS NOT NULL AND ba IS NOT NULL AND aa IS NOT NULL
          AND br IS NOT NULL AND ar IS NOT NULL AS ok FROM pairs) p)"""


@query(
    "stage_deltas",
    "F11",
    "J3",
    "J4",
    "P16",
    "P20",
    "F1",
    sql=with_(SNAPSHOTS, _LATEST, _DELTAS) + "SELECT * FROM deltas",
)
def stage_deltas(t):
    return tm.stage_deltas(snapshots(t))


@query(
    "stage_report",
    "I16",
    "P20",
    sql=with_(SNAPSHOTS, _LATEST, _DELTAS)
    + """SELECT run_id, gpu_id, stage, kind,
  gpu_id || '   | ' || rpad(tag, CAST(greatest(22, length(tag)) AS INT), ' ') || ' | ' || lpad(coalesce(printf('%.3f', vram_used_gb), 'NA'), 9, ' ')
  || ' | ' || lpad(coalesce(printf('%.3f', allocated_gb), 'NA'), 9, ' ')
  || ' | ' || lpad(coalesce(printf('%.3f', reserved_gb), 'NA'), 8, ' ') AS line FROM deltas""",
)
def stage_report(t):
    return tm.stage_report(tm.stage_deltas(snapshots(t)))


@query(
    "gpu_ids",
    "U2",
    "L2",
    "P16",
    sql=with_(SNAPSHOTS)
    + "SELECT DISTINCT run_id, gpu_id FROM snapshots WHERE gpu_id IS NOT NULL ORDER BY 1, 2",
)
def gpu_ids(t):
    return tm.gpu_ids(snapshots(t))


def _counters(t):
    """Per-user counters that only grow, apart from resets in a few samples."""
    return t.events.select(
        "user_id",
        "event_id",
        epoch_seconds("ts").alias("ts"),
        F.when(F.col("event_id") % 97 == 0, F.lit(0)).otherwise(F.col("event_id") * 3).cast("bigint").alias(
            "ctx_switches_vol"
        ),
        F.floor(epoch_seconds("ts")).cast("double").alias("cpu_user"),
    )


_RATES = """SELECT user_id, event_id, ts, ctx_switches_vol, cpu_user,
  CASE WHEN dv >= 0 THEN dv END AS ctx_switches_vol_delta,
  CASE WHEN dv >= 0 AND dt > 0 THEN dv / dt END AS ctx_switches_vol_rate,
  CASE WHEN dc >= 0 THEN dc END AS cpu_user_delta,
  CASE WHEN dc >= 0 AND dt > 0 THEN dc / dt END AS cpu_user_rate
FROM (SELECT *, ctx_switches_vol - lag(ctx_switches_vol) OVER w AS dv,
        cpu_user - lag(cpu_user) OVER w AS dc, ts - lag(ts) OVER w AS dt
      FROM (SELECT user_id, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS ts,
              CASE WHEN event_id % 97 = 0 THEN 0 ELSE event_id * 3 END AS ctx_switches_vol,
              floor(epoch_us(ts) / 1000000.0::DOUBLE) AS cpu_user FROM events) c
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) r"""


@query("counter_rates", "F5", sql=_RATES)
def counter_rates(t):
    return tm.counter_rates(
        _counters(t), ["user_id"], ["ctx_switches_vol", "cpu_user"], ties=["event_id"]
    )


@query(
    "cumulative_counters",
    "F5",
    sql="""SELECT user_id, event_id, sum(floor(value)) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS counter FROM events""",
)
def cumulative_counters(t):
    rows = t.events.select("user_id", "ts", "event_id", F.floor("value").cast("double").alias("v"))
    summed = with_running_sum(rows, ["user_id"], ["ts", "event_id"], F.col("v"), "counter")
    return summed.select("user_id", "event_id", "counter")


_DEVICES = """devices AS (SELECT CAST(floor(user_id / 25) AS INT) AS run_id,
  CAST(floor(epoch_us(ts) / 1000000.0::DOUBLE / 3600) AS BIGINT) AS hour,
  CASE WHEN event_type <> 'error' THEN CAST(user_id % 4 AS INT) END AS gpu_id,
  floor(value) AS used, 500 - floor(value) AS free,
  CASE WHEN event_id % 50 = 0 THEN 0.0 ELSE 500.0 END::DOUBLE AS total FROM events)"""


def _devices(t):
    used = F.floor("value").cast("double")
    return t.events.select(
        F.floor(F.col("user_id") / 25).cast("int").alias("run_id"),
        F.floor(epoch_seconds("ts") / 3600).cast("bigint").alias("hour"),
        F.when(F.col("event_type") != "error", (F.col("user_id") % 4).cast("int")).alias("gpu_id"),
        used.alias("used"),
        (500 - used).alias("free"),
        F.when(F.col("event_id") % 50 == 0, 0.0).otherwise(500.0).alias("total"),
    )


@query(
    "least_loaded_device",
    "A15",
    "L3",
    sql=with_(_DEVICES)
    + """SELECT run_id, hour, coalesce('cuda:' || (arg_min(gpu_id, used * 10 + gpu_id) FILTER (gpu_id IS NOT NULL)), 'cpu') AS device
FROM devices GROUP BY 1, 2""",
)
def least_loaded_device(t):
    return tm.least_loaded(_devices(t), ["run_id", "hour"])


@query(
    "most_free_device",
    "A15",
    "L3",
    sql=with_(_DEVICES)
    + """SELECT run_id, coalesce('cuda:' || (arg_min(gpu_id, -free * 10 + gpu_id) FILTER (gpu_id IS NOT NULL)), 'cpu') AS device
FROM devices GROUP BY 1""",
)
def most_free_device(t):
    return tm.least_loaded(_devices(t), ["run_id"], by_free=True)


_GATES = """gates AS (SELECT run_id, hour,
  coalesce(bool_or(CASE WHEN total > 0 THEN used / total ELSE 1.0 END < 0.1), false) AS available
  FROM devices GROUP BY 1, 2)"""


@query("capacity_gate", "A17", sql=with_(_DEVICES, _GATES) + "SELECT * FROM gates")
def capacity_gate(t):
    return tm.capacity_gate(_devices(t), ["run_id", "hour"], 0.1)


@query(
    "saturated_share",
    "A17",
    sql=with_(_DEVICES, _GATES)
    + """SELECT run_id, count(*) AS buckets, count(*) FILTER (NOT available) AS saturated,
  count(*) FILTER (NOT available) / count(*) AS saturated_share FROM gates GROUP BY 1""",
)
def saturated_share(t):
    return tm.saturated_share(tm.capacity_gate(_devices(t), ["run_id", "hour"], 0.1), ["run_id"])


_SLOT_SQL = ",\n".join(
    f"""max(coalesce(raw_load, 0)) FILTER (i = {i}) AS gpu_{i}_load_percent,
  max(mem_used_mb) FILTER (i = {i}) AS gpu_{i}_memory_used_mb,
  max(coalesce(raw_free, mem_total_mb - mem_used_mb)) FILTER (i = {i}) AS gpu_{i}_memory_free_mb,
  max(mem_total_mb) FILTER (i = {i}) AS gpu_{i}_memory_total_mb,
  max(mem_percent) FILTER (i = {i}) AS gpu_{i}_memory_percent,
  max(temp_c) FILTER (i = {i}) AS gpu_{i}_temperature_c, max(name) FILTER (i = {i}) AS gpu_{i}_name"""
    for i in range(3)
)


@query(
    "gpu_wide",
    "P6",
    "P5",
    sql=with_(GPU_ROWS)
    + f"""SELECT e.event_id, CAST(e.event_id % 4 AS INT) AS gpu_count, {_SLOT_SQL.replace("max(", "max(g.").replace("max(g.coalesce(", "max(coalesce(")}
FROM events e LEFT JOIN gpu_rows g ON g.event_id = e.event_id GROUP BY 1, 2""",
)
def gpu_wide(t):
    return tm.gpu_wide(gpu_infos(t), 3).drop("gpu_info", "run_id", "ts")


@query(
    "device_metrics",
    "P8",
    "P5",
    sql=with_(GPU_ROWS)
    + """SELECT event_id, 'Resource/GPU' || i || '_Utilization_%' AS metric, coalesce(raw_load, 0) AS value FROM gpu_rows
UNION ALL SELECT event_id, 'Resource/GPU' || i || '_Memory_%', mem_percent FROM gpu_rows
UNION ALL SELECT event_id, 'Resource/GPU' || i || '_Memory_GB', mem_used_mb / 1024.0::DOUBLE FROM gpu_rows""",
)
def device_metrics(t):
    return tm.device_metrics(gpu_infos(t), ["event_id"])


def _cores(t):
    core = F.transform(
        F.sequence(F.lit(0), F.lit(11)), lambda i: ((F.floor("value") + i * 13) % 100).cast("double")
    )
    return t.events.select(
        "event_id", F.slice(core, F.lit(1), (F.col("event_id") % 12).cast("int")).alias("per_core")
    )


@query(
    "core_slots",
    "P7",
    sql="""SELECT event_id, """
    + ", ".join(
        f"CASE WHEN event_id % 12 > {i} THEN (CAST(floor(value) AS BIGINT) + {i * 13}) % 100 ELSE 0 END::DOUBLE AS cpu_core_{i}"
        for i in range(4)
    )
    + """, array_to_string(list_transform(range(least(event_id % 12, 8)),
      lambda i: CAST((CAST(floor(value) AS BIGINT) + i * 13) % 100 AS VARCHAR)), ',') AS per_core
FROM events""",
)
def core_slots(t):
    wide = tm.core_slots(_cores(t))
    return wide.withColumn(
        "per_core", F.array_join(F.col("per_core").cast("array<bigint>").cast("array<string>"), ",")
    )


_TALL = "\nUNION ALL ".join(
    f"SELECT run_id, ordinal, '{name}' AS metric, coalesce({column}, 0) AS value FROM snapshots"
    for name, column in (
        ("GPU_Memory/VRAM_Used_GB", "gpu_vram_used_gb"),
        ("GPU_Memory/VRAM_Free_GB", "gpu_vram_free_gb"),
        ("GPU_Memory/VRAM_Total_GB", "gpu_vram_total_gb"),
        ("GPU_Memory/PyTorch_Allocated_GB", "gpu_mem_allocated_gb"),
        ("GPU_Memory/PyTorch_Reserved_GB", "gpu_mem_reserved_gb"),
        ("CPU_Memory/RAM_Used_GB", "cpu_ram_used_gb"),
        ("CPU_Memory/RAM_Total_GB", "cpu_ram_total_gb"),
        ("CPU_Memory/RAM_Percent", "cpu_ram_percent"),
    )
)


@query("snapshot_metrics", "P8", sql=with_(SNAPSHOTS) + _TALL)
def snapshot_metrics(t):
    return tm.snapshot_metrics(snapshots(t), ["run_id", "ordinal"])


@query(
    "metric_peaks",
    "A22",
    "P8",
    sql=with_(SNAPSHOTS, f"tall AS ({_TALL})")
    + "SELECT run_id, metric, max(value) AS max_value FROM tall GROUP BY 1, 2",
)
def metric_peaks(t):
    return tm.metric_peaks(tm.snapshot_metrics(snapshots(t), ["run_id"]))


@query(
    "elapsed_seconds",
    "P9",
    sql=with_(SAMPLES)
    + "SELECT run_id, event_id, ts - min(ts) OVER (PARTITION BY run_id) AS elapsed_s FROM samples",
)
def elapsed_seconds(t):
    rows = samples(t).select("run_id", "event_id", "ts")
    return tm.with_elapsed(rows, ["run_id"]).drop("ts")


@query(
    "temperature_bands",
    "P12",
    sql=with_(GPU_ROWS)
    + """SELECT run_id, CASE WHEN temp_c < 70 THEN 'ok' WHEN temp_c < 80 THEN 'warm' WHEN temp_c IS NOT NULL THEN 'hot' END AS band,
  count(*) AS samples FROM gpu_rows GROUP BY 1, 2""",
)
def temperature_bands(t):
    each = gpu_infos(t).select("run_id", F.explode("gpu_info").alias("g"))
    return each.groupBy("run_id", tm.temperature_band(F.col("g.temp_c")).alias("band")).agg(
        F.count(F.lit(1)).alias("samples")
    )


@query(
    "return_status",
    "P12",
    sql="""SELECT o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN 'ok' ELSE 'failed' END AS status,
  count(*) AS runs FROM orders GROUP BY 1, 2""",
)
def return_status(t):
    status = tm.return_status(F.col("o_orderkey") % 3)
    return t.orders.groupBy("o_orderpriority", status.alias("status")).agg(
        F.count(F.lit(1)).alias("runs")
    )


@query(
    "memory_use",
    "P3",
    "P4",
    sql="""SELECT o_orderkey, used / 1073741824.0::DOUBLE AS used_gb, total_b / 1073741824.0::DOUBLE AS total_gb,
  used / 1048576.0::DOUBLE AS used_mb,
  CASE WHEN total_b > 0 THEN CAST(used AS DOUBLE) / total_b * 100.0 ELSE 0.0 END AS used_percent
FROM (SELECT o_orderkey, total_b, total_b - CAST(floor(o_totalprice) AS BIGINT) * 1000 AS used
      FROM (SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE 600000000000 END AS total_b FROM orders) x) y""",
)
def memory_use(t):
    total = F.when(F.col("o_orderkey") % 11 == 0, F.lit(0)).otherwise(F.lit(600000000000))
    rows = t.orders.select(
        "o_orderkey",
        total.cast("bigint").alias("total_bytes"),
        (total - F.floor("o_totalprice").cast("bigint") * 1000).alias("available_bytes"),
    ).withColumn(
        "available_bytes", F.floor(F.col("total_bytes") - F.col("available_bytes")).cast("bigint")
    )
    return tm.with_memory_use(rows).select(
        "o_orderkey", "used_gb", "total_gb", "used_mb", "used_percent"
    )


_NTH = """SELECT user_id, event_id, rn AS ordinal FROM (SELECT user_id, event_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) r WHERE {w}"""


@query("every_tenth_task", "F6", sql=_NTH.format(w="rn % 10 = 0"))
def every_tenth_task(t):
    rows = t.events.select("user_id", "ts", "event_id")
    return grid.every_nth(rows, ["user_id"], ["ts", "event_id"], PROGRESS_EVERY).drop("ts")


@query("every_sixth_tick", "F6", sql=_NTH.format(w="(rn - 1) % 6 = 0"))
def every_sixth_tick(t):
    rows = t.events.select("user_id", "ts", "event_id")
    return grid.every_nth(
        rows, ["user_id"], ["ts", "event_id"], REPORT_EVERY, from_first=True
    ).drop("ts")


@query(
    "step_counter",
    "F7",
    sql="""SELECT run_id, event_id, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) - 1 AS step
FROM (SELECT CAST(floor(user_id / 25) AS INT) AS run_id, * FROM events) e""",
)
def step_counter(t):
    rows = t.events.select(
        F.floor(F.col("user_id") / 25).cast("int").alias("run_id"), "ts", "event_id"
    )
    return grid.with_step(rows, ["run_id"], ["ts", "event_id"]).drop("ts")


@query(
    "device_assignments",
    "A16",
    "L2",
    sql="""SELECT CASE WHEN s_nationkey = 0 THEN 'cpu' ELSE 'cuda:' || s_nationkey END AS device,
  count(*) AS assigned, s_nationkey = 0 AS on_cpu FROM supplier GROUP BY s_nationkey ORDER BY 1""",
)
def device_assignments(t):
    key = F.col("s_nationkey")
    placed = t.supplier.select(
        F.when(key == 0, F.lit("cpu"))
        .otherwise(F.concat(F.lit("cuda:"), key.cast("string")))
        .alias("device")
    )
    return tm.count_by_device(placed)


def _processes(t):
    return t.lineitem.select(
        F.col("l_shipdate").alias("ts"),
        F.col("l_orderkey").alias("pid"),
        F.when(F.col("l_linenumber") % 2 == 0, "Python3").otherwise("bash").alias("name"),
        F.when(F.col("l_returnflag") == "R", "python main.py --x").otherwise("python other").alias(
            "cmdline"
        ),
        F.when(F.col("l_discount") > 0.01, F.col("l_quantity")).alias("cpu_percent"),
        (F.floor("l_extendedprice").cast("bigint") * 1024).alias("rss_bytes"),
        F.col("l_orderkey").alias("vol_switches"),
        F.col("l_partkey").alias("nonvol_switches"),
    )


@query(
    "process_totals",
    "A18",
    "P18",
    sql="""SELECT l_shipdate AS ts, count(*) AS process_count,
  sum(CASE WHEN l_discount > 0.01 THEN l_quantity ELSE 0 END) AS total_cpu,
  sum(CAST(floor(l_extendedprice) AS BIGINT) * 1024)::DOUBLE / 1073741824.0::DOUBLE AS total_mem_gb,
  max(l_orderkey) FILTER (l_returnflag = 'R') AS main_pid,
  CAST(coalesce(sum(l_orderkey) FILTER (l_returnflag = 'R'), 0) AS BIGINT) AS voluntary,
  CAST(coalesce(sum(l_partkey) FILTER (l_returnflag = 'R'), 0) AS BIGINT) AS nonvoluntary,
  CAST(coalesce(sum(l_orderkey + l_partkey) FILTER (l_returnflag = 'R'), 0) AS BIGINT) AS total_switches
FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1""",
)
def process_totals(t):
    return tm.process_totals(_processes(t), "python")


@query(
    "switch_counts",
    "A23",
    sql="SELECT user_id AS tid, event_type AS comm, count(*) AS switches FROM events GROUP BY 1, 2",
)
def switch_counts(t):
    return tm.switch_counts(
        t.events.select(F.col("user_id").alias("tid"), F.col("event_type").alias("comm"))
    )


@query(
    "gpu_idle",
    "A10",
    sql="""SELECT event_type, greatest(0, 100 - avg(floor(value))) AS gpu_idle FROM events GROUP BY 1""",
)
def gpu_idle(t):
    return tm.gpu_idle(
        t.events.select("event_type", F.floor("value").cast("double").alias("util")), ["event_type"]
    )
