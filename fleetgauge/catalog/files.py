"""Scans and sinks: whole tables are written in a log format and read back.

Files go to a fresh folder under the shared one, so a query can run again at any time.
"""

from pyspark.sql import functions as F

from fleetgauge import schemas
from fleetgauge.catalog.adapters import (
    ATTEMPTS,
    PHASES,
    SNAPSHOTS,
    TRACE,
    attempts,
    phases,
    snapshots,
    trace_events,
    with_,
)
from fleetgauge.catalog.profiles import REPORT_SQL, perf_lines
from fleetgauge.catalog.registry import query
from fleetgauge.operators import compare, grid
from fleetgauge.operators import evaluation as ev
from fleetgauge.operators import profile as pf
from fleetgauge.operators import telemetry as tm
from fleetgauge.sources import delimited, json_files, sinks, text_files
from fleetgauge.sources.scratch import fresh_path

_EVENT = schemas.row(
    event_id=schemas.L, user_id=schemas.L, event_type=schemas.S, value=schemas.D
)
_EVENTS = "SELECT event_id, user_id, event_type, value FROM events"


def _events(t):
    return t.events.select("event_id", "user_id", "event_type", "value")


@query("scan_jsonl_strict", "S1", "K2", sql=_EVENTS)
def scan_jsonl_strict(t):
    path = fresh_path(t.spark, "jsonl")
    sinks.overwrite_jsonl(_events(t), path)
    return json_files.read_jsonl_strict(t.spark, path, _EVENT)


def _spoiled_lines(t):
    """Event lines, some of them broken, blank or not objects."""
    i = F.col("event_id")
    good = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    line = (
        F.when(i % 10 == 0, F.lit('{"event_id": 1, "user'))
        .when(i % 10 == 1, F.lit(""))
        .when(i % 10 == 2, F.lit("[1, 2]"))
        .when(i % 10 == 3, F.lit("17"))
        .otherwise(good)
    )
    return t.events.select(line.alias("line"))


@query("scan_jsonl_lenient", "S2", "S1", sql=_EVENTS + " WHERE event_id % 10 > 3")
def scan_jsonl_lenient(t):
    path = fresh_path(t.spark, "lenient")
    _spoiled_lines(t).write.text(path)
    missing = fresh_path(t.spark, "never-written")
    return json_files.read_jsonl_lenient(t.spark, [path, missing], _EVENT)


@query(
    "scan_jsonl_rejects",
    "S2",
    sql="""SELECT CASE event_id % 10 WHEN 0 THEN 'truncated' ELSE 'not an object' END AS reason, count(*) AS lines
FROM events WHERE event_id % 10 IN (0, 2, 3) GROUP BY 1""",
)
def scan_jsonl_rejects(t):
    path = fresh_path(t.spark, "lenient")
    _spoiled_lines(t).write.text(path)
    marked = json_files.read_jsonl_marked(t.spark, path, _EVENT)
    bad = F.col("_corrupt_record")
    reason = F.when(bad.startswith("{"), "truncated").otherwise("not an object")
    return marked.where(bad.isNotNull()).groupBy(reason.alias("reason")).agg(
        F.count(F.lit(1)).alias("lines")
    )


@query(
    "scan_completions",
    "S3",
    "K7",
    "S14",
    sql=with_(ATTEMPTS)
    + """SELECT agent_id, count(*) AS completions, count(DISTINCT task_id) AS tasks, max(completion) AS last_completion
FROM attempts GROUP BY 1""",
)
def scan_completions(t):
    path = fresh_path(t.spark, "completions")
    rows = attempts(t).select("agent_id", F.col("task_id").cast("string").alias("task_id"), "completion")
    sinks.write_by_key(rows, path, ["agent_id"])
    return (
        json_files.read_completions(t.spark, path)
        .groupBy("agent_id")
        .agg(
            F.count(F.lit(1)).alias("completions"),
            F.count_distinct("task_id").alias("tasks"),
            F.max("completion").alias("last_completion"),
        )
    )


@query(
    "rerun_of_one_agent",
    "S3",
    "K7",
    "S14",
    sql=with_(ATTEMPTS)
    + """SELECT agent_id, count(*) AS completions,
  count(*) FILTER (agent_id = 7 OR completion LIKE '%again') AS again
FROM attempts WHERE agent_id <> 9 GROUP BY 1""",
)
def rerun_of_one_agent(t):
    """Agent 7 runs again, which replaces its folder; agent 9 is left out by its folder."""
    path = fresh_path(t.spark, "completions")
    rows = attempts(t).select("agent_id", F.col("task_id").cast("string").alias("task_id"), "completion")
    sinks.write_by_key(rows, path, ["agent_id"])
    again = rows.where("agent_id = 7").withColumn("completion", F.concat("completion", F.lit(" again")))
    sinks.replace_by_key(again, path, ["agent_id"])
    kept = json_files.read_completions_by_agent(t.spark, path).where("agent_id <> 9")
    return kept.groupBy("agent_id").agg(
        F.count(F.lit(1)).alias("completions"), F.count_if(F.col("completion").endswith("again")).alias("again")
    )


@query(
    "scan_problems_gzip",
    "S4",
    "K3",
    "L1",
    "J5",
    sql="""SELECT CAST(doc_id AS VARCHAR) AS task_id, text AS prompt, lang AS entry_point FROM documents
WHERE doc_id IN (SELECT doc_id FROM labels)""",
)
def scan_problems_gzip(t):
    path = fresh_path(t.spark, "problems")
    known = t.documents.select(
        F.col("doc_id").cast("string").alias("task_id"),
        F.col("text").alias("prompt"),
        F.col("lang").alias("entry_point"),
    )
    tried = t.labels.select(F.col("doc_id").cast("string").alias("task_id"))
    sinks.write_gzip_jsonl(ev.attempted_problems(known, tried), path)
    listed = grid.first_tasks(json_files.read_problems(t.spark, path), 0)
    return listed.select("task_id", "prompt", "entry_point")


@query(
    "scan_score_documents",
    "S5",
    "K4",
    sql="""SELECT count(*) AS runs, CAST(sum(total) AS BIGINT) AS total, sum(lat) AS avg_latency_s, sum(0.0::DOUBLE) AS pass_1
FROM (SELECT o_orderpriority, count(*) AS total, max(floor(o_totalprice)) AS lat FROM orders GROUP BY 1) r""",
)
def scan_score_documents(t):
    path = fresh_path(t.spark, "scores")
    runs = t.orders.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("total"),
        F.max(F.floor("o_totalprice").cast("double")).alias("avg_latency_s"),
    )
    document = F.to_json(F.struct("total", "avg_latency_s"), {"pretty": "true"})
    by = F.regexp_replace("o_orderpriority", "[^0-9A-Z]", "_").alias("run")
    sinks.write_text(runs.select(by, document.alias("document")), path, "document", ["run"])
    scores = json_files.read_scores(t.spark, path + "/*")
    return scores.agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("total").alias("total"),
        F.sum("avg_latency_s").alias("avg_latency_s"),
        F.sum("`pass@1`").alias("pass_1"),
    )


@query(
    "scan_agent_summaries",
    "S6",
    "K4",
    "A3",
    sql="""SELECT r.run_id, s.agents AS num_agents, 10 * s.agents AS total_evaluations, r.agent_id, r.total_tasks, r.successes, r.avg_latency_s
FROM (SELECT l_returnflag AS run_id, l_suppkey AS agent_id, count(*) AS total_tasks,
        count(*) FILTER (l_linestatus = 'O') AS successes, avg(l_quantity) AS avg_latency_s
      FROM lineitem GROUP BY 1, 2) r
JOIN (SELECT l_returnflag AS run_id, count(DISTINCT l_suppkey) AS agents FROM lineitem GROUP BY 1) s ON s.run_id = r.run_id""",
)
def scan_agent_summaries(t):
    path = fresh_path(t.spark, "summaries")
    agents = t.lineitem.groupBy(
        F.col("l_returnflag").alias("run_id"), F.col("l_suppkey").alias("agent_id")
    ).agg(
        F.count(F.lit(1)).alias("total_tasks"),
        F.count_if(F.col("l_linestatus") == "O").alias("successes"),
        F.avg("l_quantity").alias("avg_latency_s"),
    )
    runs = t.lineitem.groupBy(F.col("l_returnflag").alias("run_id")).agg(
        F.count_distinct("l_suppkey").alias("num_agents"), F.lit(10).alias("num_tasks")
    )
    documents = sinks.summary_documents(agents, runs, agents_per_document=64)
    sinks.write_documents(documents, path, ["run_id"])
    rows = json_files.read_agent_summaries(t.spark, path, multi_line=False)
    run = F.regexp_extract("source_file", "run_id=([^/]*)/", 1)
    return rows.select(
        run.alias("run_id"),
        "num_agents",
        "total_evaluations",
        "agent_id",
        "total_tasks",
        "successes",
        "avg_latency_s",
    )


def _gpu_csv(t):
    path = fresh_path(t.spark, "gpu-csv")
    table = t.events.select(
        F.col("event_id").alias("timestamp"),
        (F.col("user_id") % 4).alias("gpu_id"),
        F.when(F.col("event_type") == "error", "[N/A]")
        .otherwise(F.least(F.floor("value"), F.lit(100)).cast("string"))
        .alias("gpu_util"),
        (F.floor("value") % 100).alias("mem_util"),
    )
    table.write.option("header", True).csv(path)
    return delimited.read_header_csv(t.spark, path)


_CSV_CELLS = """cells AS (SELECT 'gpu_util' AS "column", least(floor(value), 100) AS util FROM events WHERE event_type <> 'error'
  UNION ALL SELECT 'mem_util', floor(value) % 100 FROM events)"""


@query(
    "scan_header_csv",
    "S7",
    "A10",
    sql=with_(_CSV_CELLS)
    + 'SELECT "column", count(*) AS cells, greatest(0, 100 - avg(util)) AS gpu_idle FROM cells GROUP BY 1',
)
def scan_header_csv(t):
    cells = delimited.utilisation_values(_gpu_csv(t))
    idle = tm.gpu_idle(cells, ["column"])
    return cells.groupBy("column").agg(F.count(F.lit(1)).alias("cells")).join(idle, "column")


@query(
    "scan_header_csv_any_gpu_column",
    "S7",
    "A10",
    sql=with_(_CSV_CELLS)
    + """SELECT greatest(0, 100 - avg(util)) AS gpu_idle
FROM (SELECT util FROM cells UNION ALL SELECT user_id % 4 FROM events) c""",
)
def scan_header_csv_any_gpu_column(t):
    return tm.gpu_idle(delimited.utilisation_values(_gpu_csv(t), compat=True), [])


def _gpu_lines(t):
    i = F.col("event_id")
    u = F.floor("value").cast("string")
    cells = [
        (i % 8).cast("string"), u, F.lit("20"), u, F.lit("16000"), F.lit("65.5"),
        F.when(i % 7 == 0, "[N/A]").otherwise("50"), F.lit("70"),
    ]
    width = F.element_at(F.array(F.lit(3), F.lit(5), F.lit(8)), (i % 3 + 1).cast("int"))
    line = F.array_join(F.slice(F.array(*cells), F.lit(1), width), ", ")
    return t.events.select("event_id", line.alias("line"))


@query(
    "scan_gpu_csv",
    "S8",
    sql="""SELECT 3 AS fields, event_id, CAST(event_id % 8 AS INT) AS gpu_index, floor(value) AS util_percent FROM events WHERE event_id % 3 = 0
UNION ALL SELECT 5, event_id, CAST(event_id % 8 AS INT), floor(value) FROM events WHERE event_id % 3 > 0
UNION ALL SELECT 8, event_id, CAST(event_id % 8 AS INT), floor(value) FROM events WHERE event_id % 3 = 2 AND event_id % 7 <> 0""",
)
def scan_gpu_csv(t):
    path = fresh_path(t.spark, "gpu-lines")
    lines = _gpu_lines(t)
    lines.select(F.concat_ws("|", F.col("event_id").cast("string"), "line")).write.text(path)
    read = text_files.read_lines(t.spark, path).select(
        F.substring_index("line", "|", 1).cast("bigint").alias("event_id"),
        F.substring_index("line", "|", -1).alias("line"),
    )
    parts = [
        delimited.parse_gpu_csv(read, n, ["event_id"]).select(
            F.lit(n).alias("fields"), "event_id", "gpu_index", "util_percent"
        )
        for n in (3, 5, 8)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "scan_dmon",
    "S9",
    sql="""SELECT CAST(event_id % 4 AS INT) AS gpu, count(*) AS samples, sum(floor(value)) AS sm_util, count(*) FILTER (event_id % 2 = 0) AS with_power
FROM events WHERE event_id % 10 <> 0 GROUP BY 1""",
)
def scan_dmon(t):
    path = fresh_path(t.spark, "dmon")
    i = F.col("event_id")
    line = F.when(i % 10 == 0, F.lit("#Date       Time        gpu    pwr  gtemp  mtemp     sm    mem    enc    dec")).otherwise(
        F.concat_ws(
            "   ", F.lit(" 20240101"), F.lit("10:00:00"), (i % 4).cast("string"),
            F.when(i % 2 == 0, "50").otherwise("-"), F.lit("60"), F.lit("-"),
            F.floor("value").cast("string"), F.lit("5"), F.lit("0"), F.lit("0"),
        )
    )
    t.events.select(line.alias("line")).write.text(path)
    rows = delimited.parse_dmon(text_files.read_lines(t.spark, path))
    return rows.groupBy("gpu").agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum("sm_util").alias("sm_util"),
        F.count("power_w").alias("with_power"),
    )


@query(
    "discovered_runs",
    "S14",
    "S10",
    sql="""SELECT l_returnflag AS benchmark, CASE l_returnflag WHEN 'A' THEN 500 WHEN 'N' THEN 1000 ELSE 1500 END AS num_agents,
  count(DISTINCT l_partkey % 10) AS events
FROM lineitem WHERE l_linenumber IN (1, 2, 5) OR (l_linenumber = 3 AND l_returnflag <> 'A') GROUP BY 1, 2""",
)
def discovered_runs(t):
    root, flag = fresh_path(t.spark, "sweep"), F.col("l_returnflag")
    agents = F.when(flag == "A", 500).when(flag == "N", 1000).otherwise(1500)
    lines = perf_lines(t, flag.alias("benchmark"), agents.alias("num_agents"))
    sinks.write_text(lines, root, "line", ["benchmark", "num_agents"])
    found = text_files.read_run_lines(t.spark, root)
    counters = pf.perf_counters(found, ["benchmark", "num_agents"])
    return counters.groupBy("benchmark", "num_agents").agg(F.count(F.lit(1)).alias("events"))


@query(
    "appended_snapshots",
    "K1",
    "S1",
    sql=with_(SNAPSHOTS)
    + "SELECT tag, count(*) AS snapshots, max(ts) AS last_ts, sum(gpu_vram_used_gb) AS used FROM snapshots GROUP BY 1",
)
def appended_snapshots(t):
    path = fresh_path(t.spark, "appended")
    rows = snapshots(t).drop("run_id")
    sinks.append_jsonl(rows.where(F.col("ordinal") % 2 == 0), path)
    sinks.append_jsonl(rows.where(F.col("ordinal") % 2 == 1), path)
    back = json_files.read_jsonl_strict(t.spark, path, schemas.MEM_SNAPSHOT)
    return back.groupBy("tag").agg(
        F.count(F.lit(1)).alias("snapshots"),
        F.max("ts").alias("last_ts"),
        F.sum("gpu_vram_used_gb").alias("used"),
    )


@query(
    "latency_csv",
    "K5",
    sql="""SELECT printf('%.6f', l_quantity / 7) AS latency_s, count(*) AS rows FROM lineitem GROUP BY 1""",
)
def latency_csv(t):
    path = fresh_path(t.spark, "latencies")
    sinks.write_latency_csv(t.lineitem.select((F.col("l_quantity") / 7).alias("latency_s")), path)
    back = delimited.read_header_csv(t.spark, path)
    return back.groupBy("latency_s").agg(F.count(F.lit(1)).alias("rows"))


@query("report_files", "K6", sql=REPORT_SQL)
def report_files(t):
    path = fresh_path(t.spark, "reports")
    reports = compare.report_text(compare.comparison_table(phases(t)))
    tagged = reports.withColumn("run", F.translate("run_id", " ", "_"))
    sinks.write_text(tagged, path, "report", ["run"])
    back = t.spark.read.text(path, wholetext=True)
    # The writer ends each file with one more line break.
    return back.select(
        F.translate("run", "_", " ").alias("run_id"), F.regexp_replace("value", r"\n\z", "").alias("report")
    )


@query(
    "trace_log_round_trip",
    "R2",
    "K1",
    sql=with_(TRACE)
    + """SELECT stage, count(*) AS events, coalesce(sum(latency_s), 0) AS latency_s, count(*) FILTER (success) AS successes
FROM trace GROUP BY 1""",
)
def trace_log_round_trip(t):
    path = fresh_path(t.spark, "trace")
    sinks.append_jsonl(trace_events(t).withColumn("task_id", F.col("task_id").cast("string")), path)
    back = json_files.read_trace_events(t.spark, path)
    return back.groupBy("stage").agg(
        F.count(F.lit(1)).alias("events"),
        F.coalesce(F.sum("payload.latency_s"), F.lit(0.0)).alias("latency_s"),
        F.count_if(F.coalesce("payload.success", F.lit(False))).alias("successes"),
    )


@query(
    "comparison_documents",
    "K4",
    "J6",
    sql=with_(PHASES)
    + """SELECT run_id, max(avg_latency_s) FILTER (phase = 'before') AS before_latency_s,
  max(avg_latency_s) FILTER (phase = 'after') AS after_latency_s,
  max(successes) FILTER (phase = 'before') AS before_successes,
  max(successes) FILTER (phase = 'after') AS after_successes
FROM phases GROUP BY 1""",
)
def comparison_documents(t):
    path = fresh_path(t.spark, "comparisons")
    sinks.write_documents(sinks.comparison_documents(phases(t), order=["avg_latency_s"]), path)
    metrics = schemas.row(avg_latency_s=schemas.D, successes=schemas.D)
    kind = schemas.row(run_id=schemas.S, before=metrics, after=metrics, timestamp=schemas.D)
    back = json_files.read_jsonl_strict(t.spark, path, kind)
    return back.where(F.col("timestamp").isNotNull()).select(
        "run_id",
        F.col("before.avg_latency_s").alias("before_latency_s"),
        F.col("after.avg_latency_s").alias("after_latency_s"),
        F.col("before.successes").alias("before_successes"),
        F.col("after.successes").alias("after_successes"),
    )
