"""Streaming queries, drained over what the given tables hold now."""

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import functions as F

from fleetgauge.catalog.adapters import (
    SAMPLES,
    SNAPSHOTS,
    TRACE,
    epoch_micros,
    samples,
    snapshots,
    trace_events,
    with_,
)
from fleetgauge.catalog.registry import Tables, query
from fleetgauge.catalog.telemetry import SUMMARY
from fleetgauge.catalog.traces import OUTCOMES
from fleetgauge.sources import growing
from fleetgauge.sources.scratch import fresh_path
from fleetgauge.streaming import live


class StreamingTables(Tables):
    """Each table as a stream of three batches, with rows of all times in each; files follow the table's size."""

    def __getattr__(self, name):
        table = super().__getattr__(name)
        path = fresh_path(self.spark, f"files-{name}")
        files = table.rdd.getNumPartitions()  # of each batch: no task reads more than a third of a split
        table.repartition(3 * files).write.parquet(path)
        return live.stream_table(self.spark, path, "*.parquet", table.schema, files_per_trigger=files)


def _streams(t):
    return StreamingTables(t.spark, t.folder)


def _at(seconds):
    return F.timestamp_micros((seconds * 1000000).cast("bigint"))


def _view(stream, keys, fold, **options):
    """The folded view of all that is there now."""
    running, table = live.folded(stream, keys, fold, trigger={"availableNow": True}, **options)
    running.awaitTermination()
    return table.read()


def _log(rows, folder):
    """Appends rows as the loggers of a fleet do: each to a file of its own that it goes on with."""

    def write(part):
        files, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        files.create_dir(path, recursive=True)
        with files.open_append_stream(f"{path}/logger_{TaskContext.get().partitionId()}.jsonl") as f:
            for row in part:
                f.write((row.line + "\n").encode())

    rows.select(F.to_json(F.struct(*rows.columns)).alias("line")).foreachPartition(write)


@query(
    "live_samples", "X1", "K1", "S2", sql=with_(SAMPLES) + "SELECT event_id, run_id, mem_percent FROM samples"
)
def live_samples(t):
    """Samples logged in two sittings to the same files, followed and appended to a table in between."""
    rows = samples(t).select("event_id", "run_id", "mem_percent")
    logs, ranges, state, out = (fresh_path(t.spark, x) for x in ("logs", "ranges", "live-state", "live"))
    for sitting in (0, 1):
        _log(rows.where(F.pmod("event_id", F.lit(2)) == sitting), logs)
        lines = growing.follow_jsonl(t.spark, logs, ranges, rows.schema, glob="*.jsonl").select(*rows.columns)
        live.append_stream(lines, out, state, "parquet", trigger={"availableNow": True}).awaitTermination()
    return t.spark.read.schema(rows.schema).parquet(out)


@query(
    "live_latest_values",
    "X2",
    sql=with_(SNAPSHOTS)
    + """SELECT run_id, gpu_id, max(ts) AS ts, arg_max(gpu_vram_used_gb, ts) AS gpu_vram_used_gb, arg_max(tag, ts) AS tag
FROM snapshots GROUP BY 1, 2""",
)
def live_latest_values(t):
    newest = live.latest_fold(["gpu_vram_used_gb", "tag"])
    return _view(snapshots(_streams(t)), ["run_id", "gpu_id"], newest)


@query(
    "live_run_summary",
    "X3",
    "X1",
    sql=with_(SAMPLES)
    + f"SELECT run_id, CAST(floor(ts / 3600) * 3600 AS BIGINT) AS window_start_s, {SUMMARY} FROM samples GROUP BY 1, 2",
)
def live_run_summary(t):
    rows = samples(_streams(t))
    rows = rows.withColumn("ts", _at(F.col("ts")))
    state = _view(rows, ["run_id"], live.summary_fold(), window="1 hour")
    return state.withColumns(
        {
            "window_start_s": F.unix_seconds("window_start"),
            "gpu_util_percent_avg": F.round("gpu_util_percent_avg", 9),
        }
    ).drop("window_start", "window_end")


@query(
    "live_task_outcomes",
    "X4",
    sql=with_(TRACE, OUTCOMES) + "SELECT * FROM outcomes",
)
def live_task_outcomes(t):
    rows = trace_events(_streams(t)).withColumn("ts", _at(F.col("timestamp")))
    state = _view(rows, ["run_id", "task_id"], live.outcome_fold(), gap=live.SESSION_GAP)
    return state.drop("session_start", "session_end")


@query(
    "live_capacity",
    "X5",
    sql="""SELECT event_type AS run_id, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS window_start_s,
  bool_or(floor(value) / 500 < 0.1) AS available FROM events GROUP BY 1, 2""",
)
def live_capacity(t):
    devices = _streams(t).events.select(
        F.col("event_type").alias("run_id"),
        F.timestamp_micros(epoch_micros("ts")).alias("ts"),
        F.floor("value").cast("double").alias("used"),
        F.lit(500.0).alias("total"),
    )
    state = _view(devices, ["run_id"], live.capacity_fold(0.1), window="1 hour")
    return state.select(
        "run_id", F.unix_seconds("window_start").alias("window_start_s"), "available"
    )


@query(
    "live_progress",
    "X6",
    "A19",
    sql="SELECT l_suppkey AS run_id, count(*) AS tasks_done, count(*) // 10 * 10 AS tick FROM lineitem GROUP BY 1",
)
def live_progress(t):
    rows = _streams(t).lineitem.select(F.col("l_suppkey").alias("run_id"))
    return _view(rows, ["run_id"], live.progress_fold())
