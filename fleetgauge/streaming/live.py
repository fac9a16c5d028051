"""Live views over files that keep coming: the batch aggregates under Structured Streaming.

There are two kinds. The ``live_`` functions are watermarked views that take and return streaming frames
(they also accept batch frames); a window is final when the watermark has passed it, and rows that come
later are lost to it. ``folded`` keeps mergeable partial results instead: it takes rows of any age and
shows open windows and sessions too. Sinks write tables in the shared folder, never the driver's memory.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.fixed_values import CAPACITY_THRESHOLD
from fleetgauge.operators.telemetry import capacity_columns, gpu_mean, gpu_peak, summary_columns
from fleetgauge.operators.trace import outcome_columns, outcome_fields
from fleetgauge.sources.scratch import fresh_path
from fleetgauge.streaming.leveled import Fold, LeveledTable, SessionTable

LATENESS = "30 seconds"
WINDOW = "10 seconds"
SESSION_GAP = "10 minutes"


def stream_jsonl(
    spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 1000
) -> DataFrame:
    """Telemetry or trace files of a folder, as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def stream_table(
    spark: SparkSession, folder: str, file_glob: str, schema: T.StructType, files_per_trigger: int = 1000
) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", file_glob)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )


def live_run_summary(
    samples: DataFrame,
    ts: str = "ts",
    run: str = "run_id",
    window: str = WINDOW,
    lateness: str = LATENESS,
) -> DataFrame:
    """The run summary per run and time window."""
    grouped = samples.withWatermark(ts, lateness).groupBy(run, F.window(ts, window).alias("w"))
    return _flat_window(grouped.agg(*summary_columns()), run)


def live_capacity(
    devices: DataFrame,
    ts: str = "ts",
    run: str = "run_id",
    window: str = WINDOW,
    lateness: str = LATENESS,
    threshold: float = CAPACITY_THRESHOLD,
) -> DataFrame:
    """Per run and window: is any device below the threshold?"""
    grouped = devices.withWatermark(ts, lateness).groupBy(run, F.window(ts, window).alias("w"))
    return _flat_window(grouped.agg(*capacity_columns(threshold)), run)


def _flat_window(df: DataFrame, run: str) -> DataFrame:
    rest = [c for c in df.columns if c not in (run, "w")]
    return df.select(
        run, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *rest
    )


def live_latest(
    samples: DataFrame, keys: Sequence[str], values: Sequence[str], ts: str = "ts"
) -> DataFrame:
    """Latest values per device, refreshed with every trigger (update mode)."""
    newest = F.max(F.struct(ts, *values)).alias("v")  # rows of one time have an order too
    return samples.groupBy(*keys).agg(newest).select(*keys, "v.*")


def live_task_outcomes(
    events: DataFrame,
    ts: str = "ts",
    keys: Sequence[str] = ("run_id", "task_id"),
    gap: str = SESSION_GAP,
    lateness: str = LATENESS,
) -> DataFrame:
    """Trace outcomes of tasks that have gone quiet for ``gap`` (an abandoned task closes too)."""
    grouped = events.withWatermark(ts, lateness).groupBy(
        *keys, F.session_window(ts, gap).alias("w")
    )
    return grouped.agg(*outcome_columns(ts)).select(
        *keys,
        F.col("w.start").alias("session_start"),
        F.col("w.end").alias("session_end"),
        *outcome_fields(),
    )


def live_progress(results: DataFrame, keys: Sequence[str] = ("run_id",), every: int = 10) -> DataFrame:
    """Finished tasks so far and the last full tick of ``every`` tasks."""
    done = results.groupBy(*keys).agg(F.count(F.lit(1)).alias("tasks_done"))
    return done.withColumn("tick", (F.floor(F.col("tasks_done") / every) * every).cast("bigint"))


def run_to_table(
    stream: DataFrame,
    mode: str,
    path: str | None = None,
    checkpoint: str | None = None,
    trigger: dict | None = None,
):
    """Starts ``stream`` into a parquet table in the shared folder; returns (query, path).

    Every batch is a folder named after it and rewritten on retry, so a batch that runs twice
    leaves one copy. Batches without rows leave no folder, but for the first.
    """
    spark = stream.sparkSession
    path = path or fresh_path(spark, "live")
    checkpoint = checkpoint or fresh_path(spark, "live-state")

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch_id and batch.isEmpty():
            return
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "2 seconds"}))
        .foreachBatch(write)
        .start()
    )
    return query, path


def late_rows(query) -> int:
    """Rows that came after their window was closed and are in no result, in the last batches."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


def drained(stream: DataFrame, mode: str, keys: Sequence[str]) -> DataFrame:
    """Runs a watermarked view over what is there now and returns its table, newest row per key.

    Rows that came too late for their window are an error rather than a silent loss. ``folded`` takes
    them, and sessions that are still open.
    """
    query, path = run_to_table(stream, mode, trigger={"availableNow": True})
    query.awaitTermination()
    if late := late_rows(query):
        raise RuntimeError(f"{late} rows came too late for their window")
    return current_state(stream.sparkSession, path, stream.schema, keys)


def current_state(
    spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]
) -> DataFrame:
    """Last written row per key of an update-mode table."""
    full = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    rows = spark.read.schema(full).parquet(path)
    others = [f.name for f in schema.fields if f.name not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*others), F.col("batch_id")).alias("v"))
        .select(*keys, "v.*")
    )


def _sums(*names: str) -> list[Column]:
    return [F.sum(n).alias(n) for n in names]


def _peaks(*names: str) -> list[Column]:
    return [F.max(n).alias(n) for n in names]


def _mean(total: str, count: str) -> Column:
    return F.when(F.col(count) > 0, F.col(total) / F.col(count))


def summary_fold() -> Fold:
    """The run summary (``summary_columns``) in mergeable parts."""
    cpu, mem = F.coalesce("cpu_percent", F.lit(0.0)), F.coalesce("mem_percent", F.lit(0.0))
    mean, peak = gpu_mean(F.col("gpu")), gpu_peak(F.col("gpu"))
    return Fold(
        rows=[
            F.count(F.lit(1)).alias("samples"),
            F.sum(cpu).alias("cpu_sum"),
            F.greatest(F.max(cpu), F.lit(0.0)).alias("cpu_percent_max"),
            F.sum(mem).alias("mem_sum"),
            F.greatest(F.max(mem), F.lit(0.0)).alias("mem_percent_max"),
            F.sum(mean).alias("gpu_sum"),
            F.count(mean).alias("gpu_samples"),
            F.when(F.max(peak).isNotNull(), F.greatest(F.max(peak), F.lit(0.0))).alias("gpu_util_percent_max"),
        ],
        partials=[
            *_sums("samples", "cpu_sum", "mem_sum", "gpu_sum", "gpu_samples"),
            *_peaks("cpu_percent_max", "mem_percent_max", "gpu_util_percent_max"),
        ],
        shown=[
            F.col("samples"),
            _mean("cpu_sum", "samples").alias("cpu_percent_avg"),
            F.col("cpu_percent_max"),
            _mean("mem_sum", "samples").alias("mem_percent_avg"),
            F.col("mem_percent_max"),
            _mean("gpu_sum", "gpu_samples").alias("gpu_util_percent_avg"),
            F.col("gpu_util_percent_max"),
        ],
    )


def capacity_fold(threshold: float = CAPACITY_THRESHOLD) -> Fold:
    return Fold(capacity_columns(threshold), [F.bool_or("available").alias("available")], [F.col("available")])


def latest_fold(values: Sequence[str], ts: str = "ts") -> Fold:
    return Fold([F.max(F.struct(ts, *values)).alias("v")], _peaks("v"), [F.col("v.*")])


def progress_fold(every: int = 10) -> Fold:
    done = F.col("tasks_done")
    tick = (F.floor(done / every) * every).cast("bigint").alias("tick")
    return Fold([F.count(F.lit(1)).alias("tasks_done")], _sums("tasks_done"), [done, tick])


def outcome_fold(ts: str = "ts") -> Fold:
    """Trace outcomes (``outcome_columns``) in mergeable parts."""
    stage, p, at = F.col("stage"), F.col("payload"), F.col(ts)
    acted, reflected = (stage == "action") & at.isNotNull(), stage == "reflection"
    tried = reflected & (p["attempt"] > 0)
    parts = [p["success"].alias("success"), p["latency_s"].alias("latency_s"), p["completion_preview"].alias("preview")]
    first = outcome_columns(ts)[2:]
    return Fold(
        rows=[
            F.max(F.when(acted, F.struct(at.alias("at"), *parts))).alias("action"),
            F.max(F.when(tried, F.struct(p["attempt"].alias("attempt"), at.alias("at"), *parts))).alias("last_reflection"),
            *first,
        ],
        partials=[
            *_peaks("action", "last_reflection"),
            *_sums("reflection_latency_s", "reflection_attempts", "disabled", "events"),
        ],
        shown=outcome_fields(),
    )


def _windowed(rows: DataFrame, keys: Sequence[str], fold: Fold, ts: str, window: str | None, gap: str | None) -> DataFrame:
    if not (window or gap):
        return rows.groupBy(*keys).agg(*fold.rows)
    names = ("window_start", "window_end") if window else ("session_start", "session_end")
    group = F.window(ts, window) if window else F.session_window(ts, gap)
    found = rows.groupBy(*keys, group.alias("w")).agg(*fold.rows)
    rest = [c for c in found.columns if c not in (*keys, "w")]
    return found.select(*keys, F.col("w.start").alias(names[0]), F.col("w.end").alias(names[1]), *rest)


def folded(
    stream: DataFrame,
    keys: Sequence[str],
    fold: Fold,
    ts: str = "ts",
    window: str | None = None,
    gap: str | None = None,
    path: str | None = None,
    checkpoint: str | None = None,
    trigger: dict | None = None,
    fanout: int = 8,
):
    """Starts a live view without a watermark; returns (query, table), and ``table.read()`` is the view.

    Rows are grouped by key, and by time windows or by sessions where ``window`` or ``gap`` is given. Late
    rows count, sessions that are still open are there, and a session that late rows join to another
    becomes one with it.
    """
    spark = stream.sparkSession
    path = path or fresh_path(spark, "live")
    empty = spark.createDataFrame([], stream.schema)
    own = [*keys]
    own += ["window_start", "window_end"] if window else ["session_start", "session_end"] if gap else []
    schema = _windowed(empty, keys, fold, ts, window, gap).schema
    table = (SessionTable if gap else LeveledTable)(spark, path, own, fold, schema, fanout)

    def take(batch: DataFrame, batch_id: int) -> None:
        table.add(_windowed(batch, keys, fold, ts, window, gap), batch_id)

    query = (
        stream.writeStream.option("checkpointLocation", checkpoint or fresh_path(spark, "live-state"))
        .trigger(**(trigger or {"processingTime": "2 seconds"}))
        .foreachBatch(take)
        .start()
    )
    return query, table


def append_stream(
    stream: DataFrame, path: str, checkpoint: str, form: str = "json", by: Sequence[str] = (), trigger: dict | None = None
):
    """Starts an append-only file sink and returns its query.

    The sink's log in ``path`` lists the files of each finished batch. Readers of the folder take those
    only, so a query that is killed and started again with its checkpoint leaves each row once.
    """
    writer = stream.writeStream.format(form).outputMode("append").option("checkpointLocation", checkpoint)
    if by:
        writer = writer.partitionBy(*by)
    return writer.trigger(**(trigger or {"processingTime": "2 seconds"})).start(path)
