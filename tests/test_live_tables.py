"""Live views equal their batch results: late rows, open sessions, restarts, many batches."""

import pytest
from pyspark.sql import functions as F

from fleetgauge.catalog.live import StreamingTables
from fleetgauge.operators import trace
from fleetgauge.sources.scratch import fresh_path
from fleetgauge.streaming import live
from fleetgauge.streaming.leveled import LeveledTable
from tests.test_operators import TRACE_DDL, event, trace_rows

SAMPLES = "run_id string, s double, cpu_percent double, mem_percent double, gpu array<struct<gpu_index:int,util_percent:double>>"


def in_files(spark, parts):
    """A folder with one file a part, in order."""
    path = fresh_path(spark, "parts")
    for part in parts:
        part.coalesce(1).write.mode("append").json(path)
    return path


def drained(spark, path, schema, keys, fold, prepare, **options):
    stream = prepare(live.stream_jsonl(spark, path, schema, files_per_trigger=1))
    query, table = live.folded(stream, keys, fold, trigger={"availableNow": True}, **options)
    query.awaitTermination()
    return table


def same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.fixture(scope="module")
def samples(spark):
    data = [
        ("r" if t % 3 else None, float(t), float(t % 7) if t % 11 else None, None, [(0, float(t % 5)), (1, None)] if t % 4 else [])
        for t in range(3000)
    ]
    return spark.createDataFrame(data, SAMPLES)


def timed(df):
    return df.withColumn("ts", F.timestamp_seconds("s"))


def test_late_samples_count(spark, samples):
    # The second file is an hour older than the first, and every file holds rows of every window of its own.
    parts = [samples.where("s >= 2000"), samples.where("s < 1000"), samples.where("s >= 1000 and s < 2000")]
    path = in_files(spark, parts)
    got = drained(spark, path, samples.schema, ["run_id"], live.summary_fold(), timed, window="1 minute", fanout=2).read()
    want = live.live_run_summary(timed(samples), window="1 minute")
    rounded = lambda df: df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    assert want.count() == 100 and same(rounded(got), rounded(want))
    strict = live.live_run_summary(timed(live.stream_jsonl(spark, path, samples.schema, files_per_trigger=1)), window="1 minute")
    with pytest.raises(RuntimeError, match="too late"):
        live.drained(strict, "update", ["run_id", "window_start"])


def test_latest_capacity_and_progress(spark, samples):
    rows = samples.select("run_id", "s", "cpu_percent", F.lit(100.0).alias("total"), F.col("s").alias("used"))
    path = in_files(spark, [rows.where("s % 3 = 1"), rows.where("s % 3 = 2"), rows.where("s % 3 = 0")])
    newest = drained(spark, path, rows.schema, ["run_id"], live.latest_fold(["cpu_percent"]), timed).read()
    assert same(newest, live.live_latest(timed(rows), ["run_id"], ["cpu_percent"]))
    gates = drained(spark, path, rows.schema, ["run_id"], live.capacity_fold(0.5), timed, window="20 seconds").read()
    assert same(gates, live.live_capacity(timed(rows), window="20 seconds", threshold=0.5))
    done = drained(spark, path, rows.schema, ["run_id"], live.progress_fold(7), lambda df: df).read()
    assert same(done, live.live_progress(rows, every=7))


def test_sessions_open_late_and_joined(spark):
    rows = trace_rows() + [
        event(0.0, "long", "reasoning"),
        event(1000.0, "long", "action", success=True, latency_s=2.0, completion_preview="late"),
        event(500.0, "long", "reflection", attempt=1, latency_s=1.0),
        event(5000.0, "long", "reasoning"),
    ]
    df = spark.createDataFrame(rows, TRACE_DDL)
    at = lambda d: d.withColumn("ts", F.timestamp_micros((F.col("timestamp") * 1000000).cast("bigint")))
    # The event at 500 s comes last and joins two sessions that lie more than ten minutes apart.
    parts = [df.where("timestamp in (0, 5000)"), df.where("timestamp not in (0, 5000, 500)"), df.where("timestamp = 500")]
    table = drained(
        spark, in_files(spark, parts), df.schema, ["run_id", "task_id"], live.outcome_fold(), at, gap="10 minutes", fanout=2
    )
    got = table.read()
    want = live.live_task_outcomes(at(df))
    assert same(got, want)
    long = got.where("task_id = 'long'").orderBy("session_start").collect()
    assert [(r.events, r.outcome) for r in long] == [(3, "first_attempt"), (1, "incomplete")]
    whole = trace.task_outcomes(df.where("task_id <> 'long'"))
    assert same(got.where("task_id <> 'long'").drop("session_start", "session_end"), whole)


def test_many_batches_lose_nothing_and_stay_few(spark):
    fold = live.progress_fold()
    schema = spark.createDataFrame([], "run_id string, tasks_done long").schema
    table = LeveledTable(spark, fresh_path(spark, "t"), ["run_id"], fold, schema, fanout=2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for k in range(40):
            batch = spark.createDataFrame([("r", 1), (f"q{k % 5}", k)] if k % 10 else [], schema).coalesce(1)
            table.add(batch, k)
            if k % 15 == 0:  # a batch that is run again after a restart
                table = LeveledTable(spark, table.path, ["run_id"], fold, schema, fanout=2)
                table.add(batch, k)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = {r.run_id: r.tasks_done for r in table.read().collect()}
    assert got.pop("r") == 36
    assert sum(got.values()) == sum(k for k in range(40) if k % 10)
    assert len(table.runs()) <= 6


def test_a_list_that_was_cut_off_is_passed_over(spark):
    schema = spark.createDataFrame([], "run_id string, tasks_done long").schema
    table = LeveledTable(spark, fresh_path(spark, "t"), ["run_id"], live.progress_fold(), schema)
    one = spark.createDataFrame([("r", 1)], schema)
    for k in range(3):
        table.add(one, k)
    spark.createDataFrame([], "x string").write.mode("overwrite").text(f"{table.path}/head=1")
    assert table.read().first().tasks_done == 3
    spark.createDataFrame([], "x string").write.mode("overwrite").text(f"{table.path}/head=0")
    table = LeveledTable(spark, fresh_path(spark, "t"), ["run_id"], live.progress_fold(), schema)
    assert table.read().isEmpty()


def test_append_sink_survives_a_kill(spark):
    rows = spark.createDataFrame([(k, f"v{k}") for k in range(30)], "n long, v string")
    path = in_files(spark, [rows.where(f"n % 3 = {k}") for k in range(3)])
    out, state = fresh_path(spark, "sink"), fresh_path(spark, "state")
    for broken in (True, False, False):
        stream = live.stream_jsonl(spark, path, rows.schema, files_per_trigger=1)
        if broken:
            stream = stream.withColumn("v", F.when(F.col("n") == 28, F.raise_error(F.lit("killed"))).otherwise(F.col("v")))
        query = live.append_stream(stream, out, state, by=["n"], trigger={"availableNow": True})
        if broken:
            with pytest.raises(Exception, match="killed"):
                query.awaitTermination()
            left = spark.read.schema(rows.schema).json(out).count()
            assert left in (10, 20)
        else:
            query.awaitTermination()
    assert same(spark.read.schema(rows.schema).json(out), rows)


def test_streams_of_tables_have_files_by_their_size(spark, tmp_path):
    spark.range(0, 900, 1, 4).write.parquet(f"{tmp_path}/things.parquet")
    stream = StreamingTables(spark, str(tmp_path)).things
    query, path = live.run_to_table(
        stream.select("id", F.input_file_name().alias("file")), "append", trigger={"availableNow": True}
    )
    query.awaitTermination()
    rows = spark.read.parquet(path)
    assert sorted(r.id for r in rows.collect()) == list(range(900))
    assert rows.select("batch_id").distinct().count() == 3
    assert rows.select("file").distinct().count() == 12
