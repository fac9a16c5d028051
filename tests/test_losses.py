"""Rows and values that once went missing or came out wrong."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge import schemas
from fleetgauge.functions import numbers
from fleetgauge.operators import evaluation as ev
from fleetgauge.operators import grid, telemetry
from fleetgauge.plans.evaluation_run import agent_evaluation
from fleetgauge.sources import json_files, scratch
from fleetgauge.streaming import live

TRIES = "agent_id long, task_id long, attempt long, completion string, latency_s double, ok boolean, passed boolean, is_reflection boolean"


def test_failed_item_has_the_last_ordinary_latency(spark):
    tries = [(1, 1, k, "x", s, False, False, r) for k, s, r in ((1, 5.0, False), (2, 7.0, False), (3, 9.0, False), (4, 1.0, True))]
    df = spark.createDataFrame(tries, TRIES)
    assert ev.first_success(df).first().latency_s == 9.0
    assert agent_evaluation(df).first().avg_latency_s == 9.0


def test_runs_with_equal_agents_stay_apart(spark):
    tries = [(1, 1, 1, "x", 2.0, True, True, False), (1, 1, 1, "x", 4.0, True, False, False)]
    df = spark.createDataFrame(tries, TRIES).withColumn("run_id", F.col("latency_s").cast("int"))
    got = {r.run_id: (r.total_tasks, r.avg_latency_s) for r in agent_evaluation(df, run=["run_id"]).collect()}
    assert got == {2: (1, 2.0), 4: (1, 4.0)}


def test_open_intervals_count(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 9.0), ("a", 2.0, None), ("a", 3.0, None), ("a", None, 4.0)], "k string, start_s double, end_s double"
    )
    r = ev.peak_concurrency(df, ["k"]).first()
    assert (r.max_concurrent, r.started) == (3, 3)


def test_large_numbers_print(spark):
    values = [1e14, 9.3e12 + 1 / 512, -9.2e15, 123456789012.5, 1e22]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    got = [tuple(r) for r in df.select("x", numbers.fixed_point(F.col("x"), 6), numbers.fixed_point(F.col("x"), 3)).collect()]
    assert got == [(x, f"{x:.6f}", f"{x:.3f}") for x in values]


def test_devices_beyond_the_slots_are_an_error(spark):
    kind = schemas.row(run_id=schemas.S, gpu_info=schemas.RESOURCE_SAMPLE["gpu_info"].dataType)
    device = (0, "g", None, 10.0, None, 100.0, 10.0, None)
    two = spark.createDataFrame([("r", [device, device])], kind)
    assert telemetry.gpu_wide(two, 2).first().gpu_count == 2
    with pytest.raises(Exception, match="2 devices for 1 slots"):
        telemetry.gpu_wide(two, 1).collect()


def test_rows_without_a_run_keep_their_time(spark):
    df = spark.createDataFrame([(None, 5.0), (None, 8.0), ("a", 1.0)], "run_id string, ts double")
    got = sorted((str(r.run_id), r.elapsed_s) for r in telemetry.with_elapsed(df, ["run_id"]).collect())
    assert got == [("None", 0.0), ("None", 3.0), ("a", 0.0)]


def test_lines_that_begin_with_a_tab_are_rows(spark):
    lines = spark.createDataFrame([('\t{"a": 1}',), ("\t",), ('{"a": 2}\x1f',), ("[1]",)], "line string")
    schema = T.StructType([T.StructField("a", T.LongType())])
    got = json_files.parse_jsonl(lines, schema).collect()
    assert sorted((r.a or 0, r._corrupt_record) for r in got) == [(0, "[1]"), (1, None), (2, None)]


def test_agents_are_generated_beside_tasks(spark):
    tasks = spark.range(7).withColumnRenamed("id", "task_idx")
    items = grid.work_items(tasks, 25_001, devices=4)
    assert "Exchange" not in items._jdf.queryExecution().toString()
    assert items.agg(F.count_distinct("work_index"), F.max("work_index")).first() == (7 * 25_001, 7 * 25_001 - 1)
    assert grid.work_items(tasks, 0).count() == 0


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Cluster:
        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError):
        scratch.shared_folder(Cluster)


def test_late_rows_are_not_lost_silently(spark, tmp_path):
    schema = "run_id long, task_id long, ts timestamp, stage string"
    made = set()
    for k, second in enumerate((100_000, 100_001, 5)):  # a watermark holds from the batch after next
        rows = spark.createDataFrame([(1, k, second)], "run_id long, task_id long, s long")
        rows = rows.select("run_id", "task_id", F.timestamp_seconds("s").alias("ts"), F.lit("x").alias("stage"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for new in (tmp_path / "in").glob("part-*"):
            if new not in made:
                os.utime(new, (1000 + k, 1000 + k))
                made.add(new)

    def view(df):
        grouped = df.withWatermark("ts", "1 second").groupBy("run_id", F.window("ts", "10 seconds").alias("w"))
        return grouped.agg(F.count(F.lit(1)).alias("n")).select("run_id", F.col("w.start").alias("start"), "n")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with pytest.raises(RuntimeError, match="too late"):
        live.drained(view(stream), "append", ["run_id", "start"])
    query, table = live.folded(
        stream, ["run_id"], live.progress_fold(), window="10 seconds", trigger={"availableNow": True}
    )
    query.awaitTermination()
    assert sorted(r.tasks_done for r in table.read().collect()) == [1, 2]


def test_queries_are_listed_without_a_session():
    said = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"],
        capture_output=True,
        text=True,
        cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
        timeout=120,
    )
    assert said.returncode == 0, said.stderr[-500:]
    known, with_sql = map(int, said.stdout.split())
    assert known >= with_sql > 100
