import json
import os

import pytest
from pyspark.sql import functions as F

from fleetgauge import schemas
from fleetgauge.operators import telemetry, trace
from fleetgauge.sources import delimited, json_files, sinks, text_files
from fleetgauge.sources.scratch import fresh_path, shared_folder
from fleetgauge.streaming import live
from tests.test_operators import TRACE_DDL, event, trace_rows


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return str(path)


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert fresh_path(spark, "x") != fresh_path(spark, "x")


def test_strict_and_lenient_jsonl(spark, tmp_path):
    good = write(f"{tmp_path}/good.jsonl", '{"tag": "a", "ts": 1.5}\n\n{"tag": "b", "gpu_id": 3}\n')
    assert json_files.read_jsonl_strict(spark, good, schemas.MEM_SNAPSHOT).count() == 2
    bad = write(f"{tmp_path}/bad.jsonl", '{"tag": "a"}\n{"tag": \n\n5\n[1]\n"s"\n{"tag": "b", "ts": 2}\n')
    with pytest.raises(Exception):
        json_files.read_jsonl_strict(spark, bad, schemas.MEM_SNAPSHOT).collect()
    lenient = json_files.read_jsonl_lenient(spark, [bad, f"{tmp_path}/none.jsonl"], schemas.MEM_SNAPSHOT)
    assert sorted((r.tag, r.ts) for r in lenient.collect()) == [("a", None), ("b", 2.0)]
    assert lenient.count() == 2
    assert json_files.read_jsonl_lenient(spark, f"{tmp_path}/none.jsonl", schemas.MEM_SNAPSHOT).count() == 0
    assert json_files.read_jsonl_marked(spark, bad, schemas.MEM_SNAPSHOT).where("_corrupt_record is not null").count() == 4


def test_documents(spark, tmp_path):
    score = write(f"{tmp_path}/score.json", json.dumps({"pass@1": 0.25, "total": 8, "num_agents": 2, "avg_latency_s": 1.5}, indent=2))
    r = json_files.read_scores(spark, score).first()
    assert (r["pass@1"], r.total, r.avg_throughput_rps) == (0.25, 8, 0.0)
    doc = {"num_agents": 2, "num_tasks": 5, "total_evaluations": 10, "agents": [{"agent_id": 0, "successes": 3, "pass@1": 0.5}, {"agent_id": 1}]}
    path = write(f"{tmp_path}/agent_summary.json", json.dumps(doc, indent=2))
    write(f"{tmp_path}/empty.json", json.dumps({"num_agents": 0, "agents": []}))
    got = json_files.read_agent_summaries(spark, [path, f"{tmp_path}/empty.json"]).orderBy("agent_id").collect()
    assert [(r.agent_id, r.successes, r["pass@1"]) for r in got] == [(0, 3, 0.5), (1, None, None)]


def test_completions_and_discovery(spark, tmp_path):
    write(f"{tmp_path}/suite/agents_50/agent_7_results.jsonl", '{"task_id": "t", "completion": "x"}\n')
    got = json_files.read_completions(spark, str(tmp_path)).collect()
    assert [(r.agent_id, r.task_id) for r in got] == [(7, "t")]
    write(f"{tmp_path}/suite/agents_50/results_before.json", "{}\n")
    runs = {r.source_file.split("/")[-1]: r for r in text_files.with_run(text_files.read_lines(spark, str(tmp_path))).collect()}
    r = runs["agent_7_results.jsonl"]
    assert (r.benchmark, r.num_agents, r.agent_id, r.phase) == ("suite", 50, 7, None)
    assert runs["results_before.json"].phase == "before"


def test_line_order_survives_splits(spark, tmp_path):
    path = write(f"{tmp_path}/big.txt", "".join(f"line {i}\n" for i in range(20000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        read = text_files.read_lines(spark, path)
        assert read.rdd.getNumPartitions() > 4
        got = [r.line for r in read.orderBy("ord").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [f"line {i}" for i in range(20000)]


def test_device_text(spark):
    def parsed(texts, n):
        df = spark.createDataFrame([(t,) for t in texts], "line string")
        return [tuple(r) for r in delimited.parse_gpu_csv(df, n).collect()]

    assert parsed(["0, 50,  20", "1, [N/A], 3", "1, 2", "0, 1, 2, 3"], 3) == [(0, 50.0, 20.0)]
    assert parsed(["0, 50, 20, 100, 16000", "1, 2, 3", "2,1,2,3,4,5,6,7"], 5) == [(0, 50.0, 20.0, 100.0, 16000.0), (2, 1.0, 2.0, 3.0, 4.0)]
    assert parsed(["0, 50, 20, 100, 16000, 65, 50.5, 70", "0, 50, 20, 100, 16000, 65, [N/A], 70"], 8) == [(0, 50.0, 20.0, 100.0, 16000.0, 65.0, 50.5, 70.0)]
    df = spark.createDataFrame([("#Date Time gpu",), (" 20240101   10:00:00    0     50     60      -     30      5      0      0",)], "line string")
    r = delimited.parse_dmon(df).first()
    assert (r.gpu, r.power_w, r.mem_temp_c, r.sm_util) == (0, 50.0, None, 30.0)
    table = spark.createDataFrame([("x", "1", "40", "20")], "timestamp string, gpu_id string, gpu_util string, mem_util string")
    assert sorted(r.util for r in delimited.utilisation_values(table).collect()) == [20.0, 40.0]
    assert sorted(r.util for r in delimited.utilisation_values(table, compat=True).collect()) == [1.0, 20.0, 40.0]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, i, f"v{i}") for i in range(30)], "agent_id long, n long, v string")
    sinks.append_jsonl(df, f"{tmp_path}/log")
    sinks.append_jsonl(df, f"{tmp_path}/log")
    assert spark.read.schema(df.schema).json(f"{tmp_path}/log").count() == 60
    sinks.write_by_key(df, f"{tmp_path}/keys", ["agent_id"])
    assert sorted(d for d in os.listdir(f"{tmp_path}/keys") if "=" in d) == ["agent_id=0", "agent_id=1", "agent_id=2"]
    assert all(len([f for f in os.listdir(f"{tmp_path}/keys/agent_id={k}") if f.endswith("json")]) <= 2 for k in range(3))
    sinks.write_latency_csv(df.select((F.col("n") / 7).alias("latency_s")), f"{tmp_path}/csv")
    assert sorted(r.latency_s for r in spark.read.option("header", True).csv(f"{tmp_path}/csv").collect()) == sorted(f"{i / 7:.6f}" for i in range(30))
    sinks.write_gzip_jsonl(df, f"{tmp_path}/gz")
    assert all(f.endswith(".gz") for f in os.listdir(f"{tmp_path}/gz") if f.startswith("part"))


def test_large_runs_continue_in_further_documents(spark):
    agents = spark.createDataFrame([("r", i, 1.0) for i in range(25)], "run_id string, agent_id long, avg_latency_s double")
    runs = spark.createDataFrame([("r", 25, 4), ("none", 0, 4)], "run_id string, num_agents long, num_tasks long")
    docs = sinks.summary_documents(agents, runs, agents_per_document=10).orderBy("run_id", "part").collect()
    assert [(d.run_id, d.part, len(d.agents), d.total_evaluations) for d in docs] == [("none", 0, 0, 0), ("r", 0, 10, 100), ("r", 1, 10, 100), ("r", 2, 5, 100)]
    assert [a.agent_id for d in docs for a in d.agents] == list(range(25))


def test_stream_of_traces_equals_batch(spark, tmp_path):
    rows = trace_rows() + [event(10.0**7, "closing", "reasoning")]
    df = spark.createDataFrame(rows, TRACE_DDL)
    # Two files, so that state crosses a batch.
    df.where("timestamp <= 1").coalesce(1).write.mode("append").json(f"{tmp_path}/log")
    df.where("timestamp > 1").coalesce(1).write.mode("append").json(f"{tmp_path}/log")
    stream = live.stream_jsonl(spark, f"{tmp_path}/log", df.schema, files_per_trigger=1)
    stream = stream.withColumn("ts", F.timestamp_seconds("timestamp"))
    state = live.drained(live.live_task_outcomes(stream), "append", ["run_id", "task_id", "session_start", "session_end"])
    batch = trace.task_outcomes(df.where("task_id <> 'closing'"))
    got = state.drop("session_start", "session_end")
    assert got.exceptAll(batch).isEmpty() and batch.exceptAll(got).isEmpty()
    assert batch.count() == 6


def test_stream_of_samples_equals_batch(spark, tmp_path):
    data = [("r", float(t), float(t % 7), 1.0, [(0, float(t % 5))]) for t in range(120)]
    df = spark.createDataFrame(data, "run_id string, s double, cpu_percent double, mem_percent double, gpu array<struct<gpu_index:int,util_percent:double>>")
    for part in range(3):
        df.where(F.floor(F.col("s") / 40) == part).coalesce(1).write.mode("append").json(f"{tmp_path}/s")
    stream = live.stream_jsonl(spark, f"{tmp_path}/s", df.schema, files_per_trigger=1)
    timed = stream.withColumn("ts", F.timestamp_seconds("s"))
    state = live.drained(live.live_run_summary(timed), "update", ["run_id", "window_start", "window_end"])
    batch = live.live_run_summary(df.withColumn("ts", F.timestamp_seconds("s")))
    assert state.count() == 12 and state.exceptAll(batch).isEmpty()
    whole = telemetry.run_summary(df).first()
    assert state.agg(F.sum("samples")).first()[0] == whole.samples
    latest = live.drained(live.live_latest(timed, ["run_id"], ["cpu_percent"]), "update", ["run_id"]).first()
    assert latest.cpu_percent == 119 % 7
    done = live.drained(live.live_progress(stream.select("run_id")), "update", ["run_id"]).first()
    assert (done.tasks_done, done.tick) == (120, 120)
