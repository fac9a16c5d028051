import pytest
from pyspark.sql import functions as F

from fleetgauge import schemas
from fleetgauge.operators import compare, grid, telemetry, trace
from fleetgauge.operators import evaluation as ev
from fleetgauge.operators import profile as pf
from fleetgauge.plans.evaluation_run import agent_evaluation


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


ATTEMPTS = "agent_id long, task_id string, attempt int, completion string, latency_s double, ok boolean, is_reflection boolean, passed boolean"


@pytest.fixture(scope="module")
def attempts(spark):
    return spark.createDataFrame(
        [
            (1, "a", 1, "first", 1.0, True, False, True),
            (1, "b", 1, "bad", 2.0, False, False, False),
            (1, "b", 2, "worse", 3.0, False, False, False),
            (1, "b", 3, "good", 4.0, True, False, True),
            (2, "a", 1, "bad", 5.0, False, False, False),
            (2, "a", 2, "bad", 6.0, None, False, None),
            (2, "b", 1, "bad", 7.0, False, False, False),
            (2, "b", 2, "fixed", 8.0, True, True, True),
        ],
        ATTEMPTS,
    )


def test_first_success(attempts):
    got = rows(ev.first_success(attempts), "agent_id", "task_id")
    assert got == [
        (1, "a", "first", 1.0, 1, True, 1),
        (1, "b", "good", 4.0, 3, True, 3),
        (2, "a", "", 6.0, None, False, 2),
        (2, "b", "fixed", 8.0, 2, True, 2),
    ]


def test_fused_evaluation_equals_composed(attempts, spark):
    problems = spark.createDataFrame([("a",), ("z",)], "task_id string")
    fused = agent_evaluation(attempts, problems)
    summary = ev.agent_summary(ev.first_success(attempts, with_completion=False))
    composed = ev.with_scores(summary, ev.pass_at_ks(attempts, problems))
    assert rows(fused.select(*sorted(f"`{c}`" for c in fused.columns)), "agent_id") == rows(
        composed.select(*sorted(f"`{c}`" for c in composed.columns)), "agent_id"
    )
    assert {r.agent_id: r["pass@1"] for r in fused.collect()} == {1: 1.0, 2: 0.0}
    overall = ev.overall_score(fused).first()
    assert (overall["pass@1"], overall.num_agents) == (0.5, 2)
    none = ev.overall_score(fused.where("false")).first()
    assert (none["pass@1"], none.num_agents, none.avg_latency_s) == (0.0, 0, 0.0)


def test_pass_at_k_needs_enough_samples_everywhere(spark):
    data = [(1, "a", i % 2 == 0) for i in range(10)] + [(1, "b", True)] * 9 + [(2, "a", True)] * 10
    df = spark.createDataFrame(data, "agent_id long, task_id string, passed boolean")
    got = {r.agent_id: (r["pass@1"], r["pass@10"], r["pass@100"]) for r in ev.pass_at_ks(df).collect()}
    assert got == {1: (0.75, None, None), 2: (1.0, 1.0, None)}


def test_partials_are_not_lost(spark):
    parts = [
        spark.createDataFrame([(1, g, f"t{g}")], "agent_id long, gpu_id int, task_id string")
        for g in range(3)
    ]
    assert ev.merge_partials(parts).count() == 3
    assert [r.task_id for r in ev.merge_partials(parts, compat=True).collect()] == ["t2"]


def test_failed_agents_and_task_names(spark, attempts):
    work = spark.createDataFrame([(1, "a"), (9, "a")], "agent_id long, task_id string")
    done = ev.first_success(attempts).select("agent_id", "task_id", "completion", "latency_s", "ok")
    assert rows(ev.with_failed_agents(work, done), "agent_id") == [
        (1, "a", "first", 1.0, True),
        (9, "a", "    pass", None, False),
    ]
    results = spark.createDataFrame(
        [(1, ["x", "y", "z"], ["a", ""], [1.0]), (2, [], [], [])],
        "agent_id long, outputs array<string>, task_ids array<string>, latencies array<double>",
    )
    listed = spark.createDataFrame([(0, "p0"), (1, "p1")], "position int, task_id string")
    assert rows(ev.completion_rows(results, listed), "position") == [
        (1, 0, "a", "x", 1.0),
        (1, 1, "p1", "y", None),
        (1, 2, "HumanEval/2", "z", None),
    ]


def test_multi_sample_and_overrides(spark, attempts):
    got = {(r.agent_id, r.task_id): (r.completions, r.avg_latency_s, r.ok) for r in ev.multi_sample(attempts).collect()}
    assert got[1, "b"] == (1, 9.0, True) and got[2, "a"] == (0, 11.0, False)
    scores = spark.createDataFrame(
        [("r1", 0.5, 10, 3.0, 4.0), ("r2", 0.5, 10, 3.0, 4.0), ("r3", None, None, None, None)],
        "run_id string, `pass@1` double, total long, avg_latency_s double, avg_throughput_rps double",
    )
    agents = spark.createDataFrame(
        [("r1", 0.0, 2.0, 3), ("r1", 8.0, None, 4)],
        "run_id string, avg_latency_s double, throughput_rps double, successes long",
    )
    assert rows(ev.override_metrics(scores, agents), "run_id") == [
        ("r1", 8.0, 2.0, 7.0),
        ("r2", 3.0, 4.0, 5.0),
        ("r3", 0.0, 0.0, 0.0),
    ]


def test_validity_rate_is_per_task(spark):
    df = spark.createDataFrame([("a", False), ("a", False), ("a", True)], "task_id string, valid boolean")
    r = ev.validity_counts(df).first()
    assert (r.syntax_errors, r.total_attempted, r.syntax_error_rate) == (2, 1, 2.0)
    assert abs(r.sample_error_rate - 2 / 3) < 1e-12


def test_run_summary_hand_case(spark):
    data = [
        ("r", 10.0, 5.0, [(0, 50.0), (1, 70.0)]),
        ("r", None, None, []),
        ("s", None, None, None),
    ]
    df = spark.createDataFrame(
        data,
        "run_id string, cpu_percent double, mem_percent double, gpu array<struct<gpu_index:int,util_percent:double>>",
    )
    assert rows(telemetry.run_summary(df), "run_id") == [
        ("r", 2, 5.0, 10.0, 2.5, 5.0, 60.0, 70.0),
        ("s", 1, 0.0, 0.0, 0.0, 0.0, None, None),
    ]


def test_stage_deltas(spark):
    def snap(tag, ts, ordinal, gpu, used, allocated=1.0, reserved=2.0):
        return ("r", tag, ts, ordinal, gpu, used, allocated, reserved)

    data = [
        snap("before_model_load_gpu0", 1.0, 1, 0, 1.0),
        snap("before_model_load_gpu0", 5.0, 2, 0, 2.0),
        snap("before_model_load_gpu0", 5.0, 3, 0, 2.5),
        snap("after_model_load_gpu0", 6.0, 4, 0, 10.0),
        snap("before_inference_gpu0", 7.0, 5, 0, 3.0, None),
        snap("after_inference_gpu0", 8.0, 6, 0, 4.0),
        snap("before_model_load_cpu_only", 8.0, 7, None, 4.0),
        snap("before_model_load_gpu1", 8.0, 8, 1, 9.0),
    ]
    df = spark.createDataFrame(
        data,
        "run_id string, tag string, ts double, ordinal int, gpu_id int, gpu_vram_used_gb double,"
        " gpu_mem_allocated_gb double, gpu_mem_reserved_gb double",
    )
    got = {(r.gpu_id, r.stage, r.kind): r for r in telemetry.stage_deltas(df).collect()}
    assert len(got) == 12
    assert got[0, "model_load", "before"].vram_used_gb == 2.5
    assert got[0, "model_load", "delta"].vram_used_gb == 7.5
    assert got[0, "inference", "delta"].vram_used_gb is None
    assert got[0, "inference", "after"].vram_used_gb == 4.0
    assert got[1, "model_load", "after"].tag == "after_model_load_gpu1"
    line = {(r.gpu_id, r.stage, r.kind): r.line for r in telemetry.stage_report(telemetry.stage_deltas(df)).collect()}
    assert line[0, "model_load", "delta"] == "0   | delta_model_load       |     7.500 |     0.000 |    0.000"
    assert line[1, "inference", "after"].endswith("|        NA |        NA |       NA")


def test_placement_and_capacity(spark):
    data = [("r", 1, 5.0, 5.0, 10.0), ("r", 0, 5.0, 5.0, 10.0), ("r", None, 0.0, 9.0, 0.0), ("q", None, 1.0, 1.0, 0.0)]
    df = spark.createDataFrame(data, "run_id string, gpu_id int, used double, free double, total double")
    assert rows(telemetry.least_loaded(df, ["run_id"]), "run_id") == [("q", "cpu"), ("r", "cuda:0")]
    assert rows(telemetry.least_loaded(df, ["run_id"], by_free=True), "run_id") == [("q", "cpu"), ("r", "cuda:0")]
    assert rows(telemetry.capacity_gate(df, ["run_id"]), "run_id") == [("q", False), ("r", True)]


def test_gpu_wide_and_cores(spark):
    gpu = ("r", [(0, "g", None, 10.0, None, 100.0, 10.0, None), (1, "h", 5.0, 1.0, 2.0, 3.0, 4.0, 60.0)])
    kind = schemas.row(run_id=schemas.S, gpu_info=schemas.RESOURCE_SAMPLE["gpu_info"].dataType)
    df = spark.createDataFrame([gpu, ("s", None)], kind)
    got = {r.run_id: r for r in telemetry.gpu_wide(df, 3).collect()}
    assert (got["r"].gpu_count, got["r"].gpu_0_load_percent, got["r"].gpu_0_memory_free_mb) == (2, 0.0, 90.0)
    assert (got["r"].gpu_1_temperature_c, got["r"].gpu_2_name) == (60.0, None)
    assert got["s"].gpu_count == 0
    cores = spark.createDataFrame([([float(i) for i in range(10)],), ([1.0],)], "per_core array<double>")
    wide = sorted(telemetry.core_slots(cores).collect(), key=lambda r: len(r.per_core))
    assert (wide[0].cpu_core_0, wide[0].cpu_core_3) == (1.0, 0.0)
    assert (wide[1].cpu_core_3, len(wide[1].per_core)) == (3.0, 8)


def test_bands_and_idle(spark):
    temps = spark.createDataFrame([(69.9,), (70.0,), (79.9,), (80.0,), (None,)], "t double")
    assert [r[0] for r in temps.select(telemetry.temperature_band(F.col("t"))).collect()] == ["ok", "warm", "warm", "hot", None]
    utils = spark.createDataFrame([("a", 150.0), ("b", 40.0), ("c", None)], "k string, util double")
    assert rows(telemetry.gpu_idle(utils, ["k"]), "k") == [("a", 0.0), ("b", 60.0), ("c", 0.0)]


def test_work_items(spark):
    tasks = grid.numbered_tasks(spark.createDataFrame([("b",), ("a",), ("c",)], "task_id string"), ["task_id"])
    got = rows(grid.work_items(tasks, 2, 2).select("work_index", "agent_id", "task_id", "gpu_id"), "work_index")
    assert got == [(0, 0, "a", 0), (1, 0, "b", 1), (2, 0, "c", 0), (3, 1, "a", 1), (4, 1, "b", 0), (5, 1, "c", 1)]
    assert grid.work_items(tasks.where("false"), 5).count() == 0


def lines(spark, texts):
    return spark.createDataFrame([("r", i, t) for i, t in enumerate(texts)], "run_id string, ord int, line string")


def test_perf_lines(spark):
    got = rows(
        pf.perf_counters(
            lines(spark, [
                "# started", "", " Performance counter stats for 'x':", "Error: y", "Failed z", "lonely",
                "   1,234,567      context-switches   #  1.2 K/sec", "  <not supported>   cycles",
                "  7  context-switches", "   12.5 msec task-clock   # 0.9 CPUs",
            ])
        ),
        "event",
    )
    assert got == [
        ("r", "context-switches", 7.0, ""),
        ("r", "cycles", None, ""),
        ("r", "msec", 12.5, "task-clock # 0.9 CPUs"),
    ]


def test_strace_lines(spark):
    got = rows(
        pf.syscall_rows(
            lines(spark, [
                "% time     seconds  usecs/call     calls    errors syscall",
                "------ ----------- ----------- --------- --------- ----------------",
                " 60.00    0.001200          12       100           futex",
                " 40.00%   0.000800           8       100        3 read", "too short line",
                "100.00    0.002000           10       200        3 total",
            ])
        ).drop("ord", "run_id"),
        "syscall",
    )
    assert got == [
        ("futex", 60.0, 0.0012, 12.0, 100, 0, False),
        ("read", 40.0, 0.0008, 8.0, 100, 3, False),
        ("total", 100.0, 0.002, 10.0, 200, 3, True),
    ]


PIDSTAT = [
    "Linux 6.1.0 (host)  01/01/24  _x86_64_  (8 CPU)", "",
    "10:00:01      UID       PID   cswch/s nvcswch/s  Command",
    "10:00:02     1000      4242     10.00      4.00  python",
    "10:00:03 PM  1000      4242     20.00      6.00  python -m x",
    "10:00:04     1000      4242    1.00    2.00    0.00    0.00    30.00     3  python",
    "10:00:05     1000      4242    1.00    2.00    0.00    50.00     3  python",
    "Average:     1000      4242    900.00    900.00  python",
]


def test_pidstat(spark):
    df = lines(spark, PIDSTAT)
    r = pf.pidstat_metrics(pf.pidstat_samples(df)).first()
    assert (r.voluntary_cswch, r.nonvoluntary_cswch, r.context_switches_per_sec, r.cpu_util) == (15.0, 5.0, 20.0, 40.0)
    old = pf.pidstat_metrics(pf.pidstat_samples(df, compat=True)).first()
    assert old.cpu_util == old.voluntary_cswch == (10 + 4242 + 1 + 1 + 900) / 5


def test_runqlat(spark):
    df = lines(spark, ["     usecs      : count     distribution", "  0 -> 1   : 3   |***|", "  2-3 : 1 |*|", "avg = 12.5 usecs"])
    buckets = pf.histogram_rows(df)
    assert pf.histogram_mean(buckets).first()[1] == (0.5 * 3 + 2.5) / 4
    assert pf.histogram_mean(buckets, compat=True).first()[1] == 12.5
    only = pf.histogram_rows(lines(spark, ["noise", "Average 7", "avg 9"]))
    assert pf.histogram_mean(only).first()[1] == 7.0
    empty = pf.histogram_rows(lines(spark, ["0 -> 1 : 0 ||"]))
    assert pf.histogram_mean(empty).first()[1] == 0.0


def test_comparison(spark):
    def phase(name, **values):
        return ("r", name, *[values.get(c) for c in ("avg_latency_s", "throughput_rps", "context_switches_per_sec", "cpu_util", "gpu_idle", "avg_sched_latency_us", "successes")])

    data = [
        phase("before", avg_latency_s=6.04, throughput_rps=0.165, context_switches_per_sec=240900.0, cpu_util=0.0, gpu_idle=98.0, successes=4.0),
        phase("after", avg_latency_s=6.53, throughput_rps=0.153, context_switches_per_sec=244000.0, cpu_util=1.0, gpu_idle=98.0, successes=5.0),
    ]
    df = spark.createDataFrame(data, "run_id string, phase string, avg_latency_s double, throughput_rps double, context_switches_per_sec double, cpu_util double, gpu_idle double, avg_sched_latency_us double, successes double")
    table = compare.comparison_table(df)
    got = {r.metric: (r.before_text, r.after_text, r.improvement) for r in table.collect()}
    assert got == {
        "avg_latency_s": ("6.04 s", "6.53 s", "-8.1%"),
        "throughput_rps": ("0.165 req/s", "0.153 req/s", "-7.3%"),
        "context_switches": ("240.9K /s", "244.0K /s", "-1.3%"),
        "cpu_util": ("0.000 %", "1.00 %", "N/A"),
        "gpu_idle_time": ("98.00 %", "98.00 %", "+0.0%"),
        "successes": ("4", "5", "+25.0%"),
    }
    report = compare.report_text(table).first().report.split("\n")
    assert report[0] == "=" * 80 and report[3] == "" and report[-1] == ""
    assert [line.split()[0] for line in report[6:-2]] == ["avg_latency_s", "throughput_rps", "context_switches", "cpu_util", "gpu_idle_time", "successes"]


def event(ts, task, stage, **payload):
    fields = ("latency_s", "success", "completion_preview", "need_reflection", "attempt", "enabled")
    return ("r", ts, task, stage, tuple(payload.get(f) for f in fields))


TRACE_DDL = (
    "run_id string, timestamp double, task_id string, stage string, payload struct<latency_s:double,"
    "success:boolean,completion_preview:string,need_reflection:boolean,attempt:int,enabled:boolean>"
)


def trace_rows():
    def act(ts, task, ok):
        return event(ts, task, "action", latency_s=1.0, success=ok, completion_preview="first")

    def reflect(ts, task, attempt, ok):
        return event(ts, task, "reflection", attempt=attempt, latency_s=2.0, success=ok, completion_preview=f"try{attempt}")

    return [
        event(1.0, "once", "reasoning"), act(2.0, "once", True), event(3.0, "once", "observation", need_reflection=False),
        act(1.0, "off", False), event(2.0, "off", "reflection", attempt=0, enabled=False, success=False, completion_preview=""),
        reflect(5.0, "fixed", 1, True), act(1.0, "fixed", False), event(2.0, "fixed", "observation", need_reflection=True),
        act(1.0, "spent", False), reflect(3.0, "spent", 2, False), reflect(2.0, "spent", 1, False),
        act(1.0, "open", False), event(2.0, "open", "observation", need_reflection=True),
        event(1.0, "cut", "reasoning"),
    ]


def test_trace_outcomes(spark):
    df = spark.createDataFrame(trace_rows(), TRACE_DDL)
    outcomes = trace.task_outcomes(df)
    got = {r.task_id: (r.success, r.latency_s, r.reflection_attempts, r.completion, r.reflection_completion, r.outcome) for r in outcomes.collect()}
    assert got == {
        "once": (True, 1.0, 0, "first", "", "first_attempt"),
        "off": (False, 1.0, 0, "", "", "reflection_disabled"),
        "fixed": (True, 3.0, 1, "try1", "try1", "repaired"),
        "spent": (False, 5.0, 2, "", "try2", "exhausted"),
        "open": (False, 1.0, 0, "", "", "pending"),
        "cut": (False, 0.0, 0, "", "", "incomplete"),
    }
    assert trace.reflection_rate(outcomes).first().needed_reflection == 5
    assert trace.outcome_classes(outcomes).count() == 6
    steps = {(r.task_id, r.stage): (r.previous_stage, r.stage_latency_s) for r in trace.stage_latency(df).collect()}
    assert steps["once", "reasoning"] == (None, None)
    assert steps["fixed", "reflection"] == ("observation", 3.0)


def test_missing_tools_and_latencies(spark):
    logs = spark.createDataFrame([("r", "before", 2.0), ("s", "after", 3.0)], "run_id string, phase string, avg_latency_s double")
    pid = spark.createDataFrame([("r", "before", 5.0)], "run_id string, phase string, cpu_util double")
    hist = spark.createDataFrame([("s", "after", 7.0)], "run_id string, phase string, avg_sched_latency_us double")
    assert rows(pf.phase_metrics(logs, pid, hist), "run_id") == [
        ("r", "before", 2.0, 5.0, 0.0),
        ("s", "after", 3.0, 0.0, 7.0),
    ]
    runs = spark.createDataFrame([("r", 1, 2, 4.0), ("s", 0, 3, 0.0)], "run_id string, successes long, total long, runtime_s double")
    lat = spark.createDataFrame([("r", 1.0), ("r", 3.0), ("r", None)], "run_id string, latency_s double")
    assert rows(ev.run_metrics_summary(lat, runs, ["run_id"]), "run_id") == [
        ("r", 2, 2.0, 2.0, 1.0, 0.5, 1, 2),
        ("s", 0, None, None, None, 0.0, 0, 3),
    ]
    agents = spark.createDataFrame([("r", 3)], "run_id string, total_tasks long")
    sizes = spark.createDataFrame([("r", 2, 3), ("s", 0, 3)], "run_id string, num_agents long, num_tasks long")
    assert rows(ev.progress(sizes, agents), "run_id") == [("r", 3, 6, 50.0), ("s", 0, 0, 0.0)]
