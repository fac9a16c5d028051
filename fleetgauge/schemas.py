"""Row schemas of the log and table formats (all fields nullable; scans never infer)."""

from pyspark.sql import types as T

S, D, B = T.StringType(), T.DoubleType(), T.BooleanType()
I, L, TS = T.IntegerType(), T.LongType(), T.TimestampType()


def row(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def extended(base: T.StructType, **fields: T.DataType) -> T.StructType:
    return T.StructType([*base.fields, *row(**fields).fields])


PROBLEM = row(task_id=S, prompt=S, entry_point=S, canonical_solution=S, test=S)

PROMPT = row(
    prompt_text=S, task_id=S, entry_point=S, system_msg=S, user_msg=S, full_task=PROBLEM
)

WORK_ITEM = row(agent_id=L, task_idx=L, work_index=L, task_id=S)

AGENT_RESULT = row(
    agent_id=L,
    latencies=T.ArrayType(D),
    outputs=T.ArrayType(S),
    task_ids=T.ArrayType(S),
    successes=I,
    total=I,
    runtime_s=D,
    throughput_rps=D,
    max_concurrent_agents=I,
    configured_agents=I,
    total_processed=I,
    batch_size=I,
    num_batches=I,
)

COMPLETION = row(task_id=S, completion=S, syntax_error=S, passed=B, result=S)

PASS_RATES = {"pass@1": D, "pass@10": D, "pass@100": D}

AGENT_SUMMARY = row(
    agent_id=L,
    total_tasks=L,
    successes=L,
    avg_latency_s=D,
    total_time_s=D,
    throughput_rps=D,
    results_file=S,
    **PASS_RATES,
)

RUN_SUMMARY_DOC = row(
    num_agents=L, num_tasks=L, total_evaluations=L, agents=T.ArrayType(AGENT_SUMMARY)
)

SCORE = row(
    **{"pass@1": D}, total=L, num_agents=L, avg_latency_s=D, avg_throughput_rps=D
)

MEM_SNAPSHOT = row(
    tag=S,
    ts=D,
    cpu_ram_used_gb=D,
    cpu_ram_total_gb=D,
    cpu_ram_percent=D,
    gpu_id=I,
    gpu_vram_free_gb=D,
    gpu_vram_total_gb=D,
    gpu_vram_used_gb=D,
    gpu_mem_allocated_gb=D,
    gpu_mem_reserved_gb=D,
    gpu_mem_source=S,
    gpu_mem_get_info_error=S,
    gpu_nvml_error=S,
)

GPU_INFO = row(
    id=I,
    name=S,
    **{"load_%": D},
    mem_used_mb=D,
    mem_free_mb=D,
    mem_total_mb=D,
    mem_percent=D,
    temp_c=D,
)

RESOURCE_SAMPLE = row(
    ts=D,
    cpu_percent=D,
    cpu_count=I,
    cpu_count_physical=I,
    cpu_core_0=D,
    cpu_core_1=D,
    cpu_core_2=D,
    cpu_core_3=D,
    ram_used_mb=D,
    ram_total_mb=D,
    ram_percent=D,
    ram_available_mb=D,
    ram_free_mb=D,
    ram_cached_mb=D,
    swap_used_mb=D,
    swap_total_mb=D,
    swap_percent=D,
    disk_used_gb=D,
    disk_total_gb=D,
    disk_percent=D,
    disk_free_gb=D,
    disk_read_mb=D,
    disk_write_mb=D,
    disk_read_count=L,
    disk_write_count=L,
    net_sent_mb=D,
    net_recv_mb=D,
    net_packets_sent=L,
    net_packets_recv=L,
    net_errors_in=L,
    net_errors_out=L,
    process_count=I,
    gpu_count=I,
    gpu_info=T.ArrayType(GPU_INFO),
)

SYSTEM_METRIC = row(
    timestamp=S,
    cpu_percent=D,
    cpu_user_percent=D,
    cpu_system_percent=D,
    cpu_iowait_percent=D,
    ctx_switches_total=L,
    ctx_switches_voluntary=L,
    ctx_switches_involuntary=L,
    mem_used_mb=D,
    mem_available_mb=D,
    mem_percent=D,
    swap_used_mb=D,
    gpu=T.ArrayType(
        row(gpu_index=I, util_percent=D, mem_util_percent=D, mem_used_mb=D, mem_total_mb=D)
    ),
)

PERF_SAMPLE = row(
    ts=D,
    cpu_user=D,
    cpu_sys=D,
    ctx_switches_vol=L,
    ctx_switches_invol=L,
    mem_used_mb=D,
    gpu=T.ArrayType(row(gpu_id=I, util_percent=D, mem_util_percent=D)),
)

GPU_DMON = row(
    date=S,
    time=S,
    gpu=I,
    power_w=D,
    gpu_temp_c=D,
    mem_temp_c=D,
    sm_util=D,
    mem_util=D,
    enc_util=D,
    dec_util=D,
)

GPU_CSV_FIELDS = [
    ("gpu_index", "int"),
    ("util_percent", "double"),
    ("mem_util_percent", "double"),
    ("mem_used_mb", "double"),
    ("mem_total_mb", "double"),
    ("temp_c", "double"),
    ("power_draw_w", "double"),
    ("power_limit_w", "double"),
]

PERF_COUNTER = row(run_id=S, event=S, value=D, annotation=S)

SYSCALL_ROW = row(
    run_id=S,
    syscall=S,
    percent_time=D,
    seconds=D,
    usecs_per_call=D,
    calls=L,
    errors=L,
    is_total=B,
)

PROFILE_RUN = row(
    benchmark=S,
    num_agents=I,
    config_path=S,
    command=S,
    start_time_utc=S,
    end_time_utc=S,
    return_code=I,
    tools=row(perf=B, strace=B, bpftrace=B),
    outputs=row(
        stdout_log=S,
        stderr_log=S,
        perf_stat=S,
        strace_summary=S,
        bpftrace_output=S,
        system_metrics=S,
    ),
    perf_metrics=T.MapType(S, row(value=S, annotation=S)),
    strace_metrics=T.ArrayType(
        row(syscall=S, percent_time=S, seconds=S, usecs_per_call=S, calls=S, errors=S)
    ),
    system_metrics_summary=row(
        samples=L,
        cpu_percent_avg=D,
        cpu_percent_max=D,
        mem_percent_avg=D,
        mem_percent_max=D,
        gpu_util_percent_avg=D,
        gpu_util_percent_max=D,
    ),
)

PHASE_METRICS = row(
    run_id=S,
    phase=S,
    avg_latency_s=D,
    throughput_rps=D,
    successes=D,
    gpu_idle=D,
    context_switches_per_sec=D,
    cpu_util=D,
    voluntary_cswch=D,
    nonvoluntary_cswch=D,
    avg_sched_latency_us=D,
    runtime_s=D,
)

TRACE_EVENT = row(
    timestamp=D,
    task_id=S,
    stage=S,
    payload=row(
        reasoning=S,
        latency_s=D,
        success=B,
        completion_preview=S,
        message=S,
        need_reflection=B,
        attempt=I,
        enabled=B,
    ),
)

ATTEMPT = row(
    run_id=S,
    agent_id=L,
    task_id=S,
    attempt=I,
    gpu_id=I,
    started_at=TS,
    ended_at=TS,
    completion=S,
    latency_s=D,
    ok=B,
    is_reflection=B,
)

OUTCOME = row(agent_id=L, task_id=S, sample=L, passed=B)

SCHED_EVENT = row(ts=TS, tid=L, comm=S)

PROCESS_SAMPLE = row(
    ts=TS,
    pid=L,
    name=S,
    cmdline=S,
    cpu_percent=D,
    rss_bytes=L,
    vol_switches=L,
    nonvol_switches=L,
)
