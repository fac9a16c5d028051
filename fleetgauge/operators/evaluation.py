"""Evaluation analytics: attempts, completions and outcomes to scores."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.fixed_values import (
    INVALID_RESULT,
    MIN_SECONDS,
    PASS_KS,
    PERCENTILE_95,
    STUB_BODY,
    TASK_ID_PREFIX,
)
from fleetgauge.functions.numbers import pass_at_k, throughput
from fleetgauge.functions.syntax import error_class, syntax_error
from fleetgauge.functions.text import looks_like_code, sanitize_completion, validated_body
from fleetgauge.plans.ordered import (
    DEFAULT_LIMITS,
    SliceLimits,
    by_rows,
    with_ordinal,
    with_running_sum,
)
from fleetgauge.plans.selection import SKETCH_SIZE, values_at_ranks


def attempt_rank() -> Column:
    """Sortable number per attempt: successful before failed, ordinary before corrective; of
    successes the earliest attempt first, of failures the last, as that is the one that was returned.
    A number keeps the aggregations that use it hash based."""
    ok = F.coalesce("ok", F.lit(False))
    failed = F.when(ok, F.lit(0)).otherwise(F.lit(1 << 62))
    late = F.when(F.coalesce("is_reflection", F.lit(False)), F.lit(1 << 61)).otherwise(F.lit(0))
    number = F.col("attempt").cast("bigint")
    return failed.cast("bigint") + late.cast("bigint") + F.when(ok, number).otherwise(-number)


def first_success(
    attempts: DataFrame,
    keys: Sequence[str] = ("agent_id", "task_id"),
    with_completion: bool = True,
) -> DataFrame:
    """One row per work item: its first successful attempt, else an empty failed one.

    Corrective attempts (``is_reflection``) come after every ordinary attempt, so they replace
    the output only where no ordinary attempt succeeded. Without the completion text nothing but
    numbers is aggregated.
    """
    rank = attempt_rank()
    ok = F.coalesce(F.bool_or("ok"), F.lit(False))
    text = [F.min_by("completion", rank).alias("__text")] if with_completion else []
    chosen = attempts.groupBy(*keys).agg(
        *text,
        F.min_by("latency_s", rank).alias("latency_s"),
        F.min_by("attempt", rank).alias("attempt"),
        ok.alias("ok"),
        F.count(F.lit(1)).alias("attempts_made"),
    )
    shown = F.when(F.col("ok"), F.col("__text")).otherwise(F.lit(""))
    return chosen.select(
        *keys,
        *([shown.alias("completion")] if with_completion else []),
        "latency_s",
        F.when(F.col("ok"), F.col("attempt")).alias("attempt"),
        "ok",
        "attempts_made",
    )


def task_counts(outcomes: DataFrame, keys: Sequence[str] = ("agent_id",)) -> DataFrame:
    """Samples ``n`` and correct samples ``c`` per key and task."""
    return outcomes.groupBy(*keys, "task_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce("passed", F.lit(False))).alias("c"),
    )


def pass_at_ks(
    outcomes: DataFrame,
    problems: DataFrame | None = None,
    keys: Sequence[str] = ("agent_id",),
    ks: Sequence[int] = tuple(PASS_KS),
) -> DataFrame:
    """pass@k per key: mean over tasks, reported only if every task has at least k samples.

    Outcomes shrink to one row per (key, task) before anything else, so neither a hot task nor
    a hot agent reaches the join or the second aggregation as raw rows. ``problems`` limits the
    tasks to known ones.
    """
    counts = task_counts(outcomes, keys)
    if problems is not None:
        counts = counts.join(problems.select("task_id").distinct(), "task_id", "left_semi")
    n, c = F.col("n"), F.col("c")
    scored = counts.select(
        *keys, "n", *[pass_at_k(n, c, k).alias(f"__p{k}") for k in ks]
    )
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tasks"),
        *[
            F.when(F.min("n") >= k, F.avg(f"__p{k}")).alias(f"pass@{k}")
            for k in ks
        ],
    )


def agent_summary(
    results: DataFrame,
    spans: DataFrame | None = None,
    min_seconds: float = MIN_SECONDS,
    keys: Sequence[str] = ("agent_id",),
) -> DataFrame:
    """Count, mean latency, runtime, throughput and successes per agent, or per run and agent.

    ``results`` has (agent_id, latency_s, ok). Without ``spans`` (agent_id, total_time_s) the
    runtime is the summed latency.
    """
    base = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_tasks"),
        F.count_if(F.coalesce("ok", F.lit(False))).alias("successes"),
        F.coalesce(F.avg("latency_s"), F.lit(0.0)).alias("avg_latency_s"),
        F.coalesce(F.sum("latency_s"), F.lit(0.0)).alias("__latency"),
    )
    if spans is None:
        base = base.withColumn("total_time_s", F.col("__latency"))
    else:
        base = base.join(spans.select(*keys, "total_time_s"), list(keys), "left")
        base = base.withColumn("total_time_s", F.coalesce("total_time_s", F.lit(0.0)))
    return base.withColumn(
        "throughput_rps", throughput(F.col("total_tasks"), F.col("total_time_s"), min_seconds)
    ).drop("__latency")


def with_scores(
    summary: DataFrame,
    scores: DataFrame,
    ks: Sequence[int] = tuple(PASS_KS),
    keys: Sequence[str] = ("agent_id",),
):
    """Adds pass@k to agent summaries; an agent whose evaluation is missing scores 0."""
    names = [f"pass@{k}" for k in ks]
    joined = summary.join(scores.select(*keys, *[f"`{n}`" for n in names]), list(keys), "left")
    return joined.withColumns({n: F.coalesce(F.col(f"`{n}`"), F.lit(0.0)) for n in names})


def overall_score(summary: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Macro averages over agents (each agent counts once, however many tasks it ran)."""
    return summary.groupBy(*keys).agg(
        F.coalesce(F.avg("`pass@1`"), F.lit(0.0)).alias("pass@1"),
        F.count(F.lit(1)).alias("num_agents"),
        F.coalesce(F.avg("avg_latency_s"), F.lit(0.0)).alias("avg_latency_s"),
        F.coalesce(F.avg("throughput_rps"), F.lit(0.0)).alias("avg_throughput_rps"),
    )


def latency_summary(
    df: DataFrame,
    keys: Sequence[str] = (),
    value: str = "latency_s",
    exact: bool = True,
    limits: SliceLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """n, mean, median and 95th percentile by nearest rank (rank ``max(floor(.95 n), 1)``).

    Ranks are found by ``plans/selection.py``: neither all values nor all distinct ones are shuffled.
    ``exact=False`` takes both order statistics from one sketch per key, in one pass.
    """
    keys = list(keys)
    mean = (F.sum(value) / F.count(value)).alias("avg_latency_s")
    if not exact:
        sketch = F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(SKETCH_SIZE)).alias("__sketch")
        sketched = df.groupBy(*keys).agg(F.count(value).alias("n"), mean, sketch).where("n > 0")
        return sketched.select(*keys, "n", "avg_latency_s", *_sketched_quantiles("__sketch"))
    n = F.col("n")
    ranks = {
        "__low": (0.5, F.floor((n + 1) / 2)),
        "__high": (0.5, F.floor(n / 2) + 1),
        "p95_s": (PERCENTILE_95, F.greatest(F.floor(F.lit(PERCENTILE_95) * n), F.lit(1))),
    }
    found = values_at_ranks(df, keys, F.col(value), ranks, [mean], limits)
    p50 = ((F.col("__low") + F.col("__high")) / 2).alias("p50_s")
    return found.select(*keys, "n", "avg_latency_s", p50, "p95_s")


def _sketched_quantiles(sketch: str) -> list[Column]:
    return [
        F.kll_sketch_get_quantile_double(sketch, F.lit(share)).alias(name)
        for name, share in (("p50_s", 0.5), ("p95_s", PERCENTILE_95))
    ]


def latency_sketches(
    attempts: DataFrame, keys: Sequence[str], value: str = "latency_s", task: str = "task_id"
) -> DataFrame:
    """Keys, n, latency_sum, latency_sketch, task_sketch: partial results to keep and to roll up.

    Written once per run they answer for any coarser grouping, and for further runs, without the
    attempts. NaN is left out of the latency sketch.
    """
    real = F.nanvl(F.col(value).cast("double"), F.lit(None))
    return attempts.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.sum(value).alias("latency_sum"),
        F.kll_sketch_agg_double(real, F.lit(SKETCH_SIZE)).alias("latency_sketch"),
        F.hll_sketch_agg(F.col(task), F.lit(14)).alias("task_sketch"),
    )


def rolled_up(sketches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """n, mean, median, 95th percentile and distinct tasks from ``latency_sketches`` of finer keys.

    Ranks are off by some 0.4 % of n for sketches of 800 and distinct counts by some 0.8 %; n and the
    mean are exact.
    """
    merged = sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        (F.sum("latency_sum") / F.sum("n")).alias("avg_latency_s"),
        F.kll_merge_agg_double("latency_sketch").alias("__sketch"),
        F.hll_sketch_estimate(F.hll_union_agg("task_sketch")).alias("distinct_tasks"),
    )
    return merged.where("n > 0").select(
        *keys, "n", "avg_latency_s", *_sketched_quantiles("__sketch"), "distinct_tasks"
    )


def run_metrics_summary(
    latencies: DataFrame, runs: DataFrame, keys: Sequence[str], min_seconds: float = MIN_SECONDS
) -> DataFrame:
    """Latency summary next to throughput, successes and total; a run without latencies has
    null statistics. ``runs`` has the keys plus (successes, total, runtime_s)."""
    stats = latency_summary(latencies, keys)
    joined = runs.join(stats, list(keys), "left")
    return joined.select(
        *keys,
        F.coalesce("n", F.lit(0)).alias("n"),
        "avg_latency_s",
        "p50_s",
        "p95_s",
        throughput(F.coalesce("n", F.lit(0)), F.col("runtime_s"), min_seconds).alias(
            "throughput_rps"
        ),
        "successes",
        "total",
    )


def validity_counts(flagged: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Invalid samples, distinct attempted tasks and both error rates (``valid`` is boolean)."""
    return flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(~F.col("valid")).alias("syntax_errors"),
        F.count_distinct("task_id").alias("total_attempted"),
        F.coalesce(
            F.try_divide(F.count_if(~F.col("valid")), F.count_distinct("task_id")), F.lit(0.0)
        ).alias("syntax_error_rate"),
        F.coalesce(
            F.try_divide(F.count_if(~F.col("valid")), F.count(F.lit(1))), F.lit(0.0)
        ).alias("sample_error_rate"),
    )


def with_syntax(completions: DataFrame, column: str = "completion") -> DataFrame:
    """Adds ``syntax_error`` (null when valid) and ``error_class``."""
    checked = completions.withColumn("syntax_error", syntax_error(F.col(column)))
    return checked.withColumn("error_class", error_class(F.col("syntax_error")))


def flag_invalid(completions: DataFrame, valid: Column, cleaned: Column) -> DataFrame:
    """Valid rows get the cleaned text; invalid rows stay as they were, marked as failed."""
    return completions.withColumns(
        {
            "completion": F.when(valid, cleaned).otherwise(F.col("completion")),
            "syntax_error": F.when(~valid, F.lit(INVALID_RESULT)),
            "passed": F.when(~valid, F.lit(False)),
            "result": F.when(~valid, F.lit(INVALID_RESULT)),
        }
    )


def prevalidate(completions: DataFrame) -> DataFrame:
    """Parses every completion, then flags instead of dropping."""
    checked = with_syntax(completions)
    flagged = flag_invalid(
        checked.withColumnRenamed("syntax_error", "__error"),
        F.col("__error").isNull(),
        validated_body(F.col("completion")),
    )
    return flagged.drop("__error")


def error_class_counts(checked: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return checked.groupBy(*keys, "error_class").agg(
        F.count(F.lit(1)).alias("samples"), F.count_distinct("task_id").alias("tasks")
    )


def code_rate(outputs: DataFrame, keys: Sequence[str] = (), column: str = "completion"):
    """Share of outputs that look like code."""
    hits = F.count_if(looks_like_code(F.col(column)))
    total = F.count(F.lit(1))
    return outputs.groupBy(*keys).agg(
        hits.alias("pass_like"),
        total.alias("total"),
        (hits / F.greatest(total, F.lit(1))).alias("rate_est"),
    )


def attempted_problems(problems: DataFrame, completions: DataFrame) -> DataFrame:
    """Problems somebody attempted; attempted ids that are not problems disappear."""
    return problems.join(completions.select("task_id").distinct(), "task_id", "left_semi")


def completion_rows(
    results: DataFrame, prompts: DataFrame, run: Sequence[str] = ()
) -> DataFrame:
    """Aligned arrays of an agent result as rows, each with a task id.

    A missing or empty id falls back to the prompt at the same position, then to a numbered
    name. ``prompts`` has (position, task_id), positions from 0; ``run`` names columns of both
    tables that keep the prompt lists of different runs apart.
    """
    rows = results.select(
        *[c for c in results.columns if c not in ("outputs", "task_ids", "latencies")],
        F.posexplode(
            F.slice(
                F.arrays_zip("outputs", "task_ids", "latencies"), F.lit(1), F.size("outputs")
            )
        ).alias("position", "item"),
    )
    listed = prompts.select(
        *run, F.col("position").cast("int").alias("position"), F.col("task_id").alias("__listed")
    )
    return rows.join(listed, [*run, "position"], "left").select(
        *[c for c in rows.columns if c not in ("position", "item")],
        "position",
        F.coalesce(
            F.nullif(F.col("item.task_ids"), F.lit("")),
            F.col("__listed"),
            F.concat(F.lit(TASK_ID_PREFIX), F.col("position")),
        ).alias("task_id"),
        F.col("item.outputs").alias("output"),
        F.col("item.latencies").alias("latency_s"),
    )


def sanitized(rows: DataFrame, compat: bool = False) -> DataFrame:
    return rows.withColumn("completion", sanitize_completion(F.col("output"), compat))


def merge_partials(parts: Sequence[DataFrame], compat: bool = False) -> DataFrame:
    """Rows of all devices together.

    ``compat`` keeps, per agent, only the rows of the highest-numbered device that served it,
    which is what an assigning merge leaves behind.
    """
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    if not compat:
        return merged
    last = merged.groupBy("agent_id").agg(F.max("gpu_id").alias("gpu_id"))
    return merged.join(last, ["agent_id", "gpu_id"], "left_semi")


def with_failed_agents(work_items: DataFrame, results: DataFrame) -> DataFrame:
    """Every work item: its result, or a stub without latency where the agent gave none."""
    keys = ["agent_id", "task_id"]
    joined = work_items.join(results.withColumn("__got", F.lit(True)), keys, "left")
    got = F.coalesce("__got", F.lit(False))
    return joined.select(
        *work_items.columns,
        F.when(got, F.col("completion")).otherwise(F.lit(STUB_BODY)).alias("completion"),
        F.col("latency_s"),
        (got & F.coalesce("ok", F.lit(False))).alias("ok"),
    )


def multi_sample(attempts: DataFrame, keys: Sequence[str] = ("agent_id", "task_id")) -> DataFrame:
    """Successful completions per task, mean latency over them, and whether any succeeded."""
    ok = F.coalesce("ok", F.lit(False))
    return attempts.groupBy(*keys).agg(
        F.count_if(ok).alias("completions"),
        (F.sum("latency_s") / F.greatest(F.count_if(ok), F.lit(1))).alias("avg_latency_s"),
        F.bool_or(ok).alias("ok"),
    )


def with_batches(
    items: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    batch_size: int,
    limits: SliceLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """0-based batch number of consecutive items; the last batch may be short."""
    size = max(int(batch_size), 1)
    numbered = with_ordinal(items, keys, order, "__pos", limits=limits)
    return numbered.withColumn(
        "batch_no", F.floor((F.col("__pos") - 1) / size).cast("bigint")
    ).drop("__pos")


def batch_latency(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per-item latency of a batch: elapsed over items (``start_s``/``end_s`` in seconds)."""
    return items.groupBy(*keys, "batch_no").agg(
        F.count(F.lit(1)).alias("batch_items"),
        ((F.max("end_s") - F.min("start_s")) / F.count(F.lit(1))).alias("item_latency_s"),
    )


def batch_counts(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    return items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), (F.max("batch_no") + 1).alias("num_batches")
    )


def task_list_chunks(
    items: DataFrame,
    key: str,
    order: Sequence[str],
    task: str = "task_id",
    chunk: int = 1000,
    limits: SliceLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """Each key's tasks in order, as arrays of at most ``chunk`` elements.

    Chunks in ``chunk_no`` order concatenate to the whole list, and no task ever holds more
    than one chunk of it.
    """
    numbered = with_ordinal(items, [key], order, "__pos", limits=limits)
    placed = numbered.withColumn("chunk_no", F.floor((F.col("__pos") - 1) / chunk).cast("bigint"))
    listed = placed.groupBy(key, "chunk_no").agg(
        F.sort_array(F.collect_list(F.struct("__pos", task))).alias("__rows")
    )
    return listed.select(
        key, "chunk_no", F.transform("__rows", lambda r: r[task]).alias("tasks")
    )


def run_span(df: DataFrame, keys: Sequence[str], start: str = "ts", end: str = "ts") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min(start).alias("start_s"),
        F.max(end).alias("end_s"),
        (F.max(end) - F.min(start)).alias("runtime_s"),
    )


def peak_concurrency(
    intervals: DataFrame,
    keys: Sequence[str],
    start: str = "start_s",
    end: str = "end_s",
    limits: SliceLimits = DEFAULT_LIMITS,
    bucket_s: float = 60.0,
) -> DataFrame:
    """Largest number of intervals open at once, and how many were started.

    Starts and ends collapse to one net change per instant, so ends count before starts of the
    same instant and repeated instants cost one row. Instants are ordered within time buckets of
    ``bucket_s`` seconds only; each bucket gives its net change and its highest point, and only these
    pairs are brought into order over the whole key. An interval without an end stays open; one without
    a start never began and is left out. Instants are seconds or timestamps.
    """
    intervals = intervals.where(F.col(start).isNotNull())
    steps = intervals.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col(start).alias("t"), F.lit(1).alias("d")),
                F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")),
            )
        ),
    )
    net = steps.where(F.col("t").isNotNull()).groupBy(*keys, "t").agg(
        F.sum("d").alias("d"), F.count_if(F.col("d") > 0).alias("s")
    )
    at = F.unix_micros("t") / 1e6 if dict(net.dtypes)["t"] == "timestamp" else F.col("t")
    within = Window.partitionBy(*keys, "__bucket").orderBy("t")
    # Instants compress well, so that a partition of few bytes would hold millions of them: tasks go by rows.
    dealt = by_rows(net.withColumn("__bucket", F.floor(at / bucket_s)), [*keys, "__bucket"], limits, "instants")
    risen = dealt.withColumn("__up", F.sum("d").over(within))
    buckets = risen.groupBy(*keys, "__bucket").agg(
        F.sum("d").alias("d"), F.max("__up").alias("__top"), F.sum("s").alias("s")
    )
    running = with_running_sum(buckets, keys, ["__bucket"], F.col("d"), "__upto", limits=limits)
    return running.groupBy(*keys).agg(
        F.max(F.col("__upto") - F.col("d") + F.col("__top")).alias("max_concurrent"), F.sum("s").alias("started")
    )


def executor_map(work_items: DataFrame, placements: DataFrame) -> DataFrame:
    """Which device ran which task: an equi join on (agent, task); AQE splits hot agents."""
    return work_items.join(placements, ["agent_id", "task_id"], "inner")


def override_metrics(scores: DataFrame, agents: DataFrame) -> DataFrame:
    """Run metrics from the score document, replaced by per-agent figures where those exist.

    Zero and missing agent figures do not enter the means. Successes are the agents' sum when
    the run lists any agent, else pass@1 times the total.
    """
    per_run = agents.groupBy("run_id").agg(
        F.avg(F.nullif(F.col("avg_latency_s"), F.lit(0.0))).alias("__lat"),
        F.avg(F.nullif(F.col("throughput_rps"), F.lit(0.0))).alias("__rps"),
        F.sum(F.coalesce("successes", F.lit(0))).cast("double").alias("__ok"),
    )
    joined = scores.join(per_run, "run_id", "left")
    passed = F.coalesce("`pass@1`", F.lit(0.0)) * F.coalesce("total", F.lit(0))
    return joined.select(
        "run_id",
        F.coalesce("__lat", "avg_latency_s", F.lit(0.0)).alias("avg_latency_s"),
        F.coalesce("__rps", "avg_throughput_rps", F.lit(0.0)).alias("throughput_rps"),
        F.coalesce("__ok", passed).alias("successes"),
    )


def progress(runs: DataFrame, agents: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Tasks done against agents x tasks, with a guarded percentage."""
    done = agents.groupBy(*keys).agg(F.sum("total_tasks").alias("__done"))
    total = F.col("num_agents") * F.col("num_tasks")
    joined = runs.join(done, list(keys), "left")
    return joined.select(
        *keys,
        F.coalesce("__done", F.lit(0)).alias("tasks_done"),
        total.alias("tasks_total"),
        F.when(total > 0, F.coalesce("__done", F.lit(0)) / total * 100.0)
        .otherwise(0.0)
        .alias("progress_percent"),
    )
