"""Telemetry analytics: run summaries, stage deltas, rates, capacity and placement."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.fixed_values import (
    CAPACITY_THRESHOLD,
    HOT_CELSIUS,
    MAIN_COMMAND,
    RESOURCE_METRICS,
    SNAPSHOT_METRICS,
    STAGES,
    WARM_CELSIUS,
)
from fleetgauge.functions.numbers import used_percent, utilisation
from fleetgauge.functions.present import number_or_na, padded
from fleetgauge.plans.ordered import DEFAULT_LIMITS, SliceLimits, with_previous


def gpu_mean(gpus: Column) -> Column:
    """Mean utilisation of a sample's devices; null without devices."""
    used = F.transform(gpus, lambda g: F.coalesce(g["util_percent"], F.lit(0.0)))
    return F.when(
        F.size(gpus) > 0, F.aggregate(used, F.lit(0.0), lambda a, b: a + b) / F.size(gpus)
    )


def gpu_peak(gpus: Column) -> Column:
    return F.array_max(F.transform(gpus, lambda g: F.coalesce(g["util_percent"], F.lit(0.0))))


def summary_columns() -> list[Column]:
    """Aggregates of the run summary; they serve batch and streams alike."""
    cpu, mem = F.coalesce("cpu_percent", F.lit(0.0)), F.coalesce("mem_percent", F.lit(0.0))
    gpus = F.col("gpu")
    return [
        F.count(F.lit(1)).alias("samples"),
        F.avg(cpu).alias("cpu_percent_avg"),
        F.greatest(F.max(cpu), F.lit(0.0)).alias("cpu_percent_max"),
        F.avg(mem).alias("mem_percent_avg"),
        F.greatest(F.max(mem), F.lit(0.0)).alias("mem_percent_max"),
        F.avg(gpu_mean(gpus)).alias("gpu_util_percent_avg"),
        F.greatest(F.max(gpu_peak(gpus)), F.when(F.max(gpu_peak(gpus)).isNotNull(), 0.0)).alias(
            "gpu_util_percent_max"
        ),
    ]


def run_summary(samples: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """CPU, memory and GPU averages and peaks per run.

    The GPU mean is the mean of per-sample means, over samples that list a device.
    """
    return samples.groupBy(*keys).agg(*summary_columns())


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key by ``order``; partial aggregation keeps hot keys off one task."""
    others = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__row"))
    return last.select(*keys, *[F.col(f"__row.`{c}`").alias(c) for c in others])


_STAGE_VALUES = ["gpu_vram_used_gb", "gpu_mem_allocated_gb", "gpu_mem_reserved_gb"]


def stage_deltas(snapshots: DataFrame, run: Sequence[str] = ("run_id",)) -> DataFrame:
    """Before, after and delta rows per device and stage.

    The last snapshot of a tag wins (by ``ts``, then ``ordinal``). One aggregation finds all
    before and after rows of a device at once, so no lookup joins are needed; a stage without
    snapshots still gives its three rows, with nulls. The delta needs all six values.
    """
    keys = [*run, "gpu_id"]
    known = snapshots.where(F.col("gpu_id").isNotNull())
    values, order = F.struct(*_STAGE_VALUES), F.struct("ts", "ordinal")
    picks = []
    for name, before, after, _ in STAGES:
        for side, prefix in (("b", before), ("a", after)):
            hit = F.col("tag") == F.concat(F.lit(prefix), F.col("gpu_id").cast("string"))
            picks.append(
                F.max_by(values, F.when(hit, order)).alias(f"{side}_{name}")
            )
    found = known.groupBy(*keys).agg(*picks)
    rows = []
    for name, before, after, delta in STAGES:
        b, a = F.col(f"b_{name}"), F.col(f"a_{name}")
        complete = F.lit(True)
        for v in _STAGE_VALUES:
            complete = complete & b[v].isNotNull() & a[v].isNotNull()
        gpu = F.col("gpu_id").cast("string")
        rows.append(_stage_row(name, "before", F.concat(F.lit(before), gpu), lambda v, b=b: b[v]))
        rows.append(_stage_row(name, "after", F.concat(F.lit(after), gpu), lambda v, a=a: a[v]))
        rows.append(
            _stage_row(
                name,
                "delta",
                F.lit(delta),
                lambda v, a=a, b=b, ok=complete: F.when(ok, a[v] - b[v]),
            )
        )
    return found.select(*keys, F.inline(F.array(*rows)))


def _stage_row(stage: str, kind: str, tag: Column, value) -> Column:
    return F.struct(
        F.lit(stage).alias("stage"),
        F.lit(kind).alias("kind"),
        tag.alias("tag"),
        value("gpu_vram_used_gb").alias("vram_used_gb"),
        value("gpu_mem_allocated_gb").alias("allocated_gb"),
        value("gpu_mem_reserved_gb").alias("reserved_gb"),
    )


def stage_report(deltas: DataFrame) -> DataFrame:
    """Delta rows as table lines with three decimals, or NA."""
    cells = [
        F.lpad(number_or_na(F.col(c)), width, " ")
        for c, width in (("vram_used_gb", 9), ("allocated_gb", 9), ("reserved_gb", 8))
    ]
    line = F.concat_ws(
        " | ", F.concat(F.col("gpu_id").cast("string"), F.lit("  ")), padded(F.col("tag"), 22), *cells
    )
    return deltas.select(
        *[c for c in deltas.columns if c in ("run_id", "gpu_id", "stage", "kind")],
        line.alias("line"),
    )


def gpu_ids(snapshots: DataFrame, run: Sequence[str] = ("run_id",)) -> DataFrame:
    """Distinct devices, in order."""
    known = snapshots.where(F.col("gpu_id").isNotNull())
    return known.select(*run, "gpu_id").distinct().orderBy(*run, "gpu_id")


def counter_rates(
    samples: DataFrame,
    keys: Sequence[str],
    counters: Sequence[str],
    ts: str = "ts",
    ties: Sequence[str] = (),
    limits: SliceLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """Per-second rates of cumulative counters; the first sample and resets have none."""
    held = {f"__p_{c}": c for c in [*counters, ts]}
    paired = with_previous(samples, keys, [ts, *ties], held, limits)
    span = F.col(ts) - F.col(f"__p_{ts}")
    rates = {}
    for c in counters:
        grown = F.col(c) - F.col(f"__p_{c}")
        rates[f"{c}_delta"] = F.when(grown >= 0, grown)
        rates[f"{c}_rate"] = F.when((grown >= 0) & (span > 0), grown / span)
    return paired.withColumns(rates).drop(*held)


def least_loaded(devices: DataFrame, keys: Sequence[str], by_free: bool = False) -> DataFrame:
    """Device with least memory used (or most free) per key; lowest id wins ties.

    Keys whose devices are all unknown get ``cpu``. Samples first collapse to one number per key
    and device, which is hash aggregation over primitives; only those few rows are compared as
    (load, id) pairs.
    """
    measure = -F.col("free") if by_free else F.col("used")
    each = devices.groupBy(*keys, "gpu_id").agg(F.min(measure).alias("__load"))
    known = F.col("gpu_id").isNotNull() & F.col("__load").isNotNull()
    best = each.groupBy(*keys).agg(
        F.min(F.when(known, F.struct("__load", "gpu_id"))).alias("__best")
    )
    return best.select(
        *keys,
        F.coalesce(
            F.concat(F.lit("cuda:"), F.col("__best.gpu_id").cast("string")), F.lit("cpu")
        ).alias("device"),
    )


def capacity_columns(threshold: float = CAPACITY_THRESHOLD) -> list[Column]:
    free = utilisation(F.col("used"), F.col("total")) < threshold
    return [F.coalesce(F.bool_or(free), F.lit(False)).alias("available")]


def capacity_gate(
    devices: DataFrame, keys: Sequence[str], threshold: float = CAPACITY_THRESHOLD
) -> DataFrame:
    """Whether any device of the key (a run and time bucket) is below the threshold."""
    return devices.groupBy(*keys).agg(*capacity_columns(threshold))


def saturated_share(gates: DataFrame, keys: Sequence[str]) -> DataFrame:
    shut = F.count_if(~F.col("available"))
    return gates.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("buckets"),
        shut.alias("saturated"),
        (shut / F.count(F.lit(1))).alias("saturated_share"),
    )


def gpu_defaults(gpus: Column) -> Column:
    """Device structs with null load as 0 and missing free memory as total minus used."""
    return F.transform(
        gpus,
        lambda g: F.struct(
            g["id"].alias("id"),
            g["name"].alias("name"),
            F.coalesce(g["load_%"], F.lit(0.0)).alias("load_percent"),
            g["mem_used_mb"].alias("memory_used_mb"),
            F.coalesce(g["mem_free_mb"], g["mem_total_mb"] - g["mem_used_mb"]).alias(
                "memory_free_mb"
            ),
            g["mem_total_mb"].alias("memory_total_mb"),
            g["mem_percent"].alias("memory_percent"),
            g["temp_c"].alias("temperature_c"),
        ),
    )


_WIDE_FIELDS = [
    "load_percent",
    "memory_used_mb",
    "memory_free_mb",
    "memory_total_mb",
    "memory_percent",
    "temperature_c",
    "name",
]


def gpu_wide(samples: DataFrame, slots: int, column: str = "gpu_info") -> DataFrame:
    """Device array as ``gpu_{i}_*`` columns for ``slots`` devices, plus ``gpu_count``.

    A projection per row: nothing is exploded, pivoted or shuffled. A row with more devices than
    ``slots`` is an error, as the devices beyond would be lost.
    """
    ready = samples.withColumn("__gpus", gpu_defaults(F.coalesce(column, F.array())))
    wide = [
        F.get(F.col("__gpus"), F.lit(i))[f].alias(f"gpu_{i}_{f}")
        for i in range(slots)
        for f in _WIDE_FIELDS
    ]
    count = F.size("__gpus")
    too_many = F.raise_error(F.concat(count.cast("string"), F.lit(f" devices for {slots} slots")))
    return ready.select(
        *samples.columns,
        F.when(count > slots, too_many.cast("int")).otherwise(count).alias("gpu_count"),
        *wide,
    )


def core_slots(samples: DataFrame, column: str = "per_core", slots: int = 4, first: int = 8):
    """Fixed core columns (0 where absent) and the first cores as an array."""
    cores = [
        F.coalesce(F.get(F.col(column), F.lit(i)), F.lit(0.0)).alias(f"cpu_core_{i}")
        for i in range(slots)
    ]
    return samples.select(
        *[c for c in samples.columns if c != column],
        *cores,
        F.slice(column, 1, first).alias("per_core"),
    )


def tall_metrics(df: DataFrame, ids: Sequence[str], metrics: Sequence[tuple[str, str]]) -> DataFrame:
    """(ids, metric, value) rows with namespaced names; missing values are 0."""
    wide = df.select(
        *ids, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for n, c in metrics]
    )
    return wide.unpivot(list(ids), [f"`{n}`" for n, _ in metrics], "metric", "value")


def snapshot_metrics(snapshots: DataFrame, ids: Sequence[str]) -> DataFrame:
    return tall_metrics(snapshots, ids, SNAPSHOT_METRICS)


def resource_metrics(samples: DataFrame, ids: Sequence[str]) -> DataFrame:
    return tall_metrics(samples, ids, RESOURCE_METRICS)


def device_metrics(samples: DataFrame, ids: Sequence[str], column: str = "gpu_info") -> DataFrame:
    """Tall rows of every listed device: utilisation, memory percent and memory GB."""
    each = samples.select(*ids, F.posexplode(gpu_defaults(F.col(column))).alias("i", "g"))
    name = F.concat(F.lit("Resource/GPU"), F.col("i").cast("string"))
    rows = F.array(
        *[
            F.struct(
                F.concat(name, F.lit(suffix)).alias("metric"),
                F.coalesce(value, F.lit(0.0)).alias("value"),
            )
            for suffix, value in (
                ("_Utilization_%", F.col("g.load_percent")),
                ("_Memory_%", F.col("g.memory_percent")),
                ("_Memory_GB", F.col("g.memory_used_mb") / 1024.0),
            )
        ]
    )
    return each.select(*ids, F.inline(rows))


def with_elapsed(df: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Seconds since the run's first row (full precision).

    The start is aggregated and joined back instead of windowed, so a long run is not gathered.
    Rows whose run is null are one run.
    """
    start = df.groupBy(*[F.col(k).alias(f"__of_{k}") for k in keys]).agg(F.min(ts).alias("__start"))
    same = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys]
    return (
        df.join(start, same, "left")
        .withColumn("elapsed_s", F.col(ts) - F.col("__start"))
        .select(*df.columns, "elapsed_s")
    )


def temperature_band(temp: Column) -> Column:
    return (
        F.when(temp < WARM_CELSIUS, F.lit("ok"))
        .when(temp < HOT_CELSIUS, F.lit("warm"))
        .when(temp.isNotNull(), F.lit("hot"))
    )


def return_status(code: Column) -> Column:
    return F.when(code == 0, F.lit("ok")).otherwise(F.lit("failed"))


def metric_peaks(metrics: DataFrame, keys: Sequence[str] = ("run_id", "metric")) -> DataFrame:
    return metrics.groupBy(*keys).agg(F.max("value").alias("max_value"))


def count_by_device(placements: DataFrame, device: str = "device") -> DataFrame:
    """Rows per device in name order, marking those that fell back to the CPU."""
    return (
        placements.groupBy(device)
        .agg(F.count(F.lit(1)).alias("assigned"))
        .withColumn("on_cpu", F.lower(device).contains("cpu"))
        .orderBy(device)
    )


def process_totals(
    samples: DataFrame, name: str, keys: Sequence[str] = ("ts",), main: str = MAIN_COMMAND
) -> DataFrame:
    """Matching processes per sample: count, CPU, resident GB, and the main one's switches."""
    matching = samples.where(F.lower("name").contains(name.lower()))
    is_main = F.col("cmdline").contains(main)
    vol, nonvol = (
        F.coalesce(F.sum(F.when(is_main, F.col(c))), F.lit(0))
        for c in ("vol_switches", "nonvol_switches")
    )
    return matching.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("process_count"),
        F.sum(F.coalesce("cpu_percent", F.lit(0.0))).alias("total_cpu"),
        (F.sum(F.coalesce("rss_bytes", F.lit(0))) / float(1024**3)).alias("total_mem_gb"),
        F.max(F.when(is_main, F.col("pid"))).alias("main_pid"),
        vol.alias("voluntary"),
        nonvol.alias("nonvoluntary"),
        (vol + nonvol).alias("total_switches"),
    )


def switch_counts(events: DataFrame) -> DataFrame:
    """Scheduler switches per (thread, command)."""
    return events.groupBy("tid", "comm").agg(F.count(F.lit(1)).alias("switches"))


def gpu_idle(utils: DataFrame, keys: Sequence[str], value: str = "util") -> DataFrame:
    """100 minus mean utilisation, never below 0; 0 when nothing was measured."""
    return utils.groupBy(*keys).agg(
        F.coalesce(F.greatest(F.lit(0.0), F.lit(100.0) - F.avg(value)), F.lit(0.0)).alias(
            "gpu_idle"
        )
    )


def with_memory_use(df: DataFrame) -> DataFrame:
    """Used bytes from total and available, with guarded percent."""
    used = F.col("total_bytes") - F.col("available_bytes")
    return df.withColumns(
        {
            "used_gb": used / float(1024**3),
            "total_gb": F.col("total_bytes") / float(1024**3),
            "used_mb": used / float(1024**2),
            "used_percent": used_percent(used, F.col("total_bytes")),
        }
    )
