"""Profiler text to tidy counters, and the metrics derived from them.

Every parser takes lines with an order column ``ord`` (anything sortable) and run columns, and
keeps one row per useful line; nothing is read whole into a task. Which lines are useful is one
regular expression per format, so the filter looks at the raw line once.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.fixed_values import (
    PERF_SKIPPED_PREFIXES,
    PIDSTAT_SKIPPED_TEXTS,
    STRACE_SKIPPED_PREFIXES,
)
from fleetgauge.functions.numbers import (
    clean_number,
    divide_or,
    first_number,
    rest_of,
    tokens,
)
from fleetgauge.functions.whitespace import NON_WS_CLASS, WS_CLASS
from fleetgauge.operators.telemetry import latest


_WS, _WORD = f"{WS_CLASS}*", f"{NON_WS_CLASS}+"
_GAP = f"{WS_CLASS}+"
_FIGURE = r"[-.,0-9]+%*"


def _either(texts: Sequence[str]) -> str:
    return "|".join(texts)


# A counter line: value (or a note in angle brackets) and event.
PERF_LINE = rf"^{_WS}(?!{_either(PERF_SKIPPED_PREFIXES)})(?:<[^>]*>|{_WORD}){_GAP}{NON_WS_CLASS}"
# A system-call line: at least five words.
STRACE_LINE = rf"^{_WS}(?!{_either(STRACE_SKIPPED_PREFIXES)})(?:{_WORD}{_GAP}){{4}}{NON_WS_CLASS}"
_NO_HEADING = rf"^(?!.*(?:{_either(PIDSTAT_SKIPPED_TEXTS)})){_WS}"
# A process line: clock (and AM/PM), user, pid and at least two figures.
PIDSTAT_LINE = (
    rf"{_NO_HEADING}(?!Average:){_WORD}{_GAP}(?:(?:AM|PM){_GAP})?{_WORD}{_GAP}{_WORD}{_GAP}"
    rf"{_FIGURE}{_GAP}{_FIGURE}(?:{WS_CLASS}|$)"
)
PIDSTAT_ANY_LINE = rf"{_NO_HEADING}{NON_WS_CLASS}"


def words_of(lines: DataFrame, pattern: str, keys: Sequence[str], line: Column | None = None):
    """Words ``w`` of the lines that match."""
    line = F.col("line") if line is None else line
    return lines.where(F.col("line").rlike(pattern)).select(
        *keys, "ord", tokens(line).alias("w")
    )


def perf_counters(lines: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Event, value and annotation; the last line of an event wins.

    ``<not supported>`` and ``<not counted>`` give a null value under the event's own name.
    """
    noted = F.regexp_replace("line", rf"^{_WS}<[^>]*>", "<>")
    w = F.col("w")
    picked = words_of(lines, PERF_LINE, keys, noted).select(
        *keys,
        "ord",
        w[1].alias("event"),
        clean_number(w[0]).alias("value"),
        rest_of(w, 3).alias("annotation"),
    )
    return latest(picked, [*keys, "event"], ["ord"]).drop("ord")


def syscall_rows(lines: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Typed rows of a system-call summary; the closing total row is marked."""
    w = F.col("w")
    short = F.size(w) == 5
    syscall = F.when(short, w[4]).otherwise(F.get(w, F.lit(5)))
    return words_of(lines, STRACE_LINE, keys).select(
        *keys,
        "ord",
        syscall.alias("syscall"),
        clean_number(w[0]).alias("percent_time"),
        clean_number(w[1]).alias("seconds"),
        clean_number(w[2]).alias("usecs_per_call"),
        clean_number(w[3]).cast("bigint").alias("calls"),
        F.when(short, F.lit(0)).otherwise(clean_number(w[4])).cast("bigint").alias("errors"),
        (syscall == "total").alias("is_total"),
    )


def pidstat_samples(
    lines: DataFrame, keys: Sequence[str] = ("run_id",), compat: bool = False
) -> DataFrame:
    """Voluntary and involuntary switches per second and CPU percent, one row per line.

    A row describes its own layout: after the clock (and AM/PM) come either user, pid and the two
    switch rates, or user, pid and five or six CPU figures ending in total percent and core.
    Averages are skipped. ``compat`` reads the fourth and fifth word of every line instead, for
    both switches and CPU.
    """
    w = F.col("w")
    if compat:
        fourth, fifth = F.get(w, F.lit(3)), F.get(w, F.lit(4)).try_cast("double")
        both = fourth.rlike(r"^[.0-9]*[0-9][.0-9]*$") & fifth.isNotNull()
        return words_of(lines, PIDSTAT_ANY_LINE, keys).select(
            *keys,
            "ord",
            F.when(both, fourth.try_cast("double")).alias("cswch"),
            F.when(both, fifth).alias("nvcswch"),
            F.when(
                fourth.rlike(r"^[.%0-9]*[0-9][.%0-9]*$"),
                F.regexp_replace(fourth, "%", "").try_cast("double"),
            ).alias("cpu"),
        )
    clock = F.when(w[1].isin("AM", "PM"), 2).otherwise(1)
    placed = words_of(lines, PIDSTAT_LINE, keys).select(
        *keys, "ord", F.slice("w", clock + 1, F.size("w")).alias("w")
    )

    def figure(i: int) -> Column:
        return clean_number(F.get(w, F.lit(i)))

    switching = figure(4).isNull() | (F.size(w) == 5)
    # Older releases report no %wait, which puts total CPU one word earlier.
    total_cpu = F.when(figure(7).isNotNull(), figure(6)).otherwise(figure(5))
    return placed.select(
        *keys,
        "ord",
        F.when(switching, figure(2)).alias("cswch"),
        F.when(switching, figure(3)).alias("nvcswch"),
        F.when(~switching, total_cpu).alias("cpu"),
    )


def pidstat_metrics(samples: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Mean rates per run; the total is the sum of the two means."""
    zero = F.lit(0.0)
    vol, non = F.coalesce(F.avg("cswch"), zero), F.coalesce(F.avg("nvcswch"), zero)
    return samples.groupBy(*keys).agg(
        (vol + non).alias("context_switches_per_sec"),
        F.coalesce(F.avg("cpu"), zero).alias("cpu_util"),
        vol.alias("voluntary_cswch"),
        non.alias("nonvoluntary_cswch"),
    )


def histogram_rows(lines: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Buckets ``lo -> hi : n`` or ``lo-hi : n`` and, apart, lines that state an average."""
    line = F.col("line")
    pattern = r"^\s*[0-9]+(?:\s*(?:->|-)\s*[0-9]+)?\s*:\s*[0-9]+\s*(?:\|.*)?$"
    says_avg = F.lower(line).contains("avg") | F.lower(line).contains("average")
    judged = lines.select(*keys, "ord", "line", line.rlike(pattern).alias("__bucket"))
    # A bucket line has two or three numbers before its bar; they are picked out once.
    figures = F.when(
        F.col("__bucket"), F.regexp_extract_all(F.substring_index(line, "|", 1), F.lit("[0-9]+"), F.lit(0))
    )
    useful = judged.where(F.col("__bucket") | says_avg).withColumn("__n", figures)
    n = F.col("__n")
    return useful.select(
        *keys,
        "ord",
        F.get(n, F.lit(0)).try_cast("double").alias("low"),
        F.get(n, F.when(F.size(n) == 3, F.lit(1)).otherwise(F.lit(0))).try_cast("double").alias("high"),
        F.get(n, F.size(n) - 1).try_cast("double").cast("bigint").alias("count"),
        F.when(~F.col("__bucket"), first_number(line)).alias("stated_avg"),
    )


def histogram_mean(
    buckets: DataFrame, keys: Sequence[str] = ("run_id",), compat: bool = False
) -> DataFrame:
    """Weighted mean of bucket midpoints, else the first stated average, else 0.

    ``compat`` ignores the buckets.
    """
    mid = (F.col("low") + F.col("high")) / 2.0
    stated = F.min_by("stated_avg", F.when(F.col("stated_avg").isNotNull(), F.col("ord")))
    weighted = F.when(
        F.sum("count") > 0, F.sum(mid * F.col("count")) / F.sum("count")
    )
    value = F.coalesce(stated, F.lit(0.0)) if compat else F.coalesce(weighted, stated, F.lit(0.0))
    return buckets.groupBy(*keys).agg(value.alias("avg_sched_latency_us"))


def weighted_mean(
    buckets: DataFrame, keys: Sequence[str], low: str = "low", high: str = "high", n: str = "count"
) -> DataFrame:
    mid = (F.col(low) + F.col(high)) / 2.0
    return buckets.groupBy(*keys).agg(
        F.sum(n).alias("samples"),
        divide_or(F.sum(mid * F.col(n)), F.sum(n)).alias("weighted_mean"),
    )


def phase_metrics(
    logs: DataFrame,
    pidstat: DataFrame,
    histogram: DataFrame,
    keys: Sequence[str] = ("run_id", "phase"),
) -> DataFrame:
    """One wide row per (run, phase); a tool that left nothing contributes zeros."""
    joined = logs.join(pidstat, list(keys), "left").join(histogram, list(keys), "left")
    added = [
        c for c in [*pidstat.columns, *histogram.columns] if c not in keys
    ]
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in added})


_CELL = ("benchmark", "num_agents")


def sweep_index(
    summaries: DataFrame,
    counters: DataFrame,
    syscalls: DataFrame,
    keys: Sequence[str] = _CELL,
) -> DataFrame:
    """All cells of a sweep as (cell, section, name, value) rows.

    A cell's system summary, perf counters and system calls come together by union, so no
    cell is gathered into one nested row.
    """
    measures = [c for c in summaries.columns if c not in keys]
    system = summaries.select(
        *keys, *[F.col(c).cast("double").alias(c) for c in measures]
    ).unpivot(list(keys), measures, "name", "value")
    perf = counters.select(*keys, F.col("event").alias("name"), "value")
    calls = syscalls.select(
        *keys, F.col("syscall").alias("name"), F.col("calls").cast("double").alias("value"), "is_total"
    )
    parts = [
        part.withColumn("section", F.lit(section))
        for section, part in (("system", system), ("perf", perf), ("strace", calls))
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2], allowMissingColumns=True)
    # The closing total line is dropped after the aggregation: a filter before it would make the
    # parser split every line twice.
    return (
        rows.groupBy(*keys, "section", "name")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("value").alias("value"),
            F.count_if(F.coalesce("is_total", F.lit(False))).alias("__totals"),
        )
        .where(F.col("__totals") == 0)
        .drop("__totals")
    )
