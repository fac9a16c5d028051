"""Before/after comparison of phase metrics."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.fixed_values import (
    COMPARED_METRICS,
    REPORT_CHANGE_HEADING,
    REPORT_COLUMN_WIDTHS,
    REPORT_TITLE,
    REPORT_WIDTH,
)
from fleetgauge.functions.present import change_percent, human_number, improvement, padded


def paired_phases(phases: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """(keys, metric, before, after) rows from wide rows per phase.

    One hash aggregation over the wide rows pairs the phases; only its result, one row per run,
    is turned into metric rows.
    """
    columns = [c for _, c, _, _, _ in COMPARED_METRICS]
    sides = [
        F.max(F.when(F.col("phase") == phase, F.coalesce(F.col(c), F.lit(0.0)))).alias(
            f"{phase}__{c}"
        )
        for c in columns
        for phase in ("before", "after")
    ]
    wide = phases.groupBy(*keys).agg(*sides)
    rows = F.array(
        *[
            F.struct(
                F.lit(position).alias("position"),
                F.lit(name).alias("metric"),
                F.lit(unit).alias("unit"),
                F.lit(higher).alias("higher_is_better"),
                F.lit(always).alias("__always"),
                F.coalesce(F.col(f"before__{c}"), F.lit(0.0)).alias("before"),
                F.coalesce(F.col(f"after__{c}"), F.lit(0.0)).alias("after"),
            )
            for position, (name, c, unit, higher, always) in enumerate(COMPARED_METRICS, 1)
        ]
    )
    tall = wide.select(*keys, F.inline(rows))
    shown = F.col("__always") | (F.col("before") > 0) | (F.col("after") > 0)
    return tall.where(shown).drop("__always")


def comparison_table(
    phases: DataFrame, keys: Sequence[str] = ("run_id",), whole_successes: bool = True
) -> DataFrame:
    """Paired metrics with formatted values, numeric change and improvement text."""
    paired = paired_phases(phases, keys)
    before, after = F.col("before"), F.col("after")
    as_count = (F.col("metric") == "successes") & F.lit(whole_successes)

    def shown(x):
        return F.when(as_count, x.cast("bigint").cast("string")).otherwise(
            human_number(x, F.col("unit"))
        )

    return paired.select(
        *keys,
        "position",
        "metric",
        "before",
        "after",
        shown(before).alias("before_text"),
        shown(after).alias("after_text"),
        change_percent(before, after).alias("change_percent"),
        improvement(before, after, F.col("higher_is_better")).alias("improvement"),
    )


def report_text(table: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """One report text per run (a run has at most as many lines as there are metrics)."""
    widths = REPORT_COLUMN_WIDTHS
    row = F.concat_ws(
        " ",
        *[
            padded(F.col(c), width)
            for c, width in zip(("metric", "before_text", "after_text", "improvement"), widths)
        ],
    )
    heading = " ".join(
        text.ljust(width)
        for text, width in zip(("Metric", "Before", "After", REPORT_CHANGE_HEADING), widths)
    )
    double, single = "=" * REPORT_WIDTH, "-" * REPORT_WIDTH
    top = "\n".join([double, REPORT_TITLE, double, "", heading, single, ""])
    lines = F.transform(
        F.sort_array(F.collect_list(F.struct("position", row.alias("text")))), lambda r: r["text"]
    )
    return table.groupBy(*keys).agg(
        F.concat(
            F.lit(top), F.array_join(lines, "\n"), F.lit(f"\n{single}\n")
        ).alias("report")
    )
