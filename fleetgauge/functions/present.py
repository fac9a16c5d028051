"""Report text: human numbers, improvements, sizes, bars, ids, times and JSON."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetgauge.fixed_values import REFLECTION_SEPARATOR
from fleetgauge.functions.numbers import fixed_point, let


def number_or_na(x: Column) -> Column:
    return F.coalesce(fixed_point(x, 3), F.lit("NA"))


def human_number(x: Column, unit: str | Column = "") -> Column:
    suffix = F.lit(unit) if isinstance(unit, str) else unit
    large = x >= 1000
    digits = F.when(large, 1).when(x >= 1, 2).otherwise(3)
    text = F.concat(
        fixed_point(F.when(large, x / 1000.0).otherwise(x), digits),
        F.when(large, F.lit("K")).otherwise(F.lit("")),
    )
    return F.concat(text, suffix)


def change_percent(before: Column, after: Column) -> Column:
    """Signed relative change in percent; null when there is nothing to compare with."""
    return F.when(before != 0, (after - before) / before * 100.0)


def improvement(before: Column, after: Column, higher_is_better: Column) -> Column:
    """Improvement text: ``+`` is better, whatever the metric's direction."""

    def signed(change: Column) -> Column:
        better = F.when(higher_is_better, change > 0).otherwise(change <= 0)
        sign = F.when(better, F.lit("+")).otherwise(
            F.when(higher_is_better, F.lit("")).otherwise(F.lit("-"))
        )
        shown = F.when(higher_is_better, change).otherwise(F.abs(change))
        return F.concat(sign, fixed_point(shown, 1), F.lit("%"))

    change = let(change_percent(before, after), signed)
    return F.when(before == 0, F.lit("N/A")).otherwise(change)


def size_text(gb: Column) -> Column:
    large = gb >= 1024
    number = fixed_point(F.when(large, gb / 1024.0).otherwise(gb), 2)
    return F.concat(number, F.when(large, F.lit("TB")).otherwise(F.lit("GB")))


def progress_bar(value: Column, maximum: Column, width: int = 20) -> Column:
    full, empty = F.lit("█"), F.lit("░")
    share = F.least(value / maximum, F.lit(1.0))
    filled = F.greatest(F.floor(share * width), F.lit(0)).cast("int")
    bar = F.concat(F.repeat(full, filled), F.repeat(empty, F.lit(width) - filled))
    return F.when(maximum == 0, F.concat(F.lit("["), F.repeat(empty, F.lit(width)), F.lit("]"))).otherwise(
        F.concat(F.lit("["), bar, F.lit("] "), fixed_point(value, 1), F.lit("%"))
    )


def padded(x: Column, width: int) -> Column:
    """Left-aligned in ``width`` columns; longer text is kept whole."""
    return F.when(F.length(x) >= width, x).otherwise(F.rpad(x, width, " "))


def reflection_id(task_id: Column, attempt: Column) -> Column:
    return F.concat(task_id, F.lit(REFLECTION_SEPARATOR), attempt.cast("string"))


def reflection_parts(composite: Column) -> tuple[Column, Column]:
    """Base task and last reflection number (null when the id is a plain task)."""
    pattern = rf"^([\s\S]*){REFLECTION_SEPARATOR}([0-9]+)$"
    number = F.regexp_extract(composite, pattern, 2).try_cast("int")
    base = F.when(number.isNotNull(), F.regexp_extract(composite, pattern, 1)).otherwise(composite)
    return base, number


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def to_epoch(ts: Column) -> Column:
    return F.unix_micros(ts) / 1e6


def parse_iso_utc(text: Column) -> Column:
    return F.to_timestamp(text, "yyyy-MM-dd'T'HH:mm:ssX")


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def compact_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")
