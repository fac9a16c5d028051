"""Row numbers, running sums and previous values per key, without trusting key sizes.

A plain window puts every row of a key into one task, which fails when a single run, agent or task
owns a third of the table. Here rows are dealt by ranges of (key, order) instead, so a key of any
size is cut into consecutive slices of its own order and one plan serves tables of every size:

* ranges hold about ``rows_per_task`` rows at most, whatever the key, as their number follows the
  number of rows;
* the window runs per (key, slice);
* what a slice inherits from the slices before it is one total per (key, slice), carried over by a
  window on those totals and joined back; only keys that were cut have any.

The input is written to the shared folder, so that it is evaluated once, and so are the dealt rows, which
fixes the slices: bounds are sampled, and a second sampling may differ. ``order`` must identify a row within its key; rows that tie on all of it
are not splittable.
"""

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.sources.scratch import stored

_SLICE = "__slice"


@dataclass(frozen=True)
class SliceLimits:
    rows_per_task: int = 2_000_000


DEFAULT_LIMITS = SliceLimits()


def with_ordinal(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "ordinal",
    total: str | None = None,
    limits: SliceLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """1-based position of each row within its key (``keys`` may be empty)."""
    return with_running_sum(df, keys, order, F.lit(1).cast("bigint"), name, total, limits)


def with_running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    total: str | None = None,
    limits: SliceLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """Sum of ``value`` over the key's rows up to and including this one, in ``order``."""
    sliced, keys = _slice(df, keys, order, limits)
    part = [*keys, _SLICE]
    upto = Window.partitionBy(*part).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    per_slice = sliced.groupBy(*part).agg(F.sum(value).alias("__part"))
    by_slice = Window.partitionBy(*keys).orderBy(_SLICE)
    before = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carried = per_slice.select(
        *part,
        F.sum("__part").over(before).alias("__carry"),
        F.sum("__part").over(whole).alias("__all"),
        F.count(F.lit(1)).over(whole).alias("__cuts"),
    ).where("__cuts > 1")
    out = _attach(sliced.withColumn(name, F.sum(value).over(upto)), carried, part)
    if total:
        own = F.sum(value).over(Window.partitionBy(*part))
        out = out.withColumn(total, F.coalesce("__all", own))
    out = out.withColumn(name, F.col(name) + F.coalesce("__carry", F.lit(0)))
    return out.select(*df.columns, name, *([total] if total else []))


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Mapping[str, str],
    limits: SliceLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """Adds ``new`` = value of ``source`` on the row before, for each ``new: source``."""
    sliced, keys = _slice(df, keys, order, limits)
    part = [*keys, _SLICE]
    by_order = Window.partitionBy(*part).orderBy(*order)
    out = sliced.withColumns({n: F.lag(s).over(by_order) for n, s in columns.items()})
    out = out.withColumns(
        {"__first": F.row_number().over(by_order) == 1, "__last": F.lead(F.lit(1)).over(by_order).isNull()}
    )
    held = F.struct(*[F.col(s).alias(f"__{n}") for n, s in columns.items()])
    by_slice = Window.partitionBy(*keys).orderBy(_SLICE)
    carried = out.where("__last").select(*part, F.lag(held).over(by_slice).alias("__carry"))
    out = _attach(out, carried.where("__carry is not null"), part)
    out = out.withColumns(
        {
            n: F.when(F.col("__first"), F.col("__carry")[f"__{n}"]).otherwise(F.col(n))
            for n in columns
        }
    )
    return out.select(*df.columns, *columns)


def first_rows(df: DataFrame, order: Sequence[str], count: int, limits: SliceLimits = DEFAULT_LIMITS) -> DataFrame:
    """The first ``count`` rows in ``order``, of which no task orders more than ``limits.rows_per_task``.

    Rows are dealt by as many ranges as there are shuffle partitions, and ranges are counted. Those before
    the last row stay whole; the one it falls in is dealt anew until it is small, or of one value of the
    order, so the number of tasks follows the logarithm of the rows.
    """
    ranges = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    given, kept = stored(df, "rows"), []
    left = given.count()
    while count > 0 and left > limits.rows_per_task:
        dealt = given.repartitionByRange(ranges, *order).withColumn(_SLICE, F.spark_partition_id())
        dealt = stored(dealt, "slices")
        sizes = sorted((r[_SLICE], r["count"]) for r in dealt.groupBy(_SLICE).count().collect())
        upto, whole = 0, -1
        for at, size in sizes:
            if upto + size > count:
                break
            upto, whole = upto + size, at
        if whole >= 0:
            kept.append(dealt.where(F.col(_SLICE) <= whole).drop(_SLICE))
        count -= upto
        last = next(((at, size) for at, size in sizes if at > whole), (-1, 0))
        given = dealt.where(F.col(_SLICE) == last[0]).drop(_SLICE)
        if last[1] == left:  # one value of the order, or nearly
            break
        left = last[1]
    numbered = with_ordinal(given, [], order, "__place", limits=limits)
    out = numbered.where(F.col("__place") <= count).drop("__place")
    for rows in kept:
        out = out.unionByName(rows)
    return out


def by_rows(df: DataFrame, keys: Sequence[str], limits: SliceLimits = DEFAULT_LIMITS, label: str = "rows") -> DataFrame:
    """The rows, evaluated once and dealt by ``keys`` to as many tasks as their number asks for.

    A twentieth of ``limits.rows_per_task`` is meant for a task, as aggregates and sorts hold several hundred
    bytes a row, which adaptive partitions of some compressed bytes don't bound. Keys should be fine ones.
    """
    given = stored(df, label)
    return given.repartition(max(1, -(-given.count() * 20 // limits.rows_per_task)), *keys)


def _attach(df: DataFrame, small: DataFrame, on: Sequence[str]) -> DataFrame:
    right = small.select(
        *[F.col(c).alias(f"__r_{c}") for c in on],
        *[c for c in small.columns if c not in on],
    )
    same = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on]
    return df.join(right, same, "left").drop(*[f"__r_{c}" for c in on])


def _slice(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], limits: SliceLimits
) -> tuple[DataFrame, list[str]]:
    """The rows with their slice, and the keys, of which there is one at least.

    ``df`` is evaluated once; its rows are counted and their ranges sampled where they are stored.
    """
    spark = df.sparkSession
    if not keys:
        df, keys = df.withColumn("__all_rows", F.lit(0)), ["__all_rows"]
    given = stored(df, "rows")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-given.count() // limits.rows_per_task))
    dealt = given.repartitionByRange(ranges, *keys, *order).withColumn(_SLICE, F.spark_partition_id())
    return stored(dealt, "slices"), list(keys)
