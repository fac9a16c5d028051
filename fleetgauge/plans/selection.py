"""Values at exact ranks without sorting a table.

A sketch per key, merged from all tasks, says between which two values a wanted rank lies for all but
certain. One more pass counts what is below that bracket and keeps only the values inside, a small share
of the rows, collapsed to (value, copies). Counting tells for certain whether a rank was met; keys where it
wasn't are searched again between their least and largest value. So neither all values nor all
distinct values are shuffled, and no key's values meet in one task beyond a stated number: what is inside a
bracket is windowed by key and bracket where that is small, and dealt by ranges where it isn't.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.plans.ordered import DEFAULT_LIMITS, SliceLimits, with_running_sum
from fleetgauge.sources.scratch import stored

#: Size of a sketch's levels, and the share of ranks by which a bracket is wider on both sides.
SKETCH_SIZE, MARGIN = 800, 0.01


Ranks = Mapping[str, tuple[float, Column]]
_WHOLE = "whole"


def _tag(share: float) -> str:
    return f"at {share}"


def _brackets(ranks: Ranks, wide: bool) -> Column:
    """Array of (name, from, to): one for each share, or one of all values where these are few."""

    def quantile(at: float) -> Column:
        return F.kll_sketch_get_quantile_double("__sketch", F.lit(min(max(at, 0.0), 1.0)))

    def bracket(name: str, low: Column, high: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), low.alias("from"), high.alias("to"))

    whole = F.array(bracket(_WHOLE, F.col("__least"), F.col("__most")))
    if wide:
        return whole
    shares = sorted({share for share, _ in ranks.values()})
    each = [bracket(_tag(x), quantile(x - MARGIN), quantile(x + MARGIN)) for x in shares]
    return F.when(F.col("__real") <= SKETCH_SIZE, whole).otherwise(F.array(*each))


def _search(
    values: DataFrame, sketches: DataFrame, keys: Sequence[str], ranks: Ranks, wide: bool, limits: SliceLimits
) -> DataFrame:
    """Keys, the value at each rank, and whether any bracket missed its rank."""
    v = F.col("__v")
    # A row counts below a bracket (null) or stands inside it; rows above it end here.
    hits = F.transform(
        "__brackets",
        lambda b: F.when(v <= b["to"], F.struct(b["name"].alias("__name"), F.when(v >= b["from"], v).alias("__at"))),
    )
    right = sketches.select(*[F.col(k).alias(f"__r_{k}") for k in keys], "n", _brackets(ranks, wide).alias("__brackets"))
    same = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys] or [F.lit(True)]
    met = values.join(right, same).select(*keys, "n", F.inline(F.filter(hits, lambda h: h.isNotNull())))
    group = [*keys, "n", "__name"]
    counted = stored(met.groupBy(*group, "__at").agg(F.count(F.lit(1)).alias("__c")), "inside-brackets")
    small = counted.count() <= limits.rows_per_task
    if small or counted.groupBy(*group).count().agg(F.max("count")).first()[0] <= limits.rows_per_task:
        upto = F.sum("__c").over(Window.partitionBy(*group).orderBy(F.asc_nulls_first("__at")))
        running = counted.withColumn("__upto", upto)
    else:
        running = with_running_sum(counted, group, ["__at"], F.col("__c"), "__upto", limits=limits)
    columns, missed = [], F.lit(False)
    for name, (share, rank) in ranks.items():
        own = F.col("__name").isin(_tag(share), _WHOLE)
        columns.append(F.min(F.when(own & (F.col("__upto") >= rank), F.col("__at"))).alias(name))
        below = F.coalesce(F.sum(F.when(own & F.col("__at").isNull(), F.col("__c"))), F.lit(0))
        columns.append((below >= rank).alias(f"__below_{name}"))
        missed = missed | F.col(f"__below_{name}") | F.col(name).isNull()
    found = running.groupBy(*keys, "n").agg(*columns)
    return stored(found.select(*keys, *ranks, missed.alias("__missed")), "found-ranks")


def _matched(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    other = right.select(*[F.col(c).alias(f"__j_{c}") for c in on], *[c for c in right.columns if c not in on])
    same = [F.col(c).eqNullSafe(F.col(f"__j_{c}")) for c in on] or [F.lit(True)]
    return left.join(other, same, how).drop(*[f"__j_{c}" for c in on])


def values_at_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    ranks: Ranks,
    aggregates: Sequence[Column] = (),
    limits: SliceLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """Per key ``n``, the further ``aggregates``, and the value at each named rank.

    ``ranks`` gives the share of rows at about which a rank lies, and the rank itself, from 1, as an
    expression of column ``n``. ``value`` is a double; nulls take no part and NaN is the largest. Without
    keys there is one row, if there is any value. ``df`` is evaluated twice, for the sketches and for the
    brackets.
    """
    keys = list(keys)
    given = df.withColumn("__v", value.cast("double")).where(F.col("__v").isNotNull())
    sketches = stored(
        given.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(~F.isnan("__v")).alias("__real"),
            F.min("__v").alias("__least"),
            F.max("__v").alias("__most"),
            F.kll_sketch_agg_double(F.nanvl("__v", F.lit(None)), F.lit(SKETCH_SIZE)).alias("__sketch"),
            *aggregates,
        ),
        "rank-sketches",
    ).where("n > 0")
    values = given.select(*keys, "__v")
    found = _search(values, sketches, keys, ranks, False, limits)
    again = found.where("__missed")
    if not again.isEmpty():
        missing = _matched(sketches, again.select(*keys, "__missed"), keys, "inner").drop("__missed")
        found = found.where(~F.col("__missed")).unionByName(_search(values, missing, keys, ranks, True, limits))
    shown = sketches.select(*[c for c in sketches.columns if not c.startswith("__")])
    return _matched(shown, found.drop("__missed"), keys, "inner")
