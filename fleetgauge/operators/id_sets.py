"""Sets of whole-number ids as bitmaps: exact distinct counts and intersections that merge.

An id belongs to a bucket of 32,768 ids, and a bucket's ids are one bitmap of 4 KB. Bitmaps are built
before anything is shuffled, so a key costs at most one row per bucket and task however often its ids
repeat, and stored ones answer for any coarser grouping and for further runs. They suit ids that lie close
together, as numbered tasks do; for ids strewn over the whole range of a long, a bitmap holds few of them
and ``count_distinct`` is smaller.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITMAP_IDS = 32_768


def id_bitmaps(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """Keys, bucket, ids: one bitmap per key and bucket. Null ids belong to no set."""
    whole = df.where(F.col(id_col).isNotNull()).select(*keys, F.col(id_col).cast("bigint").alias("__id"))
    placed = whole.select(
        *keys,
        F.floor(F.col("__id") / F.lit(BITMAP_IDS)).cast("bigint").alias("bucket"),
        F.pmod("__id", F.lit(BITMAP_IDS)).cast("bigint").alias("__bit"),
    )
    return placed.groupBy(*keys, "bucket").agg(F.bitmap_construct_agg("__bit").alias("ids"))


def merged_bitmaps(bitmaps: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The sets of finer keys, or of several tables, put together."""
    return bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("ids").alias("ids"))


def common_bitmaps(sides: Sequence[DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """Ids that are in every side; each side has one row at most per key and bucket."""
    union = sides[0].select(*keys, "bucket", "ids")
    for side in sides[1:]:
        union = union.unionByName(side.select(*keys, "bucket", "ids"))
    met = union.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("__n"), F.bitmap_and_agg("ids").alias("ids"))
    return met.where(F.col("__n") == len(sides)).drop("__n")


def set_sizes(bitmaps: DataFrame, keys: Sequence[str] = (), name: str = "ids") -> DataFrame:
    """Number of ids per key; without keys one row, 0 for an empty set."""
    sizes = bitmaps.groupBy(*keys).agg(F.sum(F.bitmap_count("ids")).alias(name))
    return sizes.withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def members(bitmaps: DataFrame, keys: Sequence[str] = (), name: str = "id") -> DataFrame:
    """The ids of sets, one per row, by key."""
    bytes_ = F.sequence(F.lit(0), F.lit(BITMAP_IDS // 8 - 1))
    spread = bitmaps.select(*keys, "bucket", F.hex("ids").alias("__hex"), F.explode(bytes_).alias("__byte"))
    digits = F.substring("__hex", F.col("__byte") * 2 + 1, F.lit(2))
    set_ = spread.where(digits != "00").withColumn("__bits", F.conv(digits, 16, 10).cast("int"))
    each = set_.withColumn("__bit", F.explode(F.sequence(F.lit(0), F.lit(7))))
    on = each.where(F.expr("(shiftright(__bits, __bit) & 1) = 1"))
    number = F.col("bucket") * BITMAP_IDS + F.col("__byte") * 8 + F.col("__bit")
    return on.select(*keys, number.cast("bigint").alias(name))
