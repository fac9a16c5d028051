"""CSV and whitespace-delimited device samples."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.functions.numbers import tokens
from fleetgauge.schemas import GPU_CSV_FIELDS


def read_header_csv(spark: SparkSession, paths) -> DataFrame:
    return spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(paths)


def utilisation_values(table: DataFrame, ids=(), compat: bool = False) -> DataFrame:
    """(ids, column, util) for every numeric cell of a utilisation column.

    A column counts when its name contains ``util``; ``compat`` also takes names containing
    ``gpu``, which drags device ids into the mean.
    """
    wanted = ("util", "gpu") if compat else ("util",)
    columns = [
        c for c in table.columns if c not in ids and any(w in c.lower() for w in wanted)
    ]
    text = table.select(*ids, *[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    cells = text.unpivot(list(ids), [f"`{c}`" for c in columns], "column", "cell")
    value = F.trim("cell").try_cast("double")
    return cells.select(*ids, "column", value.alias("util")).where(F.col("util").isNotNull())


def parse_gpu_csv(lines: DataFrame, fields: int, keep=()) -> DataFrame:
    """Headerless device lines with 3, 5 or 8 figures.

    Three-figure lines must have exactly three cells, wider ones at least as many as asked. A
    line with a cell that is not a number is dropped whole.
    """
    cells = F.split(F.col("line"), ",")
    enough = F.size(cells) == fields if fields == 3 else F.size(cells) >= fields
    typed = [
        F.trim(F.get(cells, F.lit(i))).try_cast(kind).alias(name)
        for i, (name, kind) in enumerate(GPU_CSV_FIELDS[:fields])
    ]
    rows = lines.where(enough).select(*keep, *typed)
    whole = F.lit(True)
    for name, _ in GPU_CSV_FIELDS[:fields]:
        whole = whole & F.col(name).isNotNull()
    return rows.where(whole)


def parse_dmon(lines: DataFrame, keep=()) -> DataFrame:
    """Device-monitor lines: date, time, device, power, two temperatures and utilisations.

    Lines starting with ``#`` are headings; a dash means the device has no such figure.
    """
    w = tokens(F.col("line"))
    rows = lines.where(~F.ltrim("line").startswith("#")).where(F.size(w) >= 9)

    def figure(i):
        return F.get(w, F.lit(i)).try_cast("double")

    return rows.select(
        *keep,
        w[0].alias("date"),
        w[1].alias("time"),
        w[2].try_cast("int").alias("gpu"),
        figure(3).alias("power_w"),
        figure(4).alias("gpu_temp_c"),
        figure(5).alias("mem_temp_c"),
        figure(6).alias("sm_util"),
        figure(7).alias("mem_util"),
        figure(8).alias("enc_util"),
        figure(9).alias("dec_util"),
    ).where(F.col("gpu").isNotNull())
