"""Profiler text as ordered lines, and run discovery from folder names."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, paths, name_glob: str | None = None) -> DataFrame:
    """(source_file, ord, line). Files of any size split freely.

    ``ord`` sorts lines: files by name, splits by where they start, lines inside one by row id.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    return reader.text(paths).select(
        F.col("_metadata.file_path").alias("source_file"), _line_order(), F.col("value").alias("line")
    )


def _line_order() -> Column:
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    ).alias("ord")


def read_run_lines(
    spark: SparkSession, root: str, layout: str = "benchmark string, num_agents int", only: Column | None = None
) -> DataFrame:
    """Lines of runs kept in folders named after their columns (``benchmark=x/num_agents=500``).

    The columns of ``layout`` come from the folders. ``only``, a condition on them, opens those folders
    only; a filter afterwards would read all, as it can't pass the numbering of rows.
    ``with_run`` reads other layouts, from whole paths.
    """
    columns = [part.split()[0] for part in layout.split(", ")]
    rows = spark.read.schema(f"value string, {layout}").option("basePath", root).text(root)
    if only is not None:
        rows = rows.where(only)
    return rows.select(*columns, _line_order(), F.col("value").alias("line"))


def with_run(df: DataFrame, path: str = "source_file") -> DataFrame:
    """Run columns from ``<root>/<benchmark>/agents_<N>/<file>`` paths.

    ``agent_id`` comes from ``agent_<id>_results`` file names and ``phase`` from
    ``results_<phase>.json``; parts a path lacks are null.
    """
    p = F.regexp_replace(F.col(path), r"/part-[^/]*$", "")

    def part(pattern: str):
        return F.nullif(F.regexp_extract(p, pattern, 1), F.lit(""))

    return df.withColumns(
        {
            "run_id": part(r"^(.*/agents_[0-9]+)(?:/|$)"),
            "benchmark": part(r"([^/]+)/agents_[0-9]+(?:/|$)"),
            "num_agents": part(r"/agents_([0-9]+)(?:/|$)").try_cast("int"),
            "agent_id": part(r"agent_([0-9]+)_results").try_cast("bigint"),
            "phase": part(r"results_([^/.]+)\.json"),
        }
    )
