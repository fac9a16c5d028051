"""Writers. Every one lets each task write its own file; nothing is funnelled into one."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.numbers import fixed_point
from fleetgauge.plans.ordered import DEFAULT_LIMITS, SliceLimits, with_ordinal
from fleetgauge.sources import by_key


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def overwrite_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_gzip_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def write_latency_csv(df: DataFrame, path: str, column: str = "latency_s") -> None:
    """One heading and six decimals per value."""
    text = df.select(fixed_point(F.col(column), 6).alias(column))
    text.write.mode("overwrite").option("header", True).csv(path)


def write_text(df: DataFrame, path: str, column: str = "report", by: Sequence[str] = ()) -> None:
    df.select(*by, column).write.mode("overwrite").partitionBy(*by).text(path)


def write_by_key(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """A folder per key value.

    The rebalance hint brings a key's rows together so it has few files, and lets the adaptive
    planner cut a key that outgrows one partition into several and merge small ones.
    """
    root = by_key.mounted(df.sparkSession, path)
    if root:
        by_key.write_json(df, root, by, replace_all=True)
    else:
        df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).json(path)


def replace_by_key(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """As ``write_by_key``, but only the folders of keys that ``df`` has are replaced.

    A rerun of one cell of a sweep leaves the other cells as they are.
    """
    root = by_key.mounted(df.sparkSession, path)
    if root:
        by_key.write_json(df, root, by, replace_all=False)
    else:
        writer = df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*by).json(path)


def summary_documents(
    agents: DataFrame,
    runs: DataFrame,
    keys: Sequence[str] = ("run_id",),
    agents_per_document: int = 10_000,
    limits: SliceLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """Nested run documents with their agents.

    A run larger than ``agents_per_document`` continues in further documents (``part``), so no
    document has to be assembled from an unbounded group. ``runs`` has (num_agents, num_tasks).
    """
    fields = [c for c in agents.columns if c not in keys]
    numbered = with_ordinal(agents, keys, ["agent_id"], "__pos", limits=limits)
    parts = numbered.withColumn(
        "part", F.floor((F.col("__pos") - 1) / agents_per_document).cast("int")
    )
    listed = parts.groupBy(*keys, "part").agg(
        F.sort_array(
            F.collect_list(F.struct("agent_id", *[f"`{c}`" for c in fields if c != "agent_id"]))
        ).alias("agents")
    )
    total = (F.col("num_agents") * F.col("num_tasks")).alias("total_evaluations")
    return runs.join(listed, list(keys), "left").select(
        *keys,
        F.coalesce("part", F.lit(0)).alias("part"),
        "num_agents",
        "num_tasks",
        total,
        F.coalesce("agents", F.array()).alias("agents"),
    )


def comparison_documents(
    phases: DataFrame, keys: Sequence[str] = ("run_id",), order: Sequence[str] = ("runtime_s",)
) -> DataFrame:
    """One document per run with its ``before`` and ``after`` metrics and the time of writing.

    Of several rows of a phase the last by ``order`` is taken.
    """
    fields = [c for c in phases.columns if c not in keys]
    sides = [
        F.max_by(
            F.struct(*fields), F.when(F.col("phase") == side, F.struct(*order))
        ).alias(side)
        for side in ("before", "after")
    ]
    stamped = phases.groupBy(*keys).agg(*sides)
    return stamped.withColumn("timestamp", F.unix_micros(F.current_timestamp()) / 1e6)


def write_documents(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)
