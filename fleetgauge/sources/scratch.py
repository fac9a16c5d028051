"""Where intermediate tables and stream checkpoints go.

Executors can be lost, so anything kept between jobs is written to the folder the cluster
shares. The session names it in ``spark.checkpoint.dir``. A private temporary folder stands in for
it only in a single process; on a cluster executors would not see each other's files, so there a
missing setting is an error.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _fallback:
        _fallback.append(tempfile.mkdtemp(prefix="fleetgauge-"))
    return _fallback[0]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other call has been given."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows, written to the shared folder and read back: evaluated once, and cheap to read again."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
