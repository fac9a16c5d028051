"""JSON and JSONL scans with fixed schemas."""

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge import schemas
from fleetgauge.functions.whitespace import strip

_CORRUPT = "_corrupt_record"


def read_jsonl_strict(spark: SparkSession, paths, schema: T.StructType) -> DataFrame:
    """Blank lines give no row; a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


def with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])


def parse_jsonl(lines: DataFrame, schema: T.StructType, keep=(), column: str = "line") -> DataFrame:
    """Text lines as rows; malformed lines and lines that are not objects keep their text in
    ``_corrupt_record``. Blank lines give no row."""
    text = strip(F.col(column))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    parsed = lines.where(text != "").select(
        *keep, F.from_json(text, with_corrupt(schema), options).alias("__r"), text.alias("__t")
    )
    row = F.col("__r")
    bad = F.when(~F.col("__t").startswith("{"), F.col("__t")).otherwise(row[_CORRUPT])
    return parsed.select(
        *keep, *[row.getField(f.name).alias(f.name) for f in schema.fields], bad.alias(_CORRUPT)
    )


def read_jsonl_marked(spark: SparkSession, paths, schema: T.StructType) -> DataFrame:
    """Every line, malformed ones with their text in ``_corrupt_record``."""
    return parse_jsonl(spark.read.text(paths), schema, column="value")


def read_jsonl_lenient(spark: SparkSession, paths, schema: T.StructType) -> DataFrame:
    """Malformed lines are skipped and a missing path is an empty table."""
    wanted: Sequence[str] = [paths] if isinstance(paths, str) else list(paths)
    found = spark.createDataFrame([], "value STRING")
    for path in wanted:
        try:
            found = found.unionByName(spark.read.text(path))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    rows = parse_jsonl(found, schema, column="value")
    return rows.where(F.col(_CORRUPT).isNull()).drop(_CORRUPT)


@contextmanager
def _few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by four tasks a core, where Spark would start one for each of up to 10,000 folders."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, tasks = int(spark.conf.get(name)), 4 * spark.sparkContext.defaultParallelism
    spark.conf.set(name, min(before, tasks))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read_completions(spark: SparkSession, paths) -> DataFrame:
    """Completion rows; the agent id comes from the file name or the partition folder."""
    with _few_listing_tasks(spark):
        rows = spark.read.schema(schemas.COMPLETION).option("recursiveFileLookup", True).json(paths)
    path = F.col("_metadata.file_path")
    agent = F.coalesce(
        F.nullif(F.regexp_extract(path, r"agent_([0-9]+)_results", 1), F.lit("")),
        F.nullif(F.regexp_extract(path, r"agent_id=([0-9]+)/", 1), F.lit("")),
    )
    return rows.select("*", agent.try_cast("bigint").alias("agent_id"))


def read_completions_by_agent(spark: SparkSession, root: str) -> DataFrame:
    """Completion rows below ``root/agent_id=<id>``; a filter on agent_id opens those folders only."""
    schema = T.StructType([*schemas.COMPLETION.fields, T.StructField("agent_id", T.LongType())])
    with _few_listing_tasks(spark):
        return spark.read.schema(schema).option("basePath", root).json(root)


def read_problems(spark: SparkSession, paths) -> DataFrame:
    """Problem set (plain or gzip JSONL) with ``ordinal``, the file order."""
    rows = spark.read.schema(schemas.PROBLEM).json(paths)
    return rows.withColumn(
        "ordinal",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ),
    )


def read_scores(spark: SparkSession, paths) -> DataFrame:
    """Score documents (one object per file, possibly spread over lines)."""
    rows = spark.read.schema(schemas.SCORE).option("multiLine", True).json(paths)
    zero = F.lit(0.0)
    return rows.select(
        F.col("_metadata.file_path").alias("source_file"),
        F.coalesce("`pass@1`", zero).alias("pass@1"),
        F.coalesce("total", F.lit(0)).cast("bigint").alias("total"),
        F.coalesce("num_agents", F.lit(0)).cast("bigint").alias("num_agents"),
        F.coalesce("avg_latency_s", zero).alias("avg_latency_s"),
        F.coalesce("avg_throughput_rps", zero).alias("avg_throughput_rps"),
    )


def read_agent_summaries(spark: SparkSession, paths, multi_line: bool = True) -> DataFrame:
    """Run summary documents with their agents, one row per agent.

    A document without agents gives no row. Documents written in parts read the same.
    """
    rows = (
        spark.read.schema(schemas.RUN_SUMMARY_DOC).option("multiLine", multi_line).json(paths)
    )
    return rows.select(
        F.col("_metadata.file_path").alias("source_file"),
        "num_agents",
        "num_tasks",
        "total_evaluations",
        F.inline("agents"),
    )


def read_trace_events(spark: SparkSession, paths) -> DataFrame:
    return read_jsonl_lenient(spark, paths, schemas.TRACE_EVENT)
