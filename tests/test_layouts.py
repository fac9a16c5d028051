"""Folders named after columns: pruned reads, replaced cells; and first rows without one task."""

import os

import pytest
from pyspark.sql import functions as F

from fleetgauge.operators import grid
from fleetgauge.plans.ordered import SliceLimits
from fleetgauge.sources import json_files, sinks, text_files


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_agent_reads_one_folder(spark, tmp_path):
    df = spark.createDataFrame([(k % 5, f"t{k}", f"c{k}") for k in range(50)], "agent_id long, task_id string, completion string")
    root = f"{tmp_path}/completions"
    sinks.write_by_key(df, root, ["agent_id"])
    one = json_files.read_completions_by_agent(spark, root).where("agent_id = 3")
    assert "PartitionFilters: [isnotnull(agent_id" in plan(one).replace("#", "")
    assert one.count() == 10 and len(one.inputFiles()) >= 1
    assert {r.agent_id for r in one.select("agent_id").collect()} == {3}


def test_a_rerun_replaces_its_cell_only(spark, tmp_path):
    root = f"{tmp_path}/runs"
    rows = [(b, n, k) for b in ("x", "y") for n in (500, 1000) for k in range(4)]
    df = spark.createDataFrame(rows, "benchmark string, num_agents int, value long")
    sinks.write_by_key(df, root, ["benchmark", "num_agents"])
    kept = {f: os.path.getmtime(f) for f in _files(root) if "benchmark=x/num_agents=500" not in f}
    sinks.replace_by_key(spark.createDataFrame([("x", 500, 99)], df.schema), root, ["benchmark", "num_agents"])
    got = sorted(map(tuple, spark.read.schema(df.schema).json(root).select(df.columns).collect()))
    assert got == sorted([r for r in rows if r[:2] != ("x", 500)] + [("x", 500, 99)])
    assert all(os.path.getmtime(f) == t for f, t in kept.items()) and len(kept) >= 3


def _files(root):
    return [os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.startswith("part")]


def test_run_lines_come_with_their_columns(spark, tmp_path):
    root = f"{tmp_path}/sweep"
    lines = [("x", 500, f"line {k}") for k in range(30)] + [("y", 1000, "other"), (None, 1000, "unnamed")]
    df = spark.createDataFrame(lines, "benchmark string, num_agents int, line string").coalesce(1)
    sinks.write_text(df, root, "line", ["benchmark", "num_agents"])
    read = text_files.read_run_lines(spark, root)
    assert sorted(map(tuple, read.drop("ord").collect()), key=str) == sorted(lines, key=str)
    only = (F.col("benchmark") == "x") & (F.col("num_agents") == 500)
    one = text_files.read_run_lines(spark, root, only=only)
    assert "PartitionFilters: [isnotnull(benchmark" in plan(one).replace("#", "")
    assert [r.line for r in one.orderBy("ord").collect()] == [f"line {k}" for k in range(30)]


def test_lines_of_several_files_are_ordered_by_file(spark, tmp_path):
    for name in "cab":
        with open(f"{tmp_path}/{name}.txt", "w") as f:
            f.write("".join(f"{name}{k}\n" for k in range(3)))
    got = [r.line for r in text_files.read_lines(spark, str(tmp_path)).orderBy("ord").collect()]
    assert got == [f"{name}{k}" for name in "abc" for k in range(3)]


def test_first_tasks_without_one_task(spark):
    df = spark.range(0, 5000, 1, 4).select((F.col("id") * 7919 % 5000).alias("ordinal"), F.lit("x").alias("prompt"))
    few = grid.first_tasks(df, 100)
    many = grid.first_tasks(df, 2500, limits=SliceLimits(rows_per_task=500))
    for got, n in ((few, 100), (many, 2500)):
        assert sorted(r.ordinal for r in got.collect()) == list(range(n)) and got.columns == df.columns
    assert "SinglePartition" not in plan(many) and "TakeOrdered" not in plan(many)
    assert grid.first_tasks(df, 9999, limits=SliceLimits(rows_per_task=500)).count() == 5000


ODD = "agent_id string, n int, completion string, at timestamp"


def _odd_rows():
    keys = ["a/b", "x=1", "50%", "é 漢", "", None, "..", "q\"'*:?\\{[]^#\n", "plain", " "]
    return [(k, n, f"answer {j}\nline" if j % 3 else None, None) for k in keys for n in (1, None) for j in range(4)]


def _by_spark(df, root, by):
    df.write.mode("overwrite").partitionBy(*by).json(root)


def test_folders_are_those_of_sparks_writer(spark, tmp_path):
    df = spark.createDataFrame(_odd_rows(), ODD).withColumn("at", F.lit("2024-01-02 03:04:05.5").cast("timestamp"))
    roots, by = (f"{tmp_path}/own", f"file:{tmp_path}/spark"), ["agent_id", "n"]
    odd = f"file://{tmp_path}/o%20d [1]{{}}"
    sinks.write_by_key(df, odd, by)
    assert len({os.path.dirname(f) for f in _files(odd[7:])}) == 18
    sinks.write_by_key(df.repartition(3), roots[0], by)
    _by_spark(df, roots[1], by)

    def lines(root):
        found = {}
        for f in _files(root):
            with open(f) as file:
                found.setdefault(os.path.dirname(os.path.relpath(f, root)), []).extend(file.readlines())
        return {k: sorted(v) for k, v in found.items()}

    assert lines(roots[0]) == lines(roots[1][5:]) and len(lines(roots[0])) == 18
    assert all(f.endswith(".json") for f in _files(roots[0]))
    assert not [d for d in os.listdir(roots[0]) if d.startswith("_") and d != "_SUCCESS"]
    back = [spark.read.schema(df.schema).json(root).select(df.columns) for root in roots]
    assert sorted(map(str, back[0].collect())) == sorted(map(str, back[1].collect()))


def test_overwriting_replaces_everything_and_may_read_itself(spark, tmp_path):
    root, by = f"{tmp_path}/runs", ["agent_id"]
    df = spark.createDataFrame([(k % 4, f"v{k}") for k in range(40)], "agent_id long, v string")
    sinks.write_by_key(df, root, by)
    back = spark.read.schema(df.schema).json(root).where("agent_id > 1").select(df.columns)
    sinks.write_by_key(back, root, by)
    assert sorted(map(tuple, spark.read.schema(df.schema).json(root).select(df.columns).collect())) == sorted(
        (k % 4, f"v{k}") for k in range(40) if k % 4 > 1
    )
    sinks.write_by_key(df.where("agent_id > 9"), root, by)
    assert spark.read.schema(df.schema).json(root).count() == 0 and os.listdir(root) == ["_SUCCESS"]


def test_a_failed_write_leaves_the_old_rows(spark, tmp_path):
    root = f"{tmp_path}/runs"
    df = spark.createDataFrame([(k % 4, f"v{k}") for k in range(40)], "agent_id long, v string")
    sinks.write_by_key(df, root, ["agent_id"])
    wrong = df.withColumn("v", F.when(F.col("agent_id") == 3, F.raise_error(F.lit("wrong"))).otherwise(F.col("v")))
    for write in (sinks.write_by_key, sinks.replace_by_key):
        with pytest.raises(Exception, match="wrong"):
            write(wrong, root, ["agent_id"])
        assert spark.read.schema(df.schema).json(root).count() == 40
        assert not [d for d in os.listdir(root) if d.startswith("_staged")]


def test_a_folder_per_key_starts_no_process_per_file(spark, tmp_path):
    """Spark's local client runs chmod for each folder and file and keeps a checksum beside each file."""
    root = f"{tmp_path}/many"
    sinks.write_by_key(spark.range(300).selectExpr("id AS agent_id", "'c' AS completion"), root, ["agent_id"])
    names = [f for _, _, found in os.walk(root) for f in found]
    assert len(_files(root)) == 300 and not [f for f in names if f.endswith(".crc")]


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    root = f"{tmp_path}/many"
    sinks.write_by_key(spark.range(300).selectExpr("id AS agent_id", "'c' AS completion"), root, ["agent_id"])
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    for read in (json_files.read_completions, json_files.read_completions_by_agent):
        group = f"listing {read.__name__}"
        spark.sparkContext.setJobGroup(group, group)
        rows = read(spark, root)
        status = spark.sparkContext.statusTracker()
        stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds]
        assert stages and max(s.numTasks for s in stages) <= 4 * spark.sparkContext.defaultParallelism < 300
        assert rows.count() == 300 and spark.conf.get(name) == before
    spark.sparkContext._jsc.sc().clearJobGroup()


def test_a_replaced_folder_is_written_by_tasks(spark, tmp_path):
    root = f"{tmp_path}/many"
    df = spark.range(300).selectExpr("id AS agent_id", "'c' AS completion")
    sinks.write_by_key(df, root, ["agent_id"])
    sinks.replace_by_key(df.where("agent_id < 100"), root, ["agent_id"])
    names = [f for _, _, found in os.walk(root) for f in found]
    assert len(_files(root)) == 300 and not [f for f in names if f.endswith(".crc")]
