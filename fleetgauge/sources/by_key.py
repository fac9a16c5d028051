"""A folder per key value, written by tasks on a file system that every machine mounts.

Spark's client for such folders starts a process for the rights of each folder and file, some ten
milliseconds apiece, and the driver then renames one folder after another. With a folder per key both
outweigh the rows. Here tasks write the files themselves, under names no other attempt has, list what they
wrote, and move it once the list is complete; the list of a failed attempt is never kept.
"""

import os
import re
import shutil
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
#: What Spark escapes in the names of partition folders, besides control characters.
_ESCAPED = "\"#%'*/:=?\\{[]^\x7f"


def mounted(spark: SparkSession, path: str) -> str | None:
    """The folder as the operating system knows it, or None where Spark reaches it through another client."""
    if named := re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(//[^/]*)?(/.*)", path, re.DOTALL):
        scheme, host, folder = named.groups()
        return folder.rstrip("/") or "/" if scheme == "file" and host in (None, "//") else None
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return os.path.abspath(path) if default.startswith("file:") else None


def _folder(names: Sequence[str], values: Sequence[str | None]) -> str:
    def plain(text: str) -> str:
        return "".join(f"%{ord(c):02X}" if c in _ESCAPED or c < " " else c for c in text)

    return "/".join(f"{plain(n)}={plain(v) if v else _NO_VALUE}" for n, v in zip(names, values))


def _staged(rows: DataFrame, by: Sequence[str], stage: str) -> DataFrame:
    """folder, file: what the tasks wrote, each file below ``stage`` and one a key and task."""
    names = list(by)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A name of its own for each attempt: one that fails or is overtaken leaves files that no list has.
        attempt, files, key, out = uuid.uuid4().hex, 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            lines = batch.column(len(names)).cast(pa.large_binary())
            ends = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
            data = memoryview(lines.buffers()[2])
            last = np.zeros(len(lines), bool)
            last[-1] = True
            for i in range(len(names)):
                column = batch.column(i)
                differs = pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False)
                both_null = pc.and_(pc.is_null(column[1:]), pc.is_null(column[:-1])).to_numpy(zero_copy_only=False)
                last[:-1] |= differs & ~both_null
            start, written = 0, []
            for end in (np.flatnonzero(last) + 1).tolist():
                found = tuple(batch.column(i)[start].as_py() for i in range(len(names)))
                if out is None or found != key:
                    if out is not None:
                        out.close()
                    os.makedirs(f"{stage}/{attempt}", exist_ok=True)
                    files += 1
                    key, file = found, f"{attempt}/{files}"
                    out = open(f"{stage}/{file}", "xb")
                    written.append((_folder(names, key), file))
                out.write(data[ends[start] : ends[end]])
                start = end
            if written:
                folders, paths = map(list, zip(*written))
                yield pa.record_batch([pa.array(folders), pa.array(paths)], names=["folder", "file"])
        if out is not None:
            out.close()

    return rows.mapInArrow(write, "folder string, file string")


def write_json(df: DataFrame, root: str, by: Sequence[str], replace_all: bool) -> None:
    """As Spark's JSON writer with ``partitionBy``; ``replace_all``: all of ``root``, else the folders of ``df``'s keys.

    ``root`` is as ``mounted`` gives it. Rows are written first, old folders go then, and the new files are
    moved in by tasks, which may run again. Readers pass over the stage, whose name begins with ``_``.
    """
    spark, stage = df.sparkSession, f"{root}/_staged-{uuid.uuid4().hex}"
    values = [c for c in df.columns if c not in by]
    line = F.concat(F.to_json(F.struct(*[F.col(f"`{c}`") for c in values])), F.lit("\n"))
    names = [f"key{i}" for i in range(len(by))]
    keys = [F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(by, names)]
    os.makedirs(stage)
    try:
        rows = df.hint("rebalance", *by).select(*keys, line.alias("line")).sortWithinPartitions(*names)
        written = _staged(rows, by, stage)
        written.write.parquet(f"file:{stage}/listed")
        plain = re.sub(r"([\\*?{}\[\]])", r"\\\1", stage)
        listed = spark.read.schema(written.schema).parquet(f"file:{plain}/listed")
        if replace_all:
            for entry in os.scandir(root):
                if entry.path != stage:
                    shutil.rmtree(entry.path) if entry.is_dir(follow_symlinks=False) else os.remove(entry.path)
        else:

            def clear(rows):
                for row in rows:
                    shutil.rmtree(f"{root}/{row.folder}", ignore_errors=True)

            listed.select("folder").distinct().foreachPartition(clear)

        def move(rows):
            for row in rows:
                source, goal = f"{stage}/{row.file}", f"{root}/{row.folder}/part-{row.file.replace('/', '-')}.json"
                os.makedirs(os.path.dirname(goal), exist_ok=True)
                try:
                    os.rename(source, goal)
                except FileNotFoundError:
                    if not os.path.exists(goal):  # else an earlier attempt has moved it
                        raise

        listed.foreachPartition(move)
    finally:
        shutil.rmtree(stage, ignore_errors=True)
    open(f"{root}/_SUCCESS", "wb").close()
    spark.catalog.refreshByPath(root)
