"""A streaming source that follows files which grow: every line that is appended comes once.

Spark's own file source lists a path once and never again. Loggers append to one file per run instead, so
this source keeps, beside the query's checkpoint, a log of the byte ranges that were seen to be new. A
version of the log is one listing's ranges, and a stream's offset is no more than the number of a version:
Spark commits it with the batch, and a batch that is run again reads the same ranges. A line belongs to
the range that holds its line end, so a line that is half written waits for its rest, and ranges can be
cut anywhere. Ranges are cut to ``piece_bytes`` and small ones share a task.

Files are listed by the driver and read by tasks through Arrow's file systems: local or mounted paths,
HDFS, S3, GCS and Azure.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from fleetgauge.sources.json_files import parse_jsonl

LINES = T.StructType(
    [
        T.StructField("source_file", T.StringType()),
        T.StructField("line_end", T.LongType()),
        T.StructField("line", T.StringType()),
    ]
)
_ARROW = pa.schema([("source_file", pa.string()), ("line_end", pa.int64()), ("line", pa.string())])
_LOOK_BACK, _ROWS = 1 << 16, 10_000


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + posixpath.abspath(uri))


class RangeLog:
    """Versions of new byte ranges, with a snapshot of all lengths now and then.

    Version k is a file of its own, renamed into place when it is whole. Reading the log starts at the
    newest snapshot, so it opens at most ``snapshot_every`` versions; those that are committed and older
    than a snapshot are deleted.
    """

    def __init__(self, uri: str, snapshot_every: int = 50):
        self.files, self.path = _opened(uri)
        self.snapshot_every = snapshot_every
        self.files.create_dir(self.path, recursive=True)
        names = [posixpath.basename(i.path) for i in self.files.get_file_info(fs.FileSelector(self.path))]
        numbers = {
            kind: sorted(int(n[len(kind) + 1 :]) for n in names if n.startswith(kind + "-")) for kind in ("ranges", "lengths")
        }
        self.snapshot = max(numbers["lengths"], default=0)
        self.version = max([self.snapshot, *numbers["ranges"]])
        self.oldest = min(numbers["ranges"], default=self.version + 1)
        self.lengths: dict[str, int] = dict(self._read("lengths", self.snapshot)) if self.snapshot else {}
        for version in range(self.snapshot + 1, self.version + 1):
            self.lengths.update((path, to) for path, _, to in self.ranges(version))

    def _name(self, kind: str, version: int) -> str:
        return f"{self.path}/{kind}-{version:012d}"

    def _read(self, kind: str, version: int) -> list:
        with self.files.open_input_stream(self._name(kind, version)) as f:
            return [json.loads(line) for line in f.read().splitlines()]

    def _write(self, kind: str, version: int, rows: list) -> None:
        made = f"{self.path}/making-{kind}-{version:012d}"
        with self.files.open_output_stream(made) as f:
            f.write("".join(json.dumps(r) + "\n" for r in rows).encode())
        self.files.move(made, self._name(kind, version))

    def ranges(self, version: int) -> list[tuple[str, int, int]]:
        return [tuple(r) for r in self._read("ranges", version)]

    def add(self, ranges: list[tuple[str, int, int]]) -> int:
        self._write("ranges", self.version + 1, ranges)
        self.version += 1
        self.lengths.update((path, to) for path, _, to in ranges)
        if self.version % self.snapshot_every == 0:
            self._write("lengths", self.version, sorted(self.lengths.items()))
            self.snapshot = self.version
        return self.version

    def forget(self, committed: int) -> None:
        """Drops versions that no batch will ask for again and no restart reads."""
        while self.oldest <= min(committed, self.snapshot):
            self.files.delete_file(self._name("ranges", self.oldest))
            self.oldest += 1


@dataclass
class Pieces(InputPartition):
    ranges: list[tuple[str, int, int]]


def packed(ranges: Iterator[tuple[str, int, int]], piece_bytes: int, most: int = 1000) -> list[Pieces]:
    """Ranges cut to ``piece_bytes``, small ones together up to that size or ``most`` of them."""
    found, held, size = [], [], 0
    for path, start, end in ranges:
        for at in range(start, end, piece_bytes):
            to = min(at + piece_bytes, end)
            if held and (size + to - at > piece_bytes or len(held) == most):
                found.append(Pieces(held))
                held, size = [], 0
            held.append((path, at, to))
            size += to - at
    return [*found, Pieces(held)] if held else found


def lines_of(file, start: int, end: int) -> tuple[int, list[bytes]]:
    """Where the first line begins whose end lies in the range, and all such lines without their ends."""
    tail, begin = b"", start
    while begin > 0:
        step = min(_LOOK_BACK, begin)
        block = file.read_at(step, begin - step)
        cut = block.rfind(b"\n")
        if cut >= 0:
            tail, begin = block[cut + 1 :] + tail, begin - step + cut + 1
            break
        tail, begin = block + tail, begin - step
    data = tail + file.read_at(end - start, start)
    return begin, data.split(b"\n")[:-1]


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.log_path = options["path"], options["log"]
        self.glob = options.get("glob", "*")
        self.piece_bytes = int(options.get("piecebytes", 64 << 20))
        self.restart = options.get("shorter", "fail") == "restart"
        self._log: RangeLog | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_log": None}

    @property
    def log(self) -> RangeLog:
        if self._log is None:
            self._log = RangeLog(self.log_path)
        return self._log

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        files, path = _opened(self.folder)
        new = []
        for info in files.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)):
            name = info.base_name
            if not info.is_file or name[0] in "._" or not fnmatch(name, self.glob):
                continue
            known = self.log.lengths.get(info.path, 0)
            if info.size < known:
                if not self.restart:
                    raise ValueError(f"{info.path} was followed to byte {known} and has {info.size} bytes")
                known = 0
                if not info.size:
                    new.append((info.path, 0, 0))
            if info.size > known:
                new.append((info.path, known, info.size))
        return {"version": self.log.add(sorted(new)) if new else self.log.version}

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        versions = range(start["version"] + 1, end["version"] + 1)
        return packed((r for v in versions for r in self.log.ranges(v)), self.piece_bytes)

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        files, _ = _opened(self.folder)
        for path, start, end in partition.ranges:
            with files.open_input_file(path) as file:
                at, lines = lines_of(file, start, end)
            for k in range(0, len(lines), _ROWS):
                some = lines[k : k + _ROWS]
                ends = []
                for line in some:
                    at += len(line) + 1
                    ends.append(at)
                text = [line.removesuffix(b"\r").decode("utf-8", "replace") for line in some]
                yield pa.record_batch([pa.array([path] * len(some)), pa.array(ends), pa.array(text)], schema=_ARROW)

    def commit(self, end: dict) -> None:
        self.log.forget(end["version"])


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> T.StructType:
        return LINES

    def streamReader(self, schema: T.StructType) -> GrowingReader:
        return GrowingReader(self.options)


def follow_lines(
    spark: SparkSession,
    folder: str,
    log: str,
    glob: str = "*",
    piece_bytes: int = 64 << 20,
    restart_shorter: bool = False,
) -> DataFrame:
    """A stream of (source_file, line_end, line) over files that are appended to, in ``folder`` and below.

    ``log`` is a folder of the query's own, kept with its checkpoint. (source_file, line_end) identifies a
    line and orders those of a file. A last line without its end waits. Hidden files are left out. A file
    that has become shorter is an error, or is read anew with ``restart_shorter``. Bytes that aren't UTF-8
    become replacement characters.
    """
    spark.dataSource.register(GrowingLines)
    reader = spark.readStream.format("growing_lines").option("log", log).option("glob", glob)
    reader = reader.option("pieceBytes", piece_bytes).option("shorter", "restart" if restart_shorter else "fail")
    return reader.load(folder)


def follow_jsonl(spark: SparkSession, folder: str, log: str, schema: T.StructType, **options) -> DataFrame:
    """Rows of growing JSONL files; malformed lines keep their text in ``_corrupt_record``."""
    return parse_jsonl(follow_lines(spark, folder, log, **options), schema, keep=("source_file", "line_end"))
