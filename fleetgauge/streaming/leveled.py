"""Live tables that take rows of any age: partial aggregates in runs, merged by levels.

Each micro-batch is aggregated to partial results per key, which are written as one run. A row that comes
late simply makes a further partial result of its key, so nothing is dropped, no watermark is waited for and
no state is held by the stream; a view is the merge of all runs. ``fanout`` runs of one level are merged
into one of the next, so after n batches there are at most fanout - 1 runs on each of log(n) levels, and
reading the view opens so many however long the stream has run.

The list of runs is written after the runs themselves, in turn into one of two places, so one whole list
is always there. A batch that is run again finds itself on the list and does nothing, or writes the same
runs anew.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Fold:
    """An aggregate in three steps: of rows, of partial results (same names), and what a view shows."""

    rows: Sequence[Column]
    partials: Sequence[Column]
    shown: Sequence[Column]


_HEAD = "batch_id long, runs array<struct<level: int, name: string>>"


class LeveledTable:
    """Partial results of ``fold`` per key below ``path``, for the rows of a stream's batches."""

    def __init__(
        self, spark: SparkSession, path: str, keys: Sequence[str], fold: Fold, schema: T.StructType, fanout: int = 8
    ):
        """``schema`` is that of a partial result."""
        self.spark, self.path, self.keys, self.fold = spark, path.rstrip("/"), list(keys), fold
        self.schema, self.fanout = schema, fanout
        self._mine: tuple[int, list[tuple[int, str]]] | None = None  # the list as this writer left it

    def _head(self) -> tuple[int, list[tuple[int, str]]]:
        found = (-1, [])
        for place in (0, 1):
            try:
                rows = self.spark.read.schema(_HEAD).json(f"{self.path}/head={place}").collect()
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
                continue
            for r in rows:  # none where a write was cut off
                if r.batch_id is not None and r.runs is not None:
                    found = max(found, (r.batch_id, [(x.level, x.name) for x in r.runs]), key=lambda x: x[0])
        return found

    def _run(self, name: str) -> str:
        return f"{self.path}/runs/{name}"

    def _rows(self, names: Sequence[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[self._run(n) for n in names])

    def merged(self, names: Sequence[str]) -> DataFrame:
        return self._rows(names).groupBy(*self.keys).agg(*self.fold.partials)

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Takes the partial results of one batch, once. A table has one writer at a time."""
        last, runs = self._mine or self._head()
        if batch_id <= last:
            return
        name = f"0-{batch_id}"
        batch.write.mode("overwrite").parquet(self._run(name))
        runs = [*runs, (0, name)]
        level = 0
        while sum(at == level for at, _ in runs) == self.fanout:
            full = [n for at, n in runs if at == level]
            name = f"{level + 1}-{batch_id}"
            self.merged(full).write.mode("overwrite").parquet(self._run(name))
            runs = [(at, n) for at, n in runs if at != level] + [(level + 1, name)]
            level += 1
        head = self.spark.createDataFrame([(batch_id, runs)], _HEAD)
        head.coalesce(1).write.mode("overwrite").json(f"{self.path}/head={batch_id % 2}")
        self._mine = batch_id, runs

    def runs(self) -> list[str]:
        return [name for _, name in self._head()[1]]

    def read(self) -> DataFrame:
        """The view over all batches taken so far."""
        return self.merged(self.runs()).select(*self.keys, *self.fold.shown)


class SessionTable(LeveledTable):
    """Partial sessions: each has ``session_start`` and ``session_end``, and those that meet are merged."""

    def merged(self, names: Sequence[str]) -> DataFrame:
        micros = F.unix_micros("session_end") - F.unix_micros("session_start")
        length = F.make_interval(secs=(micros / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)"))
        rows = self._rows(names).withColumn("__start", F.col("session_start"))
        keys = [k for k in self.keys if k not in ("session_start", "session_end")]
        sessions = rows.groupBy(*keys, F.session_window("__start", length).alias("w")).agg(*self.fold.partials)
        return sessions.withColumns({"session_start": F.col("w.start"), "session_end": F.col("w.end")}).select(
            *self.keys, *[f.name for f in self.schema.fields if f.name not in self.keys]
        )
