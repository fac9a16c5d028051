"""Lines appended to known files come once, whatever fails in between."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.sources import growing
from fleetgauge.sources.scratch import fresh_path


def append(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "ab") as f:
        f.write(data)


class Following:
    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options = spark, str(folder), options
        self.log, self.checkpoint, self.out = (fresh_path(spark, x) for x in ("log", "state", "out"))

    def drain(self, broken=False):
        lines = growing.follow_lines(self.spark, self.folder, self.log, **self.options)
        if broken:
            lines = lines.withColumn("line", F.when(F.col("line") == "third", F.raise_error(F.lit("lost"))).otherwise(F.col("line")))
        query = (
            lines.writeStream.format("parquet")
            .option("checkpointLocation", self.checkpoint)
            .trigger(availableNow=True)
            .start(self.out)
        )
        query.awaitTermination()

    def lines(self):
        rows = self.spark.read.schema(growing.LINES).parquet(self.out).collect()
        return sorted((os.path.basename(r.source_file), r.line_end, r.line) for r in rows)


def test_appended_lines_come_once(spark, tmp_path):
    follow = Following(spark, tmp_path)
    append(f"{tmp_path}/run/a.jsonl", b"first\nsecond\r\nthi")
    follow.drain()
    assert follow.lines() == [("a.jsonl", 6, "first"), ("a.jsonl", 14, "second")]
    follow.drain()
    assert len(follow.lines()) == 2
    append(f"{tmp_path}/run/a.jsonl", b"rd\n\nf\xffth")
    append(f"{tmp_path}/b.jsonl", "é漢\n".encode())
    append(f"{tmp_path}/_hidden", b"no\n")
    with pytest.raises(Exception, match="lost"):
        follow.drain(broken=True)
    assert len(follow.lines()) == 2
    append(f"{tmp_path}/run/a.jsonl", b"\n")
    follow.drain()
    want = [("a.jsonl", 6, "first"), ("a.jsonl", 14, "second"), ("a.jsonl", 20, "third"), ("a.jsonl", 21, ""), ("b.jsonl", 6, "é漢")]
    # The failed batch is run again as it was planned; the line that ended afterwards is the next one.
    assert follow.lines() == want or follow.lines() == sorted([*want, ("a.jsonl", 26, "f�th")])
    follow.drain()
    assert follow.lines() == sorted([*want, ("a.jsonl", 26, "f�th")])


def test_shorter_files(spark, tmp_path):
    fails, restarts = Following(spark, tmp_path), Following(spark, tmp_path, restart_shorter=True)
    append(f"{tmp_path}/a", b"one\ntwo\n")
    for follow in (fails, restarts):
        follow.drain()
    os.truncate(f"{tmp_path}/a", 0)
    append(f"{tmp_path}/a", b"new\n")
    with pytest.raises(Exception, match="followed to byte 8"):
        fails.drain()
    restarts.drain()
    assert [x[2] for x in restarts.lines()] == ["new", "one", "two"]


def test_pieces_cut_anywhere_give_each_line_once(tmp_path):
    rng = random.Random(1)
    lines = [b"x" * rng.choice([0, 1, 7, 300, 70_000]) for _ in range(200)]
    path = f"{tmp_path}/a"
    append(path, b"\n".join(lines) + b"\nrest")
    size = os.path.getsize(path)
    for piece in (1 << 10, 9973, 1 << 30):
        reader = growing.GrowingReader({"path": str(tmp_path), "log": f"{tmp_path}/.log", "piecebytes": str(piece)})
        cuts = sorted({0, size, *rng.sample(range(size), 20)})
        parts = growing.packed(((path, a, b) for a, b in zip(cuts, cuts[1:])), piece)
        assert all(sum(b - a for _, a, b in p.ranges) <= piece for p in parts)
        got = [r for p in parts for batch in reader.read(p) for r in batch.to_pylist()]
        assert [r["line"].encode() for r in got] == lines
        assert [r["line_end"] for r in got][-1] == size - 4


def test_range_log_survives_restarts(tmp_path):
    log = growing.RangeLog(f"{tmp_path}/log", snapshot_every=5)
    for k in range(1, 24):
        assert log.add([(f"f{k % 3}", 10 * k, 10 * k + 10)]) == k
        log.forget(k - 2)
        again = growing.RangeLog(f"{tmp_path}/log", snapshot_every=5)
        assert (again.version, again.lengths) == (k, log.lengths)
        assert again.ranges(k) == [(f"f{k % 3}", 10 * k, 10 * k + 10)]
    assert len([n for n in os.listdir(f"{tmp_path}/log") if n.startswith("ranges")]) <= 6


def test_jsonl_rows(spark, tmp_path):
    append(f"{tmp_path}/a.jsonl", b'{"tag": "a", "n": 1}\nbroken\n\n{"tag": "b"}\n')
    append(f"{tmp_path}/a.txt", b'{"tag": "other"}\n')
    schema = T.StructType().add("tag", "string").add("n", "long")
    rows = growing.follow_jsonl(spark, str(tmp_path), fresh_path(spark, "log"), schema, glob="*.jsonl")
    out = fresh_path(spark, "out")
    rows.writeStream.format("parquet").option("checkpointLocation", fresh_path(spark, "state")).trigger(
        availableNow=True
    ).start(out).awaitTermination()
    got = spark.read.parquet(out).orderBy("line_end").collect()
    assert [(r.tag, r.n, r._corrupt_record) for r in got] == [("a", 1, None), (None, None, "broken"), ("b", None, None)]
