"""Values at exact ranks against sorting, with sketches that miss and keys of all sizes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fleetgauge.operators import evaluation as ev
from fleetgauge.plans import selection
from fleetgauge.plans.ordered import SliceLimits


N = F.col("n")
RANKS = {"low": (0.5, F.floor((N + 1) / 2)), "p95": (0.95, F.greatest(F.floor(0.95 * N), F.lit(1))), "last": (1.0, N)}


def plain(rows):
    by = {}
    for key, v in rows:
        if v is not None:
            by.setdefault(key, []).append(v)
    found = {}
    for key, values in by.items():
        values.sort(key=lambda x: (math.isnan(x), x))
        n = len(values)
        found[key] = (n, values[(n + 1) // 2 - 1], values[max(math.floor(0.95 * n), 1) - 1], values[-1])
    return found


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    data = [("hot", rng.lognormvariate(0, 2)) for _ in range(30_000)]
    data += [(None, float(k % 3)) for k in range(500)] + [("one", 7.5), ("none", None)]
    data += [("same", 1.0)] * 4000 + [("odd", x) for x in (float("nan"), float("inf"), -float("inf"), 0.0, float("nan"))]
    data += [("nan", float("nan"))]
    rng.shuffle(data)
    return data


def show(r):
    return tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r)


@pytest.mark.parametrize("case", ["plain", "missed", "dealt"])
def test_equals_sorting(spark, rows, case, monkeypatch):
    if case == "missed":  # brackets so narrow and sketches so coarse that many ranks lie outside
        monkeypatch.setattr(selection, "MARGIN", 0.0)
        monkeypatch.setattr(selection, "SKETCH_SIZE", 8)
    limits = SliceLimits(rows_per_task=50) if case == "dealt" else selection.DEFAULT_LIMITS
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = selection.values_at_ranks(df, ["k"], F.col("v"), RANKS, [F.min("v").alias("least")], limits).collect()
    want = plain(rows)
    assert {r.k: show((r.n, r.low, r.p95, r.last)) for r in got} == {k: show(x) for k, x in want.items()}
    assert {r.k: r.least for r in got}["hot"] == min(v for k, v in rows if k == "hot")


def test_without_keys(spark, rows):
    df = spark.createDataFrame([r for r in rows if r[0] == "hot"], "k string, v double")
    r = selection.values_at_ranks(df, [], F.col("v"), RANKS).collect()
    want = plain([r for r in rows if r[0] == "hot"])["hot"]
    assert [(x.n, x.low, x.p95, x.last) for x in r] == [want]
    assert selection.values_at_ranks(df.limit(0), [], F.col("v"), RANKS).collect() == []
    assert selection.values_at_ranks(df.limit(0), ["k"], F.col("v"), RANKS).collect() == []


def test_only_brackets_are_kept(spark):
    df = spark.range(200_000).select((F.xxhash64("id") % 1_000_000).cast("double").alias("v"))
    seen = []
    stored = selection.stored

    def noted(df_, label):
        out = stored(df_, label)
        if label == "inside-brackets":
            seen.append(out.count())
        return out

    selection.stored = noted
    try:
        got = selection.values_at_ranks(df, [], F.col("v"), RANKS).first()
    finally:
        selection.stored = stored
    values = sorted(r.v for r in df.collect())
    assert (got.low, got.p95, got.last) == (values[99_999], values[189_999], values[-1])
    assert seen and seen[0] < 200_000 * 0.1


def test_latency_summary_without_values(spark):
    df = spark.createDataFrame([("a", None)], "agent_id string, latency_s double")
    assert ev.latency_summary(df, ["agent_id"]).collect() == []
