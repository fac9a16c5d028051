"""Ordered operations under skew: sliced keys must give what a plain window gives."""

import random

import pytest
from pyspark.sql import functions as F

from fleetgauge.catalog import evaluation
from fleetgauge.operators import evaluation as ev
from fleetgauge.operators import grid, telemetry
from fleetgauge.plans import ordered
from fleetgauge.plans.ordered import SliceLimits, by_rows, with_ordinal, with_previous, with_running_sum

TINY = SliceLimits(rows_per_task=40)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    keys = ["hot"] * 900 + [None] * 300 + [f"k{i % 50}" for i in range(600)]
    # A third of the hot key's rows share one time.
    data = [
        (k, 7.0 if rng.random() < 0.34 else float(rng.randrange(500)), i, rng.randrange(10))
        for i, k in enumerate(keys)
    ]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "k string, ts double, id long, v long")


def _expected(data, key=True):
    groups = {}
    for k, ts, i, v in data:
        groups.setdefault(k if key else 0, []).append((ts, i, v))
    return {g: sorted(members) for g, members in groups.items()}


def test_ordinals_and_totals(rows):
    data, df = rows
    got = with_ordinal(df, ["k"], ["ts", "id"], "n", "total", TINY).collect()
    want = {
        i: (pos, len(members))
        for members in _expected(data).values()
        for pos, (_, i, _) in enumerate(members, 1)
    }
    assert {r.id: (r.n, r.total) for r in got} == want


def test_running_sum_over_all_rows(rows):
    data, df = rows
    got = with_running_sum(df, [], ["ts", "id"], F.col("v"), "s", limits=TINY).collect()
    total, want = 0, {}
    for _, i, v in _expected(data, key=False)[0]:
        total += v
        want[i] = total
    assert {r.id: r.s for r in got} == want


def test_previous_crosses_slices(rows):
    data, df = rows
    got = with_previous(df, ["k"], ["ts", "id"], {"p": "v", "pid": "id"}, TINY).collect()
    want = {}
    for members in _expected(data).values():
        before = (None, None)
        for _, i, v in members:
            want[i] = before
            before = (v, i)
    assert {r.id: (r.p, r.pid) for r in got} == want


@pytest.mark.parametrize("size", [2_000, 20_000])
def test_slices_are_bounded_for_any_size(spark, size):
    df = spark.range(size).select(F.lit("hot").alias("k"), F.xxhash64("id").alias("ts"), "id")
    limits = SliceLimits(rows_per_task=200)
    cut, keys = ordered._slice(df, ["k"], ["ts", "id"], limits)
    sizes = [r["count"] for r in cut.groupBy(*keys, "__slice").count().collect()]
    assert sum(sizes) == size and max(sizes) <= 2 * limits.rows_per_task
    got = with_ordinal(df, ["k"], ["ts", "id"], "n", limits=limits)
    assert got.agg(F.max("n"), F.count_distinct("n")).first() == (size, size)


def test_keys_in_one_slice_carry_nothing(rows):
    _, df = rows
    cut, _ = ordered._slice(df, ["k"], ["ts", "id"], TINY)
    pieces = cut.where("k like 'k%'").groupBy("k").agg(F.count_distinct("__slice").alias("n"))
    assert pieces.where("n > 2").isEmpty()


def test_time_order_columns(spark, rows):
    _, df = rows
    for kind in ("timestamp", "timestamp_ntz"):
        timed = df.withColumn("t", F.timestamp_seconds(F.col("ts")).cast(kind))
        a = with_ordinal(timed, ["k"], ["t", "id"], "n", limits=TINY).select("id", "n")
        b = with_ordinal(timed, ["k"], ["t", "id"], "n").select("id", "n")
        assert a.exceptAll(b).isEmpty()


@pytest.mark.parametrize("size", [1, 2, 19, 20, 21, 40, 100, 180])
def test_percentile_rank(spark, size):
    values = list(range(1, size + 1))
    random.Random(size).shuffle(values)
    df = spark.createDataFrame([(float(v),) for v in values], "latency_s double")
    rank = {1: 1, 2: 1, 19: 18, 20: 19, 21: 19, 40: 38, 100: 95, 180: 171}[size]
    for limits in (SliceLimits(), SliceLimits(rows_per_task=10)):
        r = ev.latency_summary(df, limits=limits).first()
        ordered_values = sorted(values)
        middle = (ordered_values[(size - 1) // 2] + ordered_values[size // 2]) / 2
        assert (r.n, r.p50_s, r.p95_s) == (size, middle, float(rank))


def test_latency_summary_with_hot_copies(spark):
    data = [("a", 1.0)] * 500 + [("a", float(i)) for i in range(200)] + [("b", 2.0)]
    df = spark.createDataFrame(data, "k string, latency_s double")
    for limits in (SliceLimits(), TINY):
        got = {r.k: r for r in ev.latency_summary(df, ["k"], limits=limits).collect()}
        values = sorted(v for k, v in data if k == "a")
        assert got["a"].p50_s == (values[349] + values[350]) / 2
        assert got["a"].p95_s == values[int(0.95 * 700) - 1]
        assert got["b"].p95_s == 2.0
    assert ev.latency_summary(df, ["k"], exact=False).count() == 2


def test_peak_concurrency(spark):
    rng = random.Random(3)
    data = [("h", float(s), float(s + rng.randrange(1, 30))) for s in (rng.randrange(400) for _ in range(500))]
    data += [("x", 0.0, 5.0), ("x", 1.0, 3.0), ("x", 3.0, 4.0)]
    df = spark.createDataFrame(data, "k string, start_s double, end_s double")
    want = {}
    for key in ("h", "x"):
        steps = sorted([(s, 1) for k, s, _ in data if k == key] + [(e, -1) for k, _, e in data if k == key], key=lambda p: (p[0], p[1]))
        active = peak = 0
        for _, d in steps:
            active += d
            peak = max(peak, active)
        want[key] = (peak, sum(1 for k, _, _ in data if k == key))
    assert want["x"] == (2, 3)
    for limits in (SliceLimits(), TINY):
        got = ev.peak_concurrency(df, ["k"], limits=limits).collect()
        assert {r.k: (r.max_concurrent, r.started) for r in got} == want


def test_batches_chunks_and_samples_under_skew(rows):
    data, df = rows
    want = {i: (pos - 1) // 8 for m in _expected(data).values() for pos, (_, i, _) in enumerate(m, 1)}
    batched = ev.with_batches(df, ["k"], ["ts", "id"], 8, TINY).collect()
    assert {r.id: r.batch_no for r in batched} == want
    single = ev.with_batches(df.where("k = 'k1'"), ["k"], ["ts", "id"], 0).collect()
    assert sorted(r.batch_no for r in single) == list(range(12))
    chunks = ev.task_list_chunks(df, "k", ["ts", "id"], "id", 100, TINY).collect()
    assert all(len(r.tasks) <= 100 for r in chunks)
    hot = [i for r in sorted(chunks, key=lambda r: r.chunk_no) if r.k == "hot" for i in r.tasks]
    assert hot == [i for _, i, _ in _expected(data)["hot"]]
    tenth = grid.every_nth(df, ["k"], ["ts", "id"], 10, limits=TINY).where("k = 'hot'").collect()
    assert sorted(r.ordinal for r in tenth) == list(range(10, 901, 10))
    ticks = grid.every_nth(df, ["k"], ["ts", "id"], 6, True, TINY).where("k = 'hot'").collect()
    assert sorted(r.ordinal for r in ticks) == list(range(1, 901, 6))


def test_counter_rates(spark):
    data = [
        ("p", 0.0, 1, 10), ("p", 2.0, 2, 14), ("p", 2.0, 3, 15), ("p", 4.0, 4, 3), ("p", 5.0, 5, 4),
    ]
    df = spark.createDataFrame(data, "pid string, ts double, ord int, c long")
    got = telemetry.counter_rates(df, ["pid"], ["c"], ties=["ord"]).orderBy("ord").collect()
    assert [r.c_delta for r in got] == [None, 4, 1, None, 1]
    assert [r.c_rate for r in got] == [None, 2.0, None, None, 1.0]


def test_first_rows_take_few_tasks_whatever_the_limit(spark, monkeypatch):
    dealt, whole = [], ordered.stored
    monkeypatch.setattr(ordered, "stored", lambda df, label: dealt.append(df.rdd.getNumPartitions()) or whole(df, label))
    ids = [*range(2000), *range(700), *[None] * 40]
    df = spark.createDataFrame([(i, f"x{n}") for n, i in enumerate(ids)], "id long, x string")
    want = sorted(ids, key=lambda i: (i is not None, i))
    for count in (1, 39, 60, 1000, 2739, 2740, 5000):
        got = ordered.first_rows(df, ["id"], count, SliceLimits(rows_per_task=5))
        assert sorted((r.id for r in got.collect()), key=lambda i: (i is not None, i)) == want[:count]
        assert got.columns == df.columns
    assert max(dealt) <= 8


def test_tasks_follow_the_number_of_rows(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    for rows, tasks in ((2_000_000, 1), (200, 100)):
        dealt = by_rows(df, ["k", "id"], SliceLimits(rows_per_task=rows))
        assert dealt.rdd.getNumPartitions() == tasks
        assert sorted(map(tuple, dealt.collect())) == sorted((i % 3, i) for i in range(1000))


def test_instants_are_dealt_by_rows(spark, monkeypatch):
    asked, whole = [], ev.by_rows
    monkeypatch.setattr(ev, "by_rows", lambda df, keys, *rest: asked.append(keys) or whole(df, keys, *rest))
    rows = [("hot", float(i * 30), float(i * 30 + 90)) for i in range(200)]
    got = ev.peak_concurrency(spark.createDataFrame(rows, "k string, start_s double, end_s double"), ["k"], limits=TINY)
    assert [tuple(r) for r in got.collect()] == [("hot", 3, 200)]
    assert asked == [["k", "__bucket"]]


def test_latency_rollup_cuts_an_agent(spark, monkeypatch):
    parts, whole = [], evaluation.by_rows

    def spied(df, keys, **rest):
        parts.append(df.select("part").distinct().count())
        return whole(df, keys, **rest)

    rows = [(7, 5, i, float(i % 50)) for i in range(400)] + [(8, 1, None, 2.0), (9, 1, 3, None)]
    tries = spark.createDataFrame(rows, "agent_id long, gpu_id int, task_id long, latency_s double")
    monkeypatch.setattr(evaluation, "attempts", lambda t: tries)
    monkeypatch.setattr(evaluation, "by_rows", spied)
    got = sorted(map(tuple, evaluation.latency_rollup(None).collect()))
    assert got == [(7, 400, 24.5, True, True, True), (8, 1, 2.0, True, True, True)] and parts == [8]
