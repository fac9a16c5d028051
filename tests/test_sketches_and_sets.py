"""Bitmaps against plain sets, stored sketches against exact results."""

import random

import pytest
from pyspark.sql import functions as F

from fleetgauge.operators import evaluation as ev
from fleetgauge.operators import id_sets
from tests.test_operators import rows as sorted_rows


@pytest.fixture(scope="module")
def ids(spark):
    rng = random.Random(7)
    data = [(f"k{k % 3}", k % 2, rng.choice([rng.randrange(-70_000, 70_000), k % 50, 2**40 + k % 9])) for k in range(4000)]
    data += [("k0", 0, None), ("none", 1, None), (None, 1, 5), ("edge", 0, 32_767), ("edge", 1, 32_768), ("edge", 1, -1), ("edge", 0, -32_768)]
    return spark.createDataFrame(data, "k string, side int, id long"), data


def sets_of(data, *at):
    found = {}
    for row in data:
        if row[2] is not None:
            found.setdefault(tuple(row[i] for i in at), set()).add(row[2])
    return found


def test_sets_and_their_sizes(ids):
    df, data = ids
    fine = id_sets.id_bitmaps(df, ["k", "side"], "id")
    sizes = {(r.k, r.side): r.n for r in id_sets.set_sizes(fine, ["k", "side"], "n").collect()}
    assert sizes == {k: len(v) for k, v in sets_of(data, 0, 1).items()}
    coarse = id_sets.merged_bitmaps(fine, ["k"])
    got = {}
    for r in id_sets.members(coarse, ["k"]).collect():
        assert r.id not in got.setdefault((r.k,), set())
        got[r.k,].add(r.id)
    assert got == sets_of(data, 0)
    assert id_sets.set_sizes(id_sets.merged_bitmaps(fine)).first().ids == len({r[2] for r in data} - {None})


def test_common_ids(ids):
    df, data = ids
    sides = [id_sets.id_bitmaps(df.where(F.col("side") == s), ["k"], "id") for s in (0, 1)]
    met = {(r.k, r.id) for r in id_sets.members(id_sets.common_bitmaps(sides, ["k"]), ["k"]).collect()}
    split = sets_of(data, 0, 1)
    keys = {k for k, _ in split}
    assert met == {(k, i) for k in keys for i in split.get((k, 0), set()) & split.get((k, 1), set())}
    empty = id_sets.id_bitmaps(df.limit(0), [], "id")
    whole = id_sets.id_bitmaps(df, [], "id")
    assert id_sets.set_sizes(id_sets.common_bitmaps([whole, empty])).first().ids == 0


def test_only_buckets_are_shuffled(spark):
    df = spark.range(0, 300_000, 1, 6).select((F.col("id") % 70_000).alias("id"))
    bitmaps = id_sets.id_bitmaps(df, [], "id")
    assert bitmaps.count() == 3 and id_sets.set_sizes(bitmaps).first().ids == 70_000
    plan = bitmaps._jdf.queryExecution().executedPlan().toString()
    assert "partial_bitmap_construct_agg" in plan


def test_sketches_roll_up_within_their_bounds(spark):
    rng = random.Random(9)
    data = [(f"run{k % 4}", k % 3, rng.lognormvariate(0, 1), f"t{rng.randrange(9000)}") for k in range(40_000)]
    data += [("run0", 0, None, "t0"), ("run9", 0, None, None)]
    df = spark.createDataFrame(data, "run_id string, agent_id int, latency_s double, task_id string").repartition(5)
    stored = ev.latency_sketches(df, ["run_id", "agent_id"])
    assert stored.count() == 13
    for keys, at in (((), ()), (("agent_id",), (1,)), (("run_id",), (0,))):
        values, tasks = {}, {}
        for row in data:
            key = tuple(row[i] for i in at)
            if row[2] is not None:
                values.setdefault(key, []).append(row[2])
            tasks.setdefault(key, set()).add(row[3])
        got = {tuple(r[k] for k in keys): r for r in ev.rolled_up(stored, keys).collect()}
        assert set(got) == set(values)
        for key, r in got.items():
            n = len(values[key])
            assert r.n == n and abs(r.avg_latency_s - sum(values[key]) / n) < 1e-9
            for at_, share in ((r.p50_s, 0.5), (r.p95_s, 0.95)):
                assert abs(sum(v <= at_ for v in values[key]) / n - share) < 0.01
            assert abs(r.distinct_tasks / len(tasks[key] - {None}) - 1) < 0.04
    once = {r.agent_id: r for r in ev.latency_summary(df, ["agent_id"], exact=False).collect()}
    exact = {r.agent_id: r for r in ev.latency_summary(df, ["agent_id"]).collect()}
    assert all(abs(once[k].p95_s / exact[k].p95_s - 1) < 0.1 and once[k].n == exact[k].n for k in exact)


def test_peaks_do_not_depend_on_buckets(spark):
    rng = random.Random(2)
    data = []
    for k in range(600):
        start = rng.choice([rng.uniform(-500, 500), float(rng.randrange(0, 20) * 60)])
        data.append((f"r{k % 2}", start, rng.choice([None, start, start + rng.expovariate(0.01)])))
    data.append(("r0", None, 5.0))
    df = spark.createDataFrame(data, "run_id string, start_s double, end_s double")

    def plain(key):
        steps = {}
        for run, a, b in data:
            if run == key and a is not None:
                steps[a] = steps.get(a, 0) + 1
                if b is not None:
                    steps[b] = steps.get(b, 0) - 1
        level = peak = None
        for t in sorted(steps):
            level = (level or 0) + steps[t]
            peak = level if peak is None else max(peak, level)
        return peak

    want = {k: plain(k) for k in ("r0", "r1")}
    for bucket in (0.5, 60.0, 1e9):
        got = {r.run_id: r.max_concurrent for r in ev.peak_concurrency(df, ["run_id"], bucket_s=bucket).collect()}
        assert got == want, bucket
    times = df.select("run_id", *[F.timestamp_micros((F.col(c) * 1e6).cast("bigint")).alias(c) for c in ("start_s", "end_s")])
    assert sorted_rows(ev.peak_concurrency(times, ["run_id"]), "run_id")[0][1] in (want["r0"], want["r0"] + 1)
