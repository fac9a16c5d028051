"""Hard negatives against comparing every pair, and the bounds they rest on."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetgauge.llm.hard_negatives import Codes, hard_negatives

ROWS = "vec_id long, label int, embedding array<float>"


def plain(rows, positives=5, negatives=3, least=50, most=95):
    """By the definition, over clean rows (id, label, components)."""
    whole = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, label, v in rows]
    found = []
    for a, own, q in whole:
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, label) for i, label, v in whole if i != a)
        for s, p, _ in [x for x in scored if x[2] == own][:positives]:
            fits = [(n, t) for t, n, label in scored if label != own and least * -s <= 100 * -t <= most * -s]
            found += [(a, p, rank, n, -s, -t) for rank, (n, t) in enumerate(fits[:negatives], 1)]
    return sorted(found)


def got(df, **options):
    return sorted(map(tuple, hard_negatives(df, F.col("vec_id") % 50 == 0, **options).collect()))


@pytest.mark.parametrize("dims,block", [(6, 3), (70, 8192)])
def test_equals_comparing_all(spark, dims, block):
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(4, dims))
    labels = rng.integers(0, 4, 400)
    vectors = (centres[labels] + rng.normal(scale=0.7, size=(400, dims))).astype(np.float32)
    vectors[50] = 0  # a zero anchor ties with everything
    vectors[200:260] = vectors[100]  # copies, of several labels
    rows = [(i, int(label), [float(x) for x in v]) for i, (label, v) in enumerate(zip(labels, vectors))]
    rows += [(-50, 1, rows[3][2]), (1000, 77, rows[5][2])]  # a label of its own has no positives
    odd = [
        (None, 1, rows[0][2]),
        (2000, None, rows[0][2]),
        (2050, 1, None),
        (2100, 1, [float("nan")] * dims),
        (2150, 1, [None] + [1.0] * (dims - 1)),
        (2200, 1, [float("inf")] * dims),
        (2250, 1, []),
        (2300, 1, [1.0]),
        (2350, 1, [1e30] * dims),
    ]
    df = spark.createDataFrame(rows + odd + [rows[7], rows[100]], ROWS)
    df = df.withColumns({c: F.lit("clash") for c in ("codes", "facts", "block", "x", "rank", "anchor_id")})
    want = plain(rows)
    assert got(df, block=block) == want and len(want) > 50
    assert got(df, levels=1, bits=2, positives=2) == plain(rows, positives=2)


def test_nothing_to_compare(spark):
    none = spark.createDataFrame([], ROWS)
    assert got(none) == []
    assert got(spark.createDataFrame([(50, 1, [1.0, 2.0])], ROWS)) == []
    assert got(spark.createDataFrame([(1, 1, [1.0, 2.0]), (2, 2, [1.0, 2.0])], ROWS)) == []
    only_null = spark.createDataFrame([(50, 1, None), (100, None, [1.0])], ROWS)
    assert got(only_null) == []


@pytest.mark.parametrize("levels,bits", [(1, 1), (3, 6)])
def test_bounds_hold(levels, bits):
    rng = np.random.default_rng(1)
    for dims in (1, 2, 63, 64, 65, 130):
        vectors = rng.integers(-900, 900, (200, dims))
        vectors[0], vectors[1] = 0, 5
        codes = Codes(dims, levels, bits)
        made, facts = codes.encode(vectors)
        ones = np.bitwise_count(made).sum(axis=2, dtype=np.int64)
        asked = codes.asked(vectors[:20])
        for k in range(20):
            lower, upper = codes.interval(asked, k, made, ones, facts)
            true = vectors @ vectors[k]
            assert (lower <= true).all() and (true <= upper).all()
