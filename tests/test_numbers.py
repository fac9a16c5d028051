import math
import random

from pyspark.sql import functions as F

from fleetgauge.functions import numbers, present


def test_fixed_point_matches_exact_formatting(spark):
    rng = random.Random(11)
    values = [0.0, 0.5, 1.5, 2.5, 0.125, 2.675, 1.005, 0.0005, 0.00049, 1e-9, 999.9995, 1e15, -0.125, -3.25, 1e22]
    values += [rng.uniform(-1000, 1000) for _ in range(1500)]
    values += [rng.randrange(100000) / 2 ** rng.randrange(12) for _ in range(1500)]
    values += [rng.randrange(10**6) / 10 ** rng.randrange(7) for _ in range(1500)]
    values += [(2 * rng.randrange(1000) + 1) * 5 / 10 ** rng.randrange(1, 5) for _ in range(1500)]
    values = [v for v in values if abs(v) < 1e15]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    shown = df.select("x", *[numbers.fixed_point(F.col("x"), d).alias(f"d{d}") for d in range(7)])
    for r in shown.collect():
        for d in range(7):
            assert r[f"d{d}"] == f"{r.x:.{d}f}", (r.x, d)
    assert spark.createDataFrame([(None,)], "x double").select(numbers.fixed_point(F.col("x"), 2)).first()[0] is None


def _comb_pass(n, c, k):
    return 1.0 if n - c < k else 1.0 - math.comb(n - c, k) / math.comb(n, k)


def test_pass_at_k_cases_and_monotonicity(spark):
    cells = [(n, c) for n in range(1, 40) for c in range(n + 1)] + [(100, 7), (200, 0), (200, 3)]
    df = spark.createDataFrame(cells, "n long, c long")
    ks = [1, 5, 10, 100]
    rows = df.select("n", "c", *[numbers.pass_at_k(F.col("n"), F.col("c"), k).alias(f"k{k}") for k in ks]).collect()
    seen = {}
    for r in rows:
        for k in ks:
            assert math.isclose(r[f"k{k}"], _comb_pass(r.n, r.c, k), abs_tol=1e-12)
        assert math.isclose(r.k1, r.c / r.n, abs_tol=1e-12)
        if r.n >= 10:
            assert r.k1 <= r.k5 + 1e-12 <= r.k10 + 2e-12
        seen[r.n, r.c] = r
    assert abs(seen[10, 3].k5 - 0.916667) < 1e-6
    assert seen[5, 0].k1 == 0 and seen[5, 5].k1 == 1
    assert abs(seen[100, 7].k10 - 0.533260) < 1e-6


def test_published_improvements(spark):
    data = [
        (6.04, 6.53, False, "-8.1%"),
        (0.165, 0.153, True, "-7.3%"),
        (240900.0, 244000.0, False, "-1.3%"),
        (12.33, 10.56, False, "+14.4%"),
        (2188700.0, 2233800.0, False, "-2.1%"),
        (8.03, 5.67, False, "+29.4%"),
        (0.0, 3.0, True, "N/A"),
        (3.0, 3.0, False, "+0.0%"),
        (3.0, 3.0, True, "0.0%"),
    ]
    df = spark.createDataFrame(data, "b double, a double, up boolean, want string")
    for r in df.withColumn("got", present.improvement(F.col("b"), F.col("a"), F.col("up"))).collect():
        assert r.got == r.want, r


def test_human_texts(spark):
    def one(column):
        return spark.range(1).select(column).first()[0]

    assert one(present.human_number(F.lit(240900.0), " /s")) == "240.9K /s"
    assert one(present.human_number(F.lit(6.04), " s")) == "6.04 s"
    assert one(present.human_number(F.lit(0.165))) == "0.165"
    assert one(present.number_or_na(F.lit(None).cast("double"))) == "NA"
    assert one(present.size_text(F.lit(1536.0))) == "1.50TB"
    assert one(present.size_text(F.lit(10.0))) == "10.00GB"
    assert one(present.progress_bar(F.lit(50.0), F.lit(100.0), 10)) == "[█████░░░░░] 50.0%"
    assert one(present.progress_bar(F.lit(5.0), F.lit(0.0), 4)) == "[░░░░]"
    base, attempt = present.reflection_parts(F.lit("a::reflection-1::reflection-2"))
    assert (one(base), one(attempt)) == ("a::reflection-1", 2)
    assert one(present.reflection_parts(F.lit("plain"))[1]) is None


def test_numbers_in_text(spark):
    data = [("1,234.5", 1234.5), ("12%", 12.0), ("<not", None), ("", None), ("7d", None), ("nan", None), ("3.", 3.0), ("1-2", None)]
    df = spark.createDataFrame(data, "t string, want double")
    for r in df.withColumn("got", numbers.clean_number(F.col("t"))).collect():
        assert r.got == r.want, r
    mid = [("0 -> 1", 0.5), ("0-1", 0.5), ("  4 -> 7  ", 5.5), ("8", 8.0), ("usecs", None)]
    df = spark.createDataFrame(mid, "t string, want double")
    for r in df.withColumn("got", numbers.bucket_midpoint(F.col("t"))).collect():
        assert r.got == r.want, r


def test_zero_guards(spark):
    r = spark.range(1).select(
        numbers.throughput(F.lit(3), F.lit(0.0)).alias("t"),
        numbers.throughput(F.lit(3), F.lit(0.0), 1e-6).alias("t2"),
        numbers.used_percent(F.lit(1.0), F.lit(0.0)).alias("p"),
        numbers.utilisation(F.lit(1.0), F.lit(0.0)).alias("u"),
        numbers.divide_or(F.lit(1.0), F.lit(0.0)).alias("d"),
    ).first()
    assert (r.t, r.p, r.u, r.d) == (3000.0, 0.0, 1.0, 0.0)
    assert r.t2 == 3 / 1e-6
