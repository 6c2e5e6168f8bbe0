"""Beliefs of many points: exact results, in a time that grows with the points."""

import threading
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from credence.functions import cdf as C
from credence.operators import joint, propagate, scoring

N, LIMIT = 20_000, 60
DAY = datetime(2020, 1, 1, tzinfo=timezone.utc)


@pytest.fixture
def soon(spark):
    """Jobs that take too long are cancelled, which fails the test."""
    timer = threading.Timer(LIMIT, spark.sparkContext.cancelAllJobs)
    timer.start()
    yield
    timer.cancel()


def belief(spark, horizon=0, shift=0.0, day=0):
    """N equally likely values from ``shift`` on."""
    start = DAY + timedelta(days=day)
    keys = [F.lit("x").alias("sensor"), F.lit(start).cast("timestamp").alias("event_start"), F.lit(start - timedelta(hours=horizon)).cast("timestamp").alias("belief_time"), F.lit("a").alias("source"), F.lit(timedelta(hours=horizon)).alias("belief_horizon")]
    return spark.range(N).select(*keys, ((F.col("id") + 1) / N).alias("cumulative_probability"), (F.col("id") + shift).cast("double").alias("event_value"))


def test_horizons_of_large_beliefs(spark, soon):
    df = belief(spark).unionByName(belief(spark, 3, 1.0))
    found = {r["horizon"]: r["mae"] for r in scoring.accuracy_by_horizon(df, probabilistic=True).collect()}
    assert found == {timedelta(0): pytest.approx(0.0, abs=1e-9), timedelta(hours=3): pytest.approx(1.0)}


def test_part_of_a_large_belief(spark, soon):
    packed = propagate.pack(belief(spark)).withColumn("cdf", C.partial(C.complete(F.col("cdf")), F.lit(0.25), F.lit(0.75)))
    row = propagate.unpack(packed).agg(F.count("*"), F.min("event_value"), F.max("event_value"), F.max("cumulative_probability")).first()
    assert tuple(row) == (N // 2, N / 4, 3 * N / 4 - 1, pytest.approx(1.0))


def test_large_belief_as_one_value(spark, soon):
    row = scoring.make_deterministic(belief(spark)).first()
    assert row["event_value"] == pytest.approx((N - 1) ** 2 / (2 * N)) and row["cumulative_probability"] == pytest.approx((row["event_value"] + 1) / N)


def test_mean_of_a_large_belief(spark, soon):
    row = propagate.pack(belief(spark)).select(C.mean(F.col("cdf"), "discrete").alias("v")).first()
    assert row["v"] == pytest.approx((N - 1) / 2)


def test_score_of_a_large_belief(spark, soon):
    many = propagate.pack(belief(spark)).select(C.complete(F.col("cdf")).alias("f"), F.array(F.struct(F.lit(1.0).alias("cp"), F.lit(0.0).alias("v"))).alias("r"))
    row = many.select(C.crps(F.col("f"), F.col("r")).alias("one"), C.crps(F.col("f"), F.col("f")).alias("same")).first()
    assert row["one"] == pytest.approx((N - 1) / 2 - (N * N - 1) / (6 * N)) and row["same"] == pytest.approx(0.0, abs=1e-9)


def test_scores_equal_all_pairs(spark):
    rng = np.random.default_rng(3)

    def cdf(n):
        cps = np.sort(rng.choice(np.arange(1, 20), n - 1)) / 20  # some twice: empty slices
        return [(float(c), float(v)) for c, v in zip([*cps, 1.0], rng.integers(-9, 9, n))]  # values in any order

    def masses(c):
        return [(lo, hi, v) for lo, (hi, v) in zip([0.0, *(p for p, _ in c)], c) if hi > lo]

    def score(f, r):
        total = 0.0
        for lo, hi, v in masses(r):
            w = [((min(h, hi) - max(g, lo)) / (hi - lo), x) for g, h, x in masses(f) if min(h, hi) > max(g, lo)]
            total += (hi - lo) * (sum(a * abs(x - v) for a, x in w) - sum(a * b * abs(x - y) for a, x in w for b, y in w) / 2)
        return total

    rising = lambda c: [(p, v) for (p, _), v in zip(c, sorted(v for _, v in c))]
    data = [tuple(sorted(cdf(int(n))) for n in rng.integers(1, 9, 2)) for _ in range(60)]
    data = data + [(rising(f), r) for f, r in data] + [([(1.0, None)], [(1.0, 1.0)]), ([(1.0, 1.0)], [(0.5, 2.0), (1.0, None)])]
    df = spark.createDataFrame(data, "f array<struct<cp:double,v:double>>, r array<struct<cp:double,v:double>>")
    found = [r[0] for r in df.select(C.crps(F.col("f"), F.col("r"))).collect()]
    assert found == [*(pytest.approx(score(f, r), abs=1e-9) for f, r in data[:-2]), None, None]


def test_sums_of_pairs_are_told_apart_by_their_last_bit():
    rng = np.random.default_rng(4)
    cents = lambda n: np.unique(rng.integers(-3000, 3000, n)) / 100
    cases = [(cents(900), cents(700)), (rng.normal(size=40), rng.normal(size=30)), (np.array([0.1, 0.2, 0.7]), np.array([0.0])), (np.round(cents(900) + 31, 2), np.round(cents(800) + 31, 2)), (np.array([np.nan, 1.0]), np.array([1.0, np.inf]))]
    for a, b in cases:
        p, q = rng.random(len(a)) + 0.1, rng.random(len(b)) + 0.1
        for n in (1, 2):
            expected = {}
            for x, y in zip(a.tolist(), p):
                for z, w in zip(b.tolist(), q):
                    k = str((x + z) / n + 0.0)
                    expected[k] = expected.get(k, 0.0) + y * w
            found = {}
            for v, m in joint.pair_sums(a, p, b, q, n):
                for x, y in zip(v.tolist(), m):
                    found[str(x + 0.0)] = found.get(str(x + 0.0), 0.0) + y
            assert found == {k: pytest.approx(x) for k, x in expected.items()}
    assert joint._by_grid(*cases[3][:1], np.ones(len(cases[3][0])), cases[3][1], np.ones(len(cases[3][1])), 2) is not None


def test_mean_of_two_large_beliefs(spark, soon):
    df = belief(spark).unionByName(belief(spark, day=1))
    packed = propagate.pack(df, ("sensor", "source", "event_start")).withColumn("cdf", C.complete(F.col("cdf")))
    row = joint.joint_of_two(packed, ["sensor", "source"]).agg(F.count("*"), F.max("event_value"), F.max("cumulative_probability"), F.max("n")).first()
    assert tuple(row) == (2 * N - 1, N - 1, pytest.approx(1.0), 2)


def test_unknown_values_in_pairs(spark):
    data = [("g", DAY, [(0.5, None), (1.0, 2.0)]), ("g", DAY + timedelta(days=1), [(0.25, 1.0), (1.0, 3.0)]), ("h", DAY, [(0.25, 1.0), (1.0, 4.0)])]
    df = spark.createDataFrame(data, "k string, event_start timestamp, cdf array<struct<cp:double,v:double>>")
    found = {(r["k"], r["event_value"]): (r["n"], r["cumulative_probability"]) for r in joint.joint_of_two(df, ["k"]).collect()}
    assert found == {("g", None): (2, 0.5), ("g", 1.5): (2, 0.625), ("g", 2.5): (2, 1.0), ("h", 1.0): (1, 0.25), ("h", 4.0): (1, 1.0)}
