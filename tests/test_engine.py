"""Known results of the engine's operators on small frames."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from credence.durations import duration, iso, moment
from credence.frame import BeliefFrame, belief
from credence.functions import cdf as C
from credence.functions import knowledge
from credence.operators import forecast, instantaneous, joint, lineage, plotdata, propagate, resample, scoring
from credence.operators import viewpoint as V
from credence.sensors import BeliefSource, Sensor
from credence.sources import examples, files
from credence.sources.store import BeliefStore, DuplicateBelief, search

UTC = timezone.utc
H = timedelta(hours=1)
SLOT = Sensor("slot", "", "UTC", timedelta(minutes=15), id=7)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.fixture(scope="module")
def sixteen(spark):
    return examples.sixteen_beliefs(spark)


# parsing, sensors, knowledge horizons ------------------------------------------


@pytest.mark.parametrize("text, expected", [("PT15M", timedelta(minutes=15)), ("H", H), ("1h 30min", 1.5 * H), ("P1DT2H", 26 * H), ("-PT1H", -H), ("2D", timedelta(days=2))])
def test_durations(text, expected):
    assert duration(text) == expected
    assert duration(iso(expected)) == expected


@pytest.mark.parametrize("text", ["1M", "1Y", "1y", "", "P1Y", "x"])
def test_ambiguous_durations_are_rejected(text):
    with pytest.raises(ValueError):
        duration(text)


def test_moments_need_a_zone():
    assert moment("2020-01-01T00:00:00+01:00").utcoffset() == H
    with pytest.raises(TypeError):
        moment("2020-01-01")


def horizon(spark, name, parameters, *starts, resolution=H):
    df = spark.createDataFrame([(s,) for s in starts], "t timestamp")
    return [r[0] for r in df.select(knowledge.horizon(name, parameters, F.col("t"), resolution)).collect()]


def test_noon_the_day_before_across_clock_changes(spark):
    starts = [datetime(2018, 3, 25, 0), datetime(2018, 3, 25, 6), datetime(2018, 3, 26, 0), datetime(2018, 10, 28, 0), datetime(2018, 10, 28, 6), datetime(2018, 10, 29, 0)]
    found = horizon(spark, "x_days_ago_at_y_oclock", {"x": 1, "y": 12, "z": "Europe/Amsterdam"}, *(s.replace(tzinfo=UTC) for s in starts))
    assert found == [n * H for n in (13, 19, 14, 14, 20, 13)]


def test_repeated_hour_is_the_later_one(spark):
    start = datetime(2018, 10, 29, 12, tzinfo=UTC)
    assert horizon(spark, "x_days_ago_at_y_oclock", {"x": 1, "y": 2, "z": "Europe/Amsterdam"}, start) == [start - datetime(2018, 10, 28, 1, tzinfo=UTC)]


def test_years_ago(spark):
    zone = ZoneInfo("Europe/Amsterdam")
    found = horizon(spark, "x_years_ago_at_date", {"x": 1, "month": 3, "day": 28, "z": "Europe/Amsterdam"}, datetime(2024, 3, 28, tzinfo=zone), datetime(2024, 4, 1, tzinfo=zone))
    assert found == [timedelta(days=366, hours=1), timedelta(days=370)]
    with pytest.raises(ValueError):
        knowledge.x_years_ago_at_date(F.lit(None), H, 0, 1, 1, "UTC")


def test_bounds_hold(spark):
    starts = [datetime(2024, m, 28, 13, tzinfo=UTC) for m in range(1, 13)]
    for name, par in (("x_days_ago_at_y_oclock", {"x": 3, "y": 17.5, "z": "Europe/London"}), ("x_years_ago_at_date", {"x": 2, "day": 31, "month": 12, "z": "Europe/Amsterdam"}), ("ex_post", {"ex_post_horizon": H}), ("ex_ante", {"ex_ante_horizon": H})):
        low, high = knowledge.bounds(name, par, H)
        assert all(low <= h <= high for h in horizon(spark, name, par, *starts))
    assert knowledge.bounds("at_date", {"knowledge_time": starts[0]}, H) == (None, None)
    with pytest.raises(KeyError):
        knowledge.horizon("os.system", {}, F.lit(None), H)


def test_parameters_as_json():
    par = {"ex_ante_horizon": 36 * H, "x": 1, "z": "Europe/Amsterdam", "knowledge_time": datetime(2020, 1, 1, tzinfo=UTC)}
    assert knowledge.from_json(knowledge.to_json(par)) == par


def test_sources_and_beliefs():
    assert BeliefSource(3).name == "3" and BeliefSource("a") < BeliefSource("b")
    with pytest.raises(TypeError):
        BeliefSource(None)
    at = datetime(2020, 1, 1, tzinfo=UTC)
    assert belief(SLOT, "s", 1.0, event_start=at, belief_time=at, sigma=1)[3] == pytest.approx(0.8413, abs=1e-4)
    for bad in ({"event_start": at}, {"event_start": at, "belief_time": at, "belief_horizon": H}, {"event_start": at, "belief_time": at, "cp": 0.1, "sigma": 1}):
        with pytest.raises(ValueError):
            belief(SLOT, "s", 1.0, **bad)
    with pytest.raises(KeyError):
        belief(SLOT, "s", 1.0, event_time=at, belief_time=at)


# frames and viewpoints -----------------------------------------------------------


def test_frame_forms(spark, sixteen):
    assert sixteen.df.count() == 40
    back = BeliefFrame(sixteen.in_horizon_form().drop("sensor"), sixteen.sensor)
    assert back.df.select(sixteen.df.columns).exceptAll(sixteen.df).isEmpty()
    ends = BeliefFrame(sixteen.with_event_end(), sixteen.sensor)
    assert ends.df.select(sixteen.df.columns).exceptAll(sixteen.df).isEmpty()
    assert BeliefFrame.empty(spark, sixteen.sensor).df.isEmpty()
    with pytest.raises(KeyError):
        BeliefFrame(sixteen.df.drop("source"), sixteen.sensor)


def test_viewpoints_keep_all_points(spark):
    grid = examples.grid_beliefs(spark, SLOT, 4, 3, 2, 3, datetime(2000, 1, 3, 9, tzinfo=UTC))
    assert grid.rolling_viewpoint(timedelta(days=1)).df.count() == 4 * 2 * 3
    assert grid.fixed_viewpoint(datetime(2000, 1, 1, 10, tzinfo=UTC)).df.agg(F.max("belief_time")).first()[0] == datetime(2000, 1, 1, 10)
    with pytest.raises(ValueError):
        grid.fixed_viewpoint(datetime(2000, 1, 1, tzinfo=UTC), window=(None, datetime(2000, 1, 1, tzinfo=UTC)))


def test_beliefs_without_values_do_not_count(spark):
    at = datetime(2020, 1, 1, tzinfo=UTC)
    f = BeliefFrame.of(spark, [(at, at, "a", 0.5, 1.0), (at, at + H, "a", 0.5, None)], SLOT)
    assert rows(f.most_recent().df, "event_value") == [(1.0,)]
    assert rows(V.most_recent(f.df), "event_value") == [(1.0,)]


@pytest.mark.parametrize("values, expected", [([10, 10, 10, 9, 9, 9], [1, 2, 4, 5]), ([10, 11, 10, 9, 9.5, 9], []), ([10, 9, 10, 10, 9.5], [3]), ([10, 10, 9, 10, 10], [1, 4])])
def test_unchanged(spark, values, expected):
    start = datetime(2022, 1, 26, tzinfo=UTC)
    f = BeliefFrame.of(spark, [(start, start + i * H, "a", 0.5, float(v)) for i, v in enumerate(values)], SLOT)
    hours = lambda df: sorted(r["belief_time"].hour for r in df.collect())
    assert hours(f.unchanged()) == expected
    assert hours(V.unchanged_probabilistic(f.df)) == expected
    assert hours(V.changed_beliefs(f.df)) == [i for i in range(len(values)) if i not in expected]


# accuracy --------------------------------------------------------------------------


def test_documented_accuracy(sixteen):
    found = {r["source"]: r for r in sixteen.rolling_viewpoint_accuracy(timedelta(days=2, hours=9), "Source A").collect()}
    assert found["Source A"]["mae"] == pytest.approx(1.482075) and found["Source A"]["wape"] == pytest.approx(0.0059283)
    assert found["Source B"]["mae"] == pytest.approx(125.85325) and found["Source B"]["mape"] == pytest.approx(0.503413)
    found = {r["source"]: r["mae"] for r in sixteen.fixed_viewpoint_accuracy(datetime(2000, 1, 2, tzinfo=UTC), "Source A").collect()}
    assert found["Source A"] == pytest.approx(0) and found["Source B"] == pytest.approx(125.85325)


def test_deterministic_accuracy_is_distance(spark):
    start = datetime(2020, 1, 1, tzinfo=UTC)
    data = [(start + e * H, start + b * H - 5 * H, s, 0.5, 10.0 * e + b + i) for e in range(1, 4) for b in range(3) for i, s in enumerate("ab")]
    f = BeliefFrame.of(spark, data, SLOT, probabilistic=False)
    one = {r["source"]: r["mae"] for r in f.fixed_viewpoint_accuracy(start - 5 * H).collect()}
    assert one == {"a": 2.0, "b": 2.0}
    both = BeliefFrame.of(spark, data, SLOT).fixed_viewpoint_accuracy(start - 5 * H)
    assert {r["source"]: pytest.approx(r["mae"]) for r in both.collect()} == one
    same_at_every_horizon(f)
    zero = BeliefFrame.of(spark, [(start, start, "a", 0.5, 1.0), (start, start + H, "a", 0.5, 0.0)], SLOT, probabilistic=False)
    assert zero.fixed_viewpoint_accuracy(start).first()["mape"] is None


def same_at_every_horizon(frame, **options):
    """Accuracy by horizon is the rolling viewpoint's, at each horizon and for each source."""
    number = lambda x: None if x is None else pytest.approx(x, abs=1e-9)
    found = {}
    for r in frame.accuracy(**options).collect():
        found.setdefault(r["horizon"], {})[r["source"]] = tuple(r)[2:]
    assert found
    for horizon, by_source in list(found.items())[:4]:
        alone = {r["source"]: tuple(number(x) for x in tuple(r)[1:]) for r in frame.rolling_viewpoint_accuracy(horizon, **options).collect()}
        assert by_source == alone


def test_accuracy_of_probabilistic_beliefs_by_horizon(spark, sixteen):
    same_at_every_horizon(sixteen, reference_source="Source A")
    same_at_every_horizon(sixteen)
    same_at_every_horizon(sixteen, reference_source="Source B", lite=True)
    found = {(r["horizon"], r["source"]): r["mae"] for r in sixteen.accuracy(reference_source="Source A").collect()}
    # The documented scores at these horizons.
    assert found[(timedelta(days=2, hours=9, minutes=15), "Source A")] == pytest.approx(1.4821, abs=1e-4)
    assert found[(timedelta(days=2, hours=9, minutes=15), "Source B")] == pytest.approx(125.8533, abs=1e-4)
    assert found[(timedelta(days=2, hours=8, minutes=15), "Source A")] == pytest.approx(0.0)


def test_running_sums_and_neighbours(spark):
    from credence.operators.running import neighbours, running_sums

    data = [("g", i * 7 % 101, float(i) if i % 3 else None) for i in range(101)]
    df = spark.createDataFrame(data, "g string, at long, v double")
    sums = {r["at"]: r["v_sum"] for r in running_sums(df, ["g"], "at", ["v"], 10).collect()}
    near = {r["at"]: (r["v_before"], r["v_after"]) for r in neighbours(df, ["g"], "at", ["v"], 10).collect()}
    ordered = sorted((a, v) for _, a, v in data)
    for i, (a, v) in enumerate(ordered):
        past, ahead = [x for _, x in ordered[: i + 1] if x is not None], [x for _, x in ordered[i:] if x is not None]
        assert near[a] == (past[-1] if past else None, ahead[0] if ahead else None)
        assert (sums[a] or 0) == sum(past)


def test_unchanged_compares_with_a_belief_without_value(spark):
    start = datetime(2020, 1, 2, tzinfo=UTC)
    data = [(start, start - 3 * H, "a", 0.5, 1.0), (start, start - 2 * H, "a", 0.5, None), (start, start + 9 * H, "a", 0.5, 1.0)]
    f = BeliefFrame.of(spark, data, SLOT, probabilistic=False)
    for flags in ((True, True), (True, False), (False, True), (False, False)):
        assert f.unchanged(include_positive_horizons=flags[0], include_non_positive_horizons=flags[1]).isEmpty()
    known = f._with(f.df.where("event_value is not null"))
    assert known.unchanged(include_positive_horizons=True, include_non_positive_horizons=False).count() == 1
    assert known.unchanged(include_positive_horizons=False, include_non_positive_horizons=True).isEmpty()
    assert known.unchanged(include_positive_horizons=False, include_non_positive_horizons=False).count() == 1


def test_means_of_readings(spark):
    df = spark.sql("SELECT array(named_struct('cp', 0.25D, 'v', 1D), named_struct('cp', 0.75D, 'v', 3D)) AS cdf")
    from credence.functions import cdf as C

    row = df.select(*(C.mean(F.col("cdf"), d).alias(d) for d in ("uniform", "discrete", "normal"))).first()
    assert row["discrete"] == pytest.approx(0.25 * 1 + 0.75 * 3) and row["normal"] == pytest.approx(2.0)
    assert row["uniform"] == pytest.approx(0.25 * 1 + 0.5 * 2 + 0.25 * 3)


def test_references(spark, sixteen):
    assert sixteen.set_reference_values(kind="median").count() == 40
    full = sixteen.set_reference_values(source="Source A")
    assert full.where("reference_value is not null").count() > 0
    with pytest.raises(ValueError):
        scoring.reference(sixteen.horizons, belief_time=datetime(2000, 1, 1, tzinfo=UTC), belief_horizon=H)
    with pytest.raises(KeyError):
        scoring.require_source(sixteen.df, "nobody")
    means = {r["source"]: r["reference"][0]["v"] for r in scoring.reference(sixteen.horizons, kind="mean", probabilistic=True).where("event_start = '2000-01-03 09:00'").collect()}
    assert means["Source A"] == pytest.approx(100) and means["Source B"] == pytest.approx(25)


def test_partial_cdf(spark):
    df = spark.createDataFrame([([(0.5, 30.0), (1.0, 40.0)],)], "cdf array<struct<cp:double,v:double>>")
    out = df.select(C.partial(F.col("cdf"), F.lit(0.4), F.lit(1.0)).alias("p")).first()["p"]
    assert [(round(p["cp"], 9), p["v"]) for p in out] == [(round(1 / 6, 9), 30.0), (1.0, 40.0)]


# resampling --------------------------------------------------------------------------


def test_joint_beliefs_by_two_hours(sixteen):
    out = sixteen.resample_events("PT2H").df.where("source = 'Source A' and belief_time = '2000-01-01'").orderBy("event_start", "cumulative_probability")
    found = [(r["event_start"].hour, round(r["cumulative_probability"], 6), r["event_value"]) for r in out.collect()]
    expected = [(9, 0.1587, 90.0), (9, 0.5, 100.0), (9, 1.0, 110.0), (10, 0.025186, 225.0), (10, 0.07935, 235.0), (10, 0.133514, 240.0), (10, 0.212864, 245.0), (10, 0.32935, 250.0), (10, 0.4087, 255.0), (10, 0.57935, 260.0), (10, 0.75, 265.0), (10, 1.0, 275.0), (12, 0.1587, 360.0), (12, 0.5, 400.0), (12, 1.0, 440.0)]
    assert found == [(h, pytest.approx(p, abs=1e-6), v) for h, p, v in expected]
    native = resample.join_beliefs(propagate.align_belief_times(sixteen.df), timedelta(minutes=15), 2 * H, native_pairs=True)
    assert native.where("source = 'Source A' and belief_time = '2000-01-01'").count() == 15


def test_downsample_to_days_is_named_by_the_earliest_event(spark):
    grid = examples.grid_beliefs(spark, SLOT, 4, 3, 2, 1, datetime(2000, 1, 3, 9, tzinfo=UTC))
    day = grid.resample_events("P1D")
    assert sorted(rows(day.df, "event_value")) == sorted((1500.0 + 100 * b + 10 * s,) for b in range(3) for s in range(2))
    assert {r[0] for r in rows(day.df, "event_start")} == {datetime(2000, 1, 3, 9)}
    two = day.resample_events("P2D")
    assert two.df.count() == 6 and two.event_resolution == timedelta(days=2)
    assert two.resample_events("P1D").df.count() == 12


@pytest.mark.parametrize("first", [6, 7])
@pytest.mark.parametrize("hours, n", [(1, 6), (2, 3), (3, 2)])
def test_downsample_begins_at_the_first_event(spark, first, hours, n):
    start = datetime(2026, 2, 4, tzinfo=UTC) + first * H
    f = BeliefFrame.of(spark, [(start + i * H, start, "toy", 0.5, float(i)) for i in range(6)], Sensor("s", event_resolution=H))
    out = resample.downsample(f.df, hours * H).orderBy("event_start").collect()
    assert len(out) == n and out[0]["event_start"].hour == first
    assert all(b["event_value"] - a["event_value"] == hours for a, b in zip(out, out[1:]))


def test_upsample_leaves_gaps(spark):
    start = datetime(2021, 6, 3, 8, tzinfo=UTC)
    f = BeliefFrame.of(spark, [(start, start, "a", 0.5, 8.0), (start + 3 * H, start, "a", 0.5, 14.0), (start + 5 * H, start, "a", 0.5, None)], Sensor("s", event_resolution=H / 2))
    out = sorted(rows(f.resample_events("10min").df, "event_start", "event_value"))
    at = lambda m: datetime(2021, 6, 3, 8) + timedelta(minutes=m)
    assert out == [(at(m), 8.0) for m in (0, 10, 20)] + [(at(180 + m), 14.0) for m in (0, 10, 20)]
    assert f.resample_events("10min", keep_nulls=True).df.where("event_value is null").count() == 3
    assert f.resample_events("15min", method="sum").df.agg(F.sum("event_value")).first()[0] == 22.0


def test_to_instants(spark):
    grid = examples.grid_beliefs(spark, SLOT, 4, 1, 1, 1, datetime(2000, 1, 3, 9, tzinfo=UTC))
    out = grid.resample_events(timedelta(0))
    found = sorted(rows(out.df, "event_start", "event_value"))
    assert [v for _, v in found] == [0, 0, 1000, 1000, 2000, 2000, 3000, 3000] and found[1][0] == datetime(2000, 1, 3, 9, 15)
    near = BeliefFrame.of(spark, [(datetime(2000, 1, 1, h, tzinfo=UTC), datetime(2000, 1, 1, tzinfo=UTC), "a", 0.5, float(h)) for h in (0, 1)], Sensor("s", event_resolution=H))
    at_one = lambda policy: resample.to_instantaneous(near.df, H, policy).where("hour(event_start) = 1").first()["event_value"]
    assert [at_one(p) for p in ("first", "min", "max")] == [1.0, 0.0, 1.0]


INSTANTS = [
    ("2022-01-01 22:00+01:00", 7, 2, "asfreq", [1, 3, 5, 7]),
    ("2022-01-01 23:00+01:00", 8, 2, "asfreq", [2, 4, 6, 8]),
    ("2022-01-01 23:00+01:00", 8, 2, "first", [1, 2, 4, 6, 8]),
    ("2022-01-01 23:00+01:00", 8, 2, "max", [1, 3, 5, 7, 8]),
    ("2022-01-01 22:00+01:00", 7, 0.5, "asfreq", [1, 2, 3, 4, 5, 6, 7]),
    ("2022-01-01 22:00+01:00", 7, 0.5, "interpolate", [1 + i / 2 for i in range(13)]),
    ("2022-01-01 22:00+01:00", 7, 0.5, "ffill", [1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 7]),
    ("2022-03-27 00:00+01:00", 8, 2, "asfreq", [1, 4, 6, 8]),
    ("2022-03-27 01:00+01:00", 7, 2, "first", [1, 3, 5, 7]),
    ("2022-03-27 00:00+01:00", 5, 0.5, "ffill", [1, 1, 2, 2, 3, 3, 4, 4, 5]),
    ("2022-03-27 00:00+01:00", 8, 1.5, "first", [1, 3, 3, 5, 6, 8]),
    ("2022-03-27 00:00+01:00", 8, 3, "first", [1, 3, 6]),
    ("2022-03-26 00:00+01:00", 72, 12, "first", [1, 13, 25, 36, 48, 60, 72]),
    ("2022-03-26 00:00+01:00", 72, 24, "first", [1, 25, 48, 72]),
    ("2022-03-26 01:00+01:00", 69, 24, "asfreq", [24, 47]),
    ("2022-10-30 00:00+02:00", 7, 2, "asfreq", [1, 3, 4, 6]),
    ("2022-10-30 01:00+02:00", 7, 2, "first", [1, 2, 3, 5, 7]),
    ("2022-10-30 00:00+02:00", 8, 1.5, "first", [1, 3, 5, 7, 8]),
    ("2022-10-30 00:00+02:00", 8, 3, "first", [1, 5, 8]),
    ("2022-10-29 00:00+02:00", 72, 12, "first", [1, 13, 25, 38, 50, 62]),
    ("2022-10-29 00:00+02:00", 72, 24, "first", [1, 25, 50]),
]


@pytest.mark.parametrize("start, n, hours, method, expected", INSTANTS)
def test_instants_keep_step_with_midnight(spark, start, n, hours, method, expected):
    first = datetime.fromisoformat(start)
    df = spark.createDataFrame([("s", "a", first + i * H, float(i + 1)) for i in range(n)], "sensor string, source string, event_start timestamp, event_value double")
    out = instantaneous.resample_instantaneous(df, hours * H, method, "Europe/Amsterdam").orderBy("event_start")
    assert [r["event_value"] for r in out.collect()] == expected


# propagation, lineage, distributions -------------------------------------------------


def test_propagate_and_align(spark):
    at = datetime(2020, 1, 1, tzinfo=UTC)
    f = BeliefFrame.of(spark, [(at, at, "a", 0.5, 1.0), (at, at + H, "a", 0.5, None), (at + H, at + H, "a", 0.5, 3.0)], SLOT)
    assert sorted(rows(f.propagate().df, "event_value")) == [(1.0,), (1.0,), (3.0,)]
    assert f.align_belief_times().df.count() == 3
    wide = propagate.to_wide(f.df.where("event_value is not null"), [0.5])
    assert "event_value_0.5" in wide.columns and propagate.to_long(wide).count() == 2


def test_lineage(sixteen):
    known = sixteen.lineage
    assert known["number_of_beliefs"] == known["number_of_probabilistic_beliefs"] == 16
    assert known["probabilistic_depth"] == (8 * 3 + 8 * 2) / 16 and known["number_of_events"] == 4
    empty = BeliefFrame.empty(sixteen.df.sparkSession, SLOT).lineage
    assert empty["percentage_of_deterministic_beliefs"] == 1 and empty["percentage_of_probabilistic_beliefs"] == 0


def test_event_frequency(spark):
    start = datetime(2020, 1, 1, tzinfo=UTC)
    f = BeliefFrame.of(spark, [(start + timedelta(minutes=m), start, "a", 0.5, 1.0) for m in (0, 15, 30, 90, 105)], SLOT)
    quarter = timedelta(minutes=15)
    assert lineage.event_frequency(f.df, H).first()["frequency"] is None
    assert lineage.most_common_event_frequency(f.df, H).first()["frequency"] == quarter
    assert lineage.event_frequency(f.df.limit(1), H).first()["frequency"] == H
    assert lineage.irregular_starts(f.df).isEmpty()


def test_joint_equals_brute_force():
    rng = np.random.default_rng(1)
    pdfs = [[(float(v), float(p)) for v, p in zip(rng.integers(0, 4, 3), np.full(3, 1 / 3))] for _ in range(3)]
    brute = {}
    for a, p in pdfs[0]:
        for b, q in pdfs[1]:
            for c, r in pdfs[2]:
                brute[a + b + c] = brute.get(a + b + c, 0) + p * q * r
    found = joint.joint_pandas(pdfs, mean=False)
    assert [v for v, _ in found] == sorted(brute)
    assert np.diff([0] + [cp for _, cp in found]) == pytest.approx([brute[v] for v in sorted(brute)])
    drawn = joint.joint_pandas(pdfs, mean=False, support=1, draws=20000)
    assert sum(v * p for (v, _), p in zip(drawn, np.diff([0] + [cp for _, cp in drawn]))) == pytest.approx(sum(v * p for v, p in brute.items()), abs=0.1)
    together = joint.joint_pandas([[(0.0, 0.5), (1.0, 0.5)]] * 2, False, np.array([[1, 0.999999], [0.999999, 1]]), draws=4000)
    assert dict(together)[0.0] == pytest.approx(0.5, abs=0.05)


def test_convolution_in_columns(spark):
    df = spark.createDataFrame([([(0.5, 0.0), (1.0, 1.0)], [(0.25, 0.0), (1.0, 1.0)])], "a array<struct<cp:double,v:double>>, b array<struct<cp:double,v:double>>")
    out = df.select(joint.convolve(joint.points(F.col("a")), joint.points(F.col("b"))).alias("j")).first()["j"]
    assert [(p["v"], p["p"]) for p in out] == [(0.0, 0.125), (1.0, 0.5), (2.0, 0.375)]


def test_normal_through_two_points(spark):
    df = spark.createDataFrame([([(0.1587, 90.0), (0.5, 100.0)],)], "cdf array<struct<cp:double,v:double>>")
    n = df.select(C.normal(F.col("cdf")).alias("n")).first()["n"]
    assert n["mu"] == pytest.approx(100) and n["sigma"] == pytest.approx(10.0018, abs=1e-3)


def test_equal_bins(spark):
    df = spark.createDataFrame([("a", 0.5, 1.0), ("a", 1.0, 3.0), ("b", 1.0, 2.0)], "k string, cumulative_probability double, event_value double")
    assert sorted(rows(joint.equalize_bins(df, "k"), "k", "event_value", "cumulative_probability")) == [("a", 1.0, 0.5), ("a", 2.0, 0.5), ("a", 3.0, 1.0), ("b", 1.0, 0.0), ("b", 2.0, 1.0), ("b", 3.0, 1.0)]


# forecasts, charts -------------------------------------------------------------------


def test_forecasts(spark):
    start = datetime(2020, 1, 1, tzinfo=UTC)
    sensor = Sensor("s", event_resolution=H)
    f = BeliefFrame.of(spark, [(start + i * H, start + i * H, "a", 0.5, 100.0 * (i + 1)) for i in range(4)], sensor)
    ask = lambda **o: {r["event_value"] for r in f.form_beliefs(start + 3 * H, "n", (start + 4 * H, start + 6 * H), **o).df.collect()}
    assert ask() == {400.0} and ask(forecaster="mean") == {250.0}
    assert ask(season=2) == {300.0, 400.0}
    assert ask(forecaster=lambda past, asked: [past["event_value"].min()] * len(asked)) == {100.0}
    assert f.form_beliefs(start - H, "n", (start, start + H)).df.first()["event_value"] is None
    with pytest.raises(NotImplementedError):
        f.form_beliefs(start + 9 * H, "n", (start, start + H))
    with pytest.raises(NotImplementedError):
        f.append(f._with(f.df.withColumn("source", F.lit("b")))).form_beliefs(start + 3 * H, "n", (start + 4 * H, start + 6 * H))


def test_charts(sixteen):
    band = sixteen.confidence_bands(ci=0.9, reference_source="Source A").where("source = 'Source A' and event_start = '2000-01-03 09:00' and belief_time = '2000-01-01'").first()
    assert (band["lower_value"], band["expected_value"], band["upper_value"]) == (90.0, 100.0, 110.0)
    assert plotdata.human_unit(timedelta(days=5))[0] == "days" and plotdata.human_unit(timedelta(hours=5))[0] == "hours"
    assert not plotdata.density_points(sixteen.df, 0, 200, 11).isEmpty()
    assert not plotdata.accuracy_by_event(sixteen.make_deterministic().horizons).isEmpty()


# store and files ---------------------------------------------------------------------


def test_store(spark, sixteen, tmp_path):
    store = BeliefStore(spark, str(tmp_path / "store"))
    store.add_sensor(sixteen.sensor)
    store.add(sixteen.df, sixteen.sensor)
    found = store.search(1)
    assert found.count() == 40 and store.sources.count() == 2
    assert found.select(sixteen.df.columns).exceptAll(sixteen.df).isEmpty()
    with pytest.raises(DuplicateBelief):
        store.add(sixteen.df, sixteen.sensor)
    store.add(sixteen.df.limit(3).withColumn("event_value", F.lit(-1.0)), sixteen.sensor, allow_overwrite=True)
    assert store.search(1).count() == 40 and store.search(1).where("event_value = -1").count() == 3
    with pytest.raises(ValueError):
        store.search(99)
    bounds = dict(event_starts_after=datetime(2000, 1, 3, 10, tzinfo=UTC), beliefs_before=datetime(2000, 1, 1, tzinfo=UTC), source="Source B")
    after = store.search(1).where("event_start >= '2000-01-03 10:00' and belief_time <= '2000-01-01' and source = 'Source B'")
    assert store.search(1, **bounds).exceptAll(after).isEmpty() and store.search(1, **bounds).count() == after.count() == 6
    assert store.search(1, source=[]).isEmpty()
    assert store.search(1, most_recent_beliefs_only=True).count() == 20
    assert store.search(1, most_recent_events_only=True).select("event_start").distinct().count() == 1
    assert store.search(1, most_recent_beliefs_only=True, most_recent_events_only=True, source="Source A").count() == 1


def test_touching_events_stay_out(spark):
    start = datetime(2020, 1, 1, tzinfo=UTC)
    sensor = Sensor("s", event_resolution=H, id=1)
    df = BeliefFrame.of(spark, [(start + i * H, start, "a", 0.5, 1.0) for i in range(4)], sensor).in_horizon_form()
    hours = lambda **o: sorted(r["event_start"].hour for r in search(df, sensor, **o).collect())
    assert hours(event_ends_after=start + H) == [1, 2, 3]
    assert hours(event_starts_before=start + 2 * H) == [0, 1]
    assert hours(event_ends_before=start + 2 * H) == [0, 1]


def test_files(spark, sixteen, tmp_path):
    path = str(tmp_path / "local.csv")
    times = ["00:00", "01:00", "02:00", "02:00", "03:00", "04:00"]
    with open(path, "w") as f:
        f.write("datetime,value,sensor\n" + "".join(f"2021-10-31 {t}:00,{i},A\n" for i, t in enumerate(times)) + "2021-10-31 05:00:00,9,B\n")
    sensor = Sensor("A", event_resolution=H, timezone="Europe/Amsterdam")
    read = lambda **o: files.read_beliefs(spark, path, sensor, **({"source": "file", "belief_horizon": timedelta(0), "timezone": "Europe/Amsterdam", "filter_by_column": {"sensor": "A"}} | o))
    assert read().select("event_start").distinct().count() == 6
    assert read(event_starts_before=datetime(2021, 10, 31, 0, tzinfo=UTC)).count() == 2
    assert read(transformations=[{"func": "mul", "args": [2]}]).agg(F.sum("event_value")).first()[0] == 30
    with pytest.raises(TypeError):
        read(timezone=None).collect()
    with pytest.raises(ValueError):
        read(source=None)
    with pytest.raises(TypeError):
        files.read_table(spark, "x.txt")
    out = str(tmp_path / "out.csv")
    files.write_csv(sixteen.df.drop("sensor"), out)
    back = files.read_beliefs(spark, out, sixteen.sensor, sources=["Source A", "Source B"])
    assert back.count() == 40 and back.select(sixteen.df.columns).exceptAll(sixteen.df).isEmpty()
    with pytest.raises(ValueError):
        files.read_beliefs(spark, out, sixteen.sensor, sources=["Source A"])


def test_irregular_files_are_rejected(spark, tmp_path):
    path = str(tmp_path / "odd.csv")
    with open(path, "w") as f:
        f.write("t,v\n" + "".join(f"2021-01-01T{t}:00+00:00,1\n" for t in ("00:00", "01:00", "02:00", "02:20")))
    with pytest.raises(ValueError, match="1 events"):
        files.read_beliefs(spark, path, Sensor("s", event_resolution=H), source="a", belief_horizon=H)


def test_series(spark):
    series = pd.Series([1.0, 2.0], index=pd.date_range("2020-01-01", periods=2, freq="h", tz="UTC"))
    assert files.load_time_series(spark, series, Sensor("s", event_resolution=H), "a", H).count() == 2


def test_streamed_latest_beliefs(spark, sixteen, tmp_path):
    """All points, over several batches in update mode; a far event doesn't end updates of nearer ones."""
    from credence.streaming.latest import latest_beliefs

    source, schema = tmp_path / "in", sixteen.df.schema
    source.mkdir()
    day = lambda d, h=0: datetime(2000, 1, d, h, tzinfo=UTC)
    batches = [
        [("s", day(11), day(1), "a", 0.5, 1.0), ("s", day(2), day(1), "a", 0.2, 2.0), ("s", day(2), day(1), "a", 0.8, 3.0)],
        [("s", day(2), day(1, 1), "a", 0.3, 4.0), ("s", day(2), day(1, 1), "a", 0.9, 5.0), ("s", day(3), day(1, 2), "a", 0.5, 6.0)],
        [("s", day(2), day(1, 1), "a", 1.0, 7.0), ("s", day(3), day(1, 1), "a", 0.5, 8.0), ("s", day(4), day(9), "a", 0.5, 9.0)],
        [("s", day(2), day(2), "a", 0.5, 10.0), ("s", day(11), day(10), "a", 0.5, 11.0)],  # the first is later than late_by allows
    ]
    stream = spark.readStream.schema(schema).parquet(str(source))
    seen = []

    def write(df, batch):
        seen.append(sorted((r["event_start"].day, r["belief_time"].hour, r["cumulative_probability"], r["event_value"]) for r in df.collect()))

    for i, rows_ in enumerate(batches):
        columns = [f.name for f in schema]
        by = dict(zip(("sensor", "event_start", "belief_time", "source", "cumulative_probability", "event_value"), zip(*rows_)))
        spark.createDataFrame(list(zip(*(by[c] for c in columns))), schema).coalesce(1).write.mode("append").parquet(str(source))
        q = latest_beliefs(stream, "3 days").writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    out = [x for x in seen if x]
    assert out[0] == [(2, 0, 0.2, 2.0), (2, 0, 0.8, 3.0), (11, 0, 0.5, 1.0)]
    assert out[1] == [(2, 1, 0.3, 4.0), (2, 1, 0.9, 5.0), (3, 2, 0.5, 6.0)]
    assert out[2] == [(2, 1, 0.3, 4.0), (2, 1, 0.9, 5.0), (2, 1, 1.0, 7.0), (4, 0, 0.5, 9.0)]
    assert out[3] == [(11, 0, 0.5, 11.0)]


def test_repeated_local_hours(spark):
    from credence.sources.files import localize

    day = lambda h, m: datetime(2020, 10, 25, h, m, tzinfo=UTC)
    two = [(0, day(2, 30), "x"), (1, day(2, 30), "y"), (2, day(3, 30), "x"), (3, day(1, 30), "x"), (4, day(2, 30), "x")]
    df = spark.createDataFrame(two, "_line long, t timestamp, belief_time string")
    got = {r["_line"]: (r["t"].hour, r["t"].minute) for r in localize(df, "t", "Europe/Amsterdam", "_line", ["belief_time"]).collect()}
    # Two beliefs about one local time are about one event; the same belief's second time is an hour later.
    assert got == {0: (0, 30), 1: (0, 30), 2: (2, 30), 3: (23, 30), 4: (1, 30)}


def test_days_before_months(spark, tmp_path):
    from credence.sources.files import read_beliefs

    (tmp_path / "d.csv").write_text("when,value\n05/01/2020 10:00,1\n5-1-2020 11:00,2\n")
    df = read_beliefs(spark, str(tmp_path / "d.csv"), Sensor("s", event_resolution=H), source="a", belief_horizon=timedelta(0), timezone="UTC", dayfirst=True)
    assert sorted(r["event_start"] for r in df.collect()) == [datetime(2020, 1, 5, 10), datetime(2020, 1, 5, 11)]


def test_upsert_of_repeated_keys_keeps_the_largest_value(spark, tmp_path):
    from credence.sources.store import BeliefStore

    start = datetime(2020, 1, 1, tzinfo=UTC)
    sensor = Sensor("s", event_resolution=H, id=1)
    store = BeliefStore(spark, str(tmp_path / "store"))
    for values in ([1.0, 5.0, None], [2.0]):
        df = BeliefFrame.of(spark, [(start, start, "a", 0.5, v) for v in values], sensor).df.drop("sensor")
        store.add(df, sensor, allow_overwrite=True)
        assert [r["event_value"] for r in store.search(sensor).collect()] == [max(v for v in values if v is not None)]
    assert sorted(x.name for x in (tmp_path / "store").iterdir() if not x.name.startswith(".")) == ["beliefs", "sources"]


def test_horizons_are_counted(sixteen):
    counts = lineage.stats(sixteen.horizons).first()
    assert counts["number_of_belief_horizons"] == 5 and counts["number_of_beliefs"] == 16


def test_chart_specifications(sixteen):
    from credence.operators import charts

    spec = charts.time_series(sixteen.df, reference_source="Source A", show_accuracy=True)
    assert len(spec["data"]["values"]) == 16 and len(spec["layer"]) == 4
    one = sixteen.df.where("source = 'Source A'")
    assert charts.ridgeline_fixed_viewpoint(one, datetime(2000, 1, 2, tzinfo=UTC), (0, 500))["data"]["values"]
    assert charts.ridgeline_belief_history(one, datetime(2000, 1, 3, 9, tzinfo=UTC), (0, 500), "uniform")["encoding"]["row"]["field"] == "belief_time"
    assert charts.horizon_axis(sixteen.horizons)[0] == "minutes" or charts.horizon_axis(sixteen.horizons)[0] == "hours"
    with pytest.raises(ValueError):
        charts.ridgeline_fixed_viewpoint(sixteen.df, datetime(2000, 1, 2, tzinfo=UTC), (0, 500))
    with pytest.raises(ValueError):
        charts.time_series(sixteen.df, show_accuracy=True)


def test_sub_events_and_levels(spark):
    start = datetime(2020, 1, 1, tzinfo=UTC)
    f = BeliefFrame.of(spark, [(start, start, "a", 0.5, 1.0), (start + timedelta(minutes=30), start, "a", 0.5, 2.0)], SLOT)
    whole = lineage.respect_event_resolution(f.df, H, timedelta(minutes=15))
    assert whole.count() == 4 and whole.where("event_value is null").count() == 2
    asked = spark.createDataFrame([(start,), (start + 9 * H,)], "event_start timestamp")
    assert sorted(r["event_value"] is None for r in lineage.replace_level(f.df, "event_start", asked).collect()) == [False, True]
    assert lineage.time_grid(spark, start, start + H, timedelta(minutes=15)).count() == 4
    assert lineage.unique(f.df, "source").count() == 1 and lineage.unique_beliefs_per_event_per_source(f.df)
