"""Further queries: forms of frames, other aggregates of instants, references, functions over groups, files and streams."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import functions as F

from credence.frame import BeliefFrame
from credence.operators import instantaneous, joint, lineage, plotdata, propagate, resample, scoring
from credence.operators import viewpoint as V
from credence.plans import adapters as A
from credence.plans.queries import AT, BELIEF, HOUR, KEYS, MOMENT, ROWS, ROUNDED, SCORES, T, TRUTH, TRUTH_S0, _accuracy, _instant_bins, latest_sql, query, shared_folder, times, with_


def also(parts: str, select: str) -> str:
    """A WITH clause of the adapters' parts and more of its own."""
    return with_(parts, f", {select}").replace(") ,", "),")


# forms --------------------------------------------------------------------------

POINTS = f"w AS (SELECT sensor, event_start, source, event_value FROM ({latest_sql('b')}))"


def _by_source(spark, sf_dir):
    """The latest values of three sources, taken as three points of one belief."""
    cp = F.when(F.col("source") == "S0", 0.25).when(F.col("source") == "S1", 0.5).otherwise(0.75)
    latest = V.most_recent(A.deterministic(spark, sf_dir))
    return latest.select("sensor", "event_start", F.lit("all").alias("source"), cp.alias("cumulative_probability"), "event_value")


@query(also("b", f"{POINTS} SELECT sensor, {T.format('event_start', 'event_start')}, 'all' AS source, " + ", ".join(f"round(max(event_value) FILTER (source = '{s}'), 6) AS event_value_{c}" for s, c in (("S0", "0_25"), ("S1", "0_5"), ("S2", "0_75"))) + " FROM w GROUP BY w.sensor, w.event_start"))
def wide_form(spark, sf_dir):
    """A column for each cumulative probability."""
    wide = propagate.to_wide(_by_source(spark, sf_dir), [0.25, 0.5, 0.75])
    return wide.toDF(*(c.replace(".", "_") for c in wide.columns))


@query(also("b", f"{POINTS} SELECT sensor, {T.format('event_start', 'event_start')}, 'all' AS source, round(CASE source WHEN 'S0' THEN 0.25 WHEN 'S1' THEN 0.5 ELSE 0.75 END, 6)::DOUBLE AS cumulative_probability, round(event_value, 6) AS event_value FROM w"))
def long_form(spark, sf_dir):
    """Columns by cumulative probability back to rows."""
    return propagate.to_long(propagate.to_wide(_by_source(spark, sf_dir), [0.25, 0.5, 0.75]))


@query(with_("b", f"SELECT sensor, {T.format('event_start + INTERVAL 6 HOUR', 'event_end')}, {T.format('belief_time + INTERVAL 1 HOUR', 'belief_time')}, source, round(event_value, 6) AS event_value FROM b"))
def event_ends_in_local_time(spark, sf_dir):
    """Events by their ends, belief times in a zone's wall time."""
    b = A.deterministic(spark, sf_dir)
    return b.select("sensor", (F.col("event_start") + F.lit(A.EVENTS.event_resolution)).alias("event_end"), F.from_utc_timestamp("belief_time", "Europe/Amsterdam").alias("belief_time"), "source", "event_value")


def _step(how: str) -> str:
    ratio = "epoch_us(ts) / 21600000000.0"
    return {"floor": f"floor({ratio})", "ceil": f"ceil({ratio})", "round": f"round_even({ratio}, 0)"}[how]


for _how in ("floor", "ceil", "round"):
    query(f"SELECT {T.format('ts', 'event_start')}, {T.format(f'make_timestamp(({_step(_how)} * 21600000000)::BIGINT)', 'moved')} FROM events", f"event_starts_{_how}")(
        lambda spark, sf_dir, how=_how: A.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("event_start"), resample.rounded(F.col("ts").cast("timestamp"), 6 * HOUR, how).alias("moved"))
    )


STARTS = "event_start < TIMESTAMP '2024-01-02'"


@query(also("h", f"f AS (SELECT sensor FROM h ORDER BY event_start, sensor LIMIT 1) SELECT sensor, {T.format('event_start', 'event_start')}, {T.format(BELIEF, 'belief_time')}, 'S' AS source, 0.5::DOUBLE AS cumulative_probability, round(event_value, 6) AS event_value FROM (SELECT * FROM h WHERE {STARTS} UNION ALL SELECT sensor, unnest([TIMESTAMP '2023-06-01', TIMESTAMP '2023-06-02']), NULL FROM f)"))
def replace_event_starts(spark, sf_dir):
    """Events of all sensors limited to some starts, with null rows for new ones."""
    h = A.hourly(spark, sf_dir)
    new = spark.createDataFrame([(datetime(2023, 6, d, tzinfo=timezone.utc),) for d in (1, 2)], "event_start timestamp")
    return lineage.replace_level(h, "event_start", h.where("event_start < timestamp '2024-01-02'").select("event_start").union(new))


# propagation and splitting ----------------------------------------------------------


@query(also("b", f"g AS (SELECT i * 3600000000 AS hz FROM range(-18, 7) AS q(i)), k AS (SELECT sensor, event_start, source, max(horizon) AS oldest FROM b GROUP BY ALL), a AS (SELECT sensor, event_start, source, hz FROM k JOIN g ON hz <= oldest UNION SELECT sensor, event_start, source, horizon FROM b) SELECT a.sensor, {T.format('a.event_start', 'event_start')}, a.source, hz / 1e6 AS belief_horizon, 0.5::DOUBLE AS cumulative_probability, round(min_by(event_value, horizon), 6) AS event_value FROM a JOIN b ON a.sensor = b.sensor AND a.event_start = b.event_start AND a.source = b.source AND b.horizon >= hz GROUP BY a.sensor, a.event_start, a.source, hz"))
def align_belief_horizons(spark, sf_dir):
    """Every event and source at every whole hour's horizon besides its own."""
    h = spark.createDataFrame([(HOUR * i,) for i in range(-18, 7)], "horizon interval day to second")
    return propagate.align_belief_horizons(A.horizons(A.deterministic(spark, sf_dir)), h)


@query(also("bp", f"l AS ({latest_sql('p')}) SELECT sensor, {T.format('event_start + i * INTERVAL 6 HOUR', 'event_start')}, {T.format('belief_time', 'belief_time')}, source, round(cumulative_probability, 6) AS cumulative_probability, round(event_value, 6) AS event_value FROM l, range(4) AS r(i)"))
def split_beliefs(spark, sf_dir):
    """Probabilistic beliefs about days, split into quarters of a day."""
    p = V.most_recent(A.probabilistic(spark, sf_dir), probabilistic=True)
    return resample.split_beliefs(p, timedelta(days=1), timedelta(hours=6))


@query(also("bp", f"l AS ({latest_sql('p')}), g AS (SELECT k.sensor, k.event_start, k.source, v.event_value FROM (SELECT DISTINCT sensor, event_start, source FROM l) k JOIN (SELECT DISTINCT sensor, event_start, event_value FROM l) v USING (sensor, event_start)) SELECT g.sensor, {T.format('g.event_start', 'event_start')}, g.source, round(g.event_value, 6) AS event_value, round(coalesce(last_value(cumulative_probability IGNORE NULLS) OVER (PARTITION BY g.sensor, g.event_start, g.source ORDER BY g.event_value ROWS UNBOUNDED PRECEDING), 0), 6) AS cumulative_probability FROM g LEFT JOIN l ON l.sensor = g.sensor AND l.event_start = g.event_start AND l.source = g.source AND l.event_value = g.event_value"))
def equal_bins(spark, sf_dir):
    """The sources' distributions of each event on common values."""
    p = V.most_recent(A.probabilistic(spark, sf_dir), probabilistic=True)
    return joint.equalize_bins(p.select("sensor", "event_start", "source", "cumulative_probability", "event_value"), "source", ("sensor", "event_start"))


# other aggregates of instants ---------------------------------------------------------

AGGREGATES = {
    "mean": "avg(event_value)", "min": "min(event_value)", "sum": "sum(event_value)", "count": "count(event_value)", "last": "last(event_value ORDER BY event_start)",
    "median": "quantile_cont(event_value, 0.5)", "std": "stddev_samp(event_value)", "nunique": "count(DISTINCT event_value)",
    "sem": "stddev_samp(event_value) / sqrt(count(event_value))", "size": "count(*)",
}
for _method, _value in AGGREGATES.items():
    query(f"SELECT * FROM ({_instant_bins(_value, 6)}) WHERE event_value IS NOT NULL", f"instantaneous_{_method}")(
        lambda spark, sf_dir, method=_method: instantaneous.resample_instantaneous(A.hourly(spark, sf_dir), 6 * HOUR, method, "Europe/Amsterdam")
    )


@query(also("h", f"e AS (SELECT sensor, min(event_start) AS a, max(event_start) AS z FROM h GROUP BY sensor), g AS (SELECT sensor, unnest(generate_series(a, z, INTERVAL 30 MINUTE)) AS t FROM e) SELECT g.sensor, 'S' AS source, {T.format('t', 'event_start')}, round(event_value, 6) AS event_value, {T.format(BELIEF, 'belief_time')}, 0.5::DOUBLE AS cumulative_probability FROM g ASOF JOIN h ON g.sensor = h.sensor AND g.t >= h.event_start"))
def instantaneous_ffill(spark, sf_dir):
    """Instants every half hour, each as the last one."""
    return instantaneous.resample_instantaneous(A.hourly(spark, sf_dir), HOUR / 2, "ffill", "Europe/Amsterdam")


@query(also("h", f"e AS (SELECT sensor, min(event_start) AS a, max(event_start) AS z FROM h GROUP BY sensor), g AS (SELECT sensor, unnest(generate_series(a, z, INTERVAL 30 MINUTE)) AS t FROM e), l AS (SELECT g.sensor, t, event_start AS t0, event_value AS v0 FROM g ASOF JOIN h ON g.sensor = h.sensor AND g.t >= h.event_start), m AS (SELECT l.*, event_start AS t1, event_value AS v1 FROM l ASOF JOIN h ON l.sensor = h.sensor AND l.t <= h.event_start) SELECT sensor, 'S' AS source, {T.format('t', 'event_start')}, round(CASE WHEN t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * ((epoch_us(t) - epoch_us(t0))::DOUBLE / (epoch_us(t1) - epoch_us(t0))) END, 6) AS event_value, {T.format(BELIEF, 'belief_time')}, 0.5::DOUBLE AS cumulative_probability FROM m"))
def instantaneous_interpolate(spark, sf_dir):
    """Instants every half hour, on the line between their neighbours."""
    return instantaneous.resample_instantaneous(A.hourly(spark, sf_dir), HOUR / 2, "interpolate", "Europe/Amsterdam")


# references and accuracy ---------------------------------------------------------------


@query(also("b", f"{TRUTH_S0}, k AS (SELECT r.*, h.horizon FROM r JOIN (SELECT DISTINCT sensor, event_start, horizon FROM b) h USING (sensor, event_start)) SELECT coalesce(b.sensor, k.sensor) AS sensor, {T.format('coalesce(b.event_start, k.event_start)', 'event_start')}, coalesce(b.source, k.source) AS source, coalesce(b.horizon, k.horizon) / 1e6 AS belief_horizon, 0.5::DOUBLE AS cumulative_probability, {T.format('belief_time', 'belief_time')}, round(event_value, 6) AS event_value, round(reference_value, 6) AS reference_value FROM b FULL JOIN k ON b.sensor = k.sensor AND b.event_start = k.event_start AND b.source = k.source AND b.horizon = k.horizon"))
def set_reference_values_full(spark, sf_dir):
    """Beliefs and the reference at every horizon of their events, joined outer."""
    return scoring.set_reference_values(A.horizons(A.deterministic(spark, sf_dir)), source="S0")


@query(_accuracy(latest_sql("b", f"belief_time <= {AT}"), f"r AS ({latest_sql('b', 'horizon >= 0', columns='sensor, event_start, source, event_value AS reference_value')})"))
def accuracy_against_a_horizon(spark, sf_dir):
    """Accuracy as of a moment, against what was believed when events could be known."""
    h = A.horizons(A.deterministic(spark, sf_dir))
    truth = scoring.deterministic_truth(h, belief_horizon=timedelta(0))
    return scoring.accuracy_of(scoring.deterministic_scores(V.fixed_viewpoint(h, MOMENT), truth))


@query(also("b", f"{TRUTH}, f AS ({latest_sql('b', f'belief_time <= {AT}')}), c AS (SELECT r.sensor, r.source, abs(f.event_value - reference_value) AS crps, reference_value FROM r LEFT JOIN f USING (sensor, event_start, source)), a AS (SELECT sensor, source, {SCORES} FROM c GROUP BY ALL) SELECT sensor, source, round(mae, 6) AS mae, round(mape, 6) AS mape, round(wape, 6) AS wape FROM a"))
def accuracy_by_sensor(spark, sf_dir):
    """Accuracy as of a moment by sensor and source."""
    return scoring.fixed_viewpoint_accuracy(A.deterministic(spark, sf_dir), MOMENT, by=("sensor", "source"))


SPANS = "w AS (SELECT *, lead(horizon) OVER (PARTITION BY sensor, event_start, source ORDER BY horizon DESC) AS newer FROM b)"


@query(also("b", f"{TRUTH}, {SPANS}, n AS (SELECT DISTINCT horizon AS hz FROM b), m AS (SELECT w.sensor, w.event_start, w.source, abs(event_value - reference_value) AS mae, reference_value FROM w JOIN n ON hz <= horizon AND (newer IS NULL OR hz > newer) JOIN r USING (sensor, event_start, source)) SELECT sensor, {T.format('event_start', 'event_start')}, source, round(avg(mae), 6) AS mae, round(avg(reference_value), 6) AS reference_value FROM m GROUP BY sensor, m.event_start, source"))
def plot_accuracy_by_event(spark, sf_dir):
    """Mean error and reference of each event and source, over all horizons that occur."""
    return plotdata.mean_accuracy_by_event(A.horizons(A.deterministic(spark, sf_dir)))


P_LATEST = f"lp AS ({latest_sql('p')})"
P_MASS = "SELECT {k}, event_value AS v, coalesce(lag(cp) OVER j, 0) AS lo, cp AS hi FROM (SELECT *, CASE WHEN cumulative_probability = max(cumulative_probability) OVER (PARTITION BY {k}) THEN 1.0 ELSE cumulative_probability END AS cp FROM {t}) WINDOW j AS (PARTITION BY {k} ORDER BY cp)"
P_KEY = "sensor, event_start, source"
SIX = "n AS (SELECT i * 21600000000 AS hz FROM range(-3, 2) AS q(i))"
HELD = "hv AS (SELECT * FROM (SELECT p.*, hz, rank() OVER (PARTITION BY hz, sensor, event_start, source ORDER BY belief_time DESC) AS rk FROM p JOIN n ON epoch_us(event_start) + 21600000000 - epoch_us(belief_time) >= hz) WHERE rk = 1)"


@query(also("bp", f"{P_LATEST}, {SIX}, {HELD}, f AS ({P_MASS.format(k='hz, ' + P_KEY, t='hv')}), r AS ({P_MASS.format(k=P_KEY, t='lp')}), o AS (SELECT f.hz, r.sensor, r.event_start, r.source, r.lo, r.hi, r.v AS rv, f.v, (least(f.hi, r.hi) - greatest(f.lo, r.lo)) / (r.hi - r.lo) AS w FROM r JOIN f ON f.sensor = r.sensor AND f.event_start = r.event_start AND f.source = r.source AND least(f.hi, r.hi) > greatest(f.lo, r.lo)), m AS (SELECT hz, {P_KEY}, lo, hi, sum(w * abs(v - rv)) AS miss FROM o GROUP BY ALL), d AS (SELECT a.hz, a.sensor, a.event_start, a.source, a.lo, sum(a.w * b.w * abs(a.v - b.v)) AS spread FROM o a JOIN o b ON a.hz = b.hz AND a.sensor = b.sensor AND a.event_start = b.event_start AND a.source = b.source AND a.lo = b.lo GROUP BY ALL), c AS (SELECT hz, {P_KEY}, sum((miss - spread / 2) * (hi - m.lo)) AS crps FROM m JOIN d USING (hz, sensor, event_start, source, lo) GROUP BY ALL), g AS (SELECT {P_KEY}, coalesce(min(event_value) FILTER (cumulative_probability >= 0.5), max(event_value)) AS reference_value FROM lp GROUP BY ALL), k AS (SELECT hz, g.*, crps FROM n CROSS JOIN g LEFT JOIN c USING (hz, sensor, event_start, source)), a AS (SELECT hz, source, {SCORES} FROM k GROUP BY ALL) SELECT hz / 1e6 AS horizon, source, round(mae, 6) AS mae, round(mape, 6) AS mape, round(wape, 6) AS wape FROM a"))
def accuracy_by_horizon_probabilistic(spark, sf_dir):
    """Accuracy of probabilistic beliefs at horizons of whole quarter days, each belief scored once."""
    h = spark.createDataFrame([(6 * HOUR * i,) for i in range(-3, 2)], "horizon interval day to second")
    return scoring.accuracy_by_horizon(A.horizons(A.probabilistic(spark, sf_dir)), h, probabilistic=True)


# functions over groups -------------------------------------------------------------------


def _frame(spark, sf_dir):
    return BeliefFrame(A.probabilistic(spark, sf_dir), A.DAILY)


@query(with_("bp", f"SELECT {times(KEYS)}, count(*) AS n, round(max(event_value) - min(event_value), 6) AS spread FROM p GROUP BY p.sensor, p.event_start, p.belief_time, p.source"))
def for_each_belief(spark, sf_dir):
    """A pandas function over the points of each belief."""

    def spread(rows: pd.DataFrame) -> pd.DataFrame:
        one = rows.iloc[[0]][["sensor", "event_start", "belief_time", "source"]]
        return one.assign(n=len(rows), spread=rows["event_value"].max() - rows["event_value"].min())

    return _frame(spark, sf_dir).for_each_belief(spread, "sensor string, event_start timestamp, belief_time timestamp, source string, n long, spread double")


@query(with_("bp", f"SELECT {times('sensor, event_start, belief_time')}, count(DISTINCT source) AS n, round(avg(event_value), 6) AS mean FROM p GROUP BY p.sensor, p.event_start, p.belief_time"))
def for_each_collective_belief(spark, sf_dir):
    """A pandas function over what all sources believed at one time."""

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.iloc[[0]][["sensor", "event_start", "belief_time"]].assign(n=rows["source"].nunique(), mean=rows["event_value"].mean())

    return _frame(spark, sf_dir).for_each_collective_belief(mean, "sensor string, event_start timestamp, belief_time timestamp, n long, mean double")


# files and streams -------------------------------------------------------------------------


@query(with_("b", f"SELECT {times(ROWS)} FROM b"))
def csv_round_trip(spark, sf_dir):
    """Beliefs written as CSV and read again."""
    from credence.sources.files import read_beliefs, write_csv

    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}.csv"
    b = A.deterministic(spark, sf_dir)
    write_csv(b.withColumnRenamed("sensor", "sensor_name").withColumn("source", F.concat_ws("/", "sensor_name", "source")).drop("sensor_name"), path)
    back = read_beliefs(spark, path, A.EVENTS, check_frequency=False)
    parts = F.split("source", "/")
    return back.withColumn("sensor", parts[0]).withColumn("source", parts[1])


@query(with_("b", f"SELECT {times(ROWS)} FROM ({latest_sql('b')})"))
def streamed_latest_beliefs(spark, sf_dir):
    """The latest beliefs of a table read as a stream."""
    from credence.streaming.latest import write_latest

    t = A.table(spark, sf_dir, "events")
    stream = spark.readStream.schema(t.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    path = f"{shared_folder(spark)}/latest-{uuid.uuid4().hex}"
    write_latest(A.beliefs_of(stream), path, "100 days").awaitTermination()
    return V.most_recent(spark.read.parquet(f"{path}/rows").drop("batch"), probabilistic=True)


@query(with_("b", "").strip() + f", {ROUNDED} SELECT sensor, source, count(*) AS n FROM (SELECT *, lag(event_value) OVER (PARTITION BY sensor, event_start, source ORDER BY belief_time) AS before FROM r) WHERE event_value = before GROUP BY ALL")
def unchanged_counts(spark, sf_dir):
    """How often each source of a sensor said the same again."""
    same = V.unchanged_beliefs(A.horizons(A.deterministic(spark, sf_dir)).withColumn("event_value", F.round(F.col("event_value") / 50)))
    return same.groupBy("sensor", "source").agg(F.count("*").alias("n"))
