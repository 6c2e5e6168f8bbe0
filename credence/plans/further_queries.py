"""Further queries: dispatchers, remaining aggregates, searches and functions that others build on."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import functions as F

from credence.functions import cdf as C
from credence.operators import forecast, instantaneous, lineage, propagate, resample, scoring
from credence.operators import viewpoint as V
from credence.plans import adapters as A
from credence.plans.more_queries import also
from credence.plans.queries import DAY_AHEAD, END, HOUR, KEYS, ROWS, START, T, _binned, _instant_bins, _naive, latest_sql, query, times, with_

# resampling ---------------------------------------------------------------------


SPLIT = f"SELECT sensor, {T.format('event_start + i * INTERVAL 6 HOUR', 'event_start')}, {T.format('max(belief_time) OVER ()', 'belief_time')}, source, round(cumulative_probability, 6) AS cumulative_probability, round(event_value, 6) AS event_value FROM l, range(4) AS r(i)"


@query(also("bp", f"l AS (SELECT * REPLACE ((SELECT max(belief_time) FROM p) AS belief_time) FROM ({latest_sql('p')})) {SPLIT}"))
def resample_events_split(spark, sf_dir):
    """The dispatcher on probabilistic beliefs about days: the latest ones, as of the last moment, split into quarters of a day."""
    return resample.resample_events(A.probabilistic(spark, sf_dir), timedelta(days=1), timedelta(hours=6), keep_only_most_recent_belief=True)


for _method, _value in {"prod": "product(event_value / 100)", "var": "var_samp(event_value)", "quantile": "quantile_cont(event_value, 0.5)"}.items():
    query(f"SELECT * FROM ({_instant_bins(_value, 3)}) WHERE event_value IS NOT NULL", f"instantaneous_{_method}")(
        lambda spark, sf_dir, method=_method: instantaneous.resample_instantaneous(A.hourly(spark, sf_dir).withColumn("event_value", F.col("event_value") / (100 if method == "prod" else 1)), 3 * HOUR, method, "Europe/Amsterdam")
    )

GRID = "e AS (SELECT sensor, min(event_start) AS a, max(event_start) AS z FROM h GROUP BY sensor), g AS (SELECT sensor, unnest(generate_series(a, z, INTERVAL 30 MINUTE)) AS t FROM e)"
FORM = f"'S' AS source, {T.format('t', 'event_start')}, round(event_value, 6) AS event_value, {T.format('TIMESTAMP ' + repr('2024-03-01'), 'belief_time')}, 0.5::DOUBLE AS cumulative_probability"


@query(also("h", f"{GRID} SELECT g.sensor, {FORM} FROM g ASOF JOIN h ON g.sensor = h.sensor AND g.t <= h.event_start"))
def instantaneous_bfill(spark, sf_dir):
    """Instants every half hour, each as the next one."""
    return instantaneous.resample_instantaneous(A.hourly(spark, sf_dir), HOUR / 2, "bfill", "Europe/Amsterdam")


@query(also("h", f"{GRID} SELECT g.sensor, {FORM} FROM g ASOF JOIN h ON g.sensor = h.sensor AND g.t >= h.event_start"))
def instantaneous_pad(spark, sf_dir):
    """Instants every half hour, each as the last one, by the other name."""
    return instantaneous.resample_instantaneous(A.hourly(spark, sf_dir), HOUR / 2, "pad", "Europe/Amsterdam")


@query(also("h", f"{GRID}, l AS (SELECT g.sensor, t, event_start AS t0, event_value AS v0 FROM g ASOF JOIN h ON g.sensor = h.sensor AND g.t >= h.event_start), m AS (SELECT l.*, event_start AS t1, event_value AS v1 FROM l ASOF JOIN h ON l.sensor = h.sensor AND l.t <= h.event_start), n AS (SELECT sensor, t, CASE WHEN epoch_us(t) - epoch_us(t0) < epoch_us(t1) - epoch_us(t) THEN v0 ELSE v1 END AS event_value FROM m) SELECT sensor, {FORM} FROM n"))
def instantaneous_nearest(spark, sf_dir):
    """Instants every half hour, each as the nearest one, the next on a tie."""
    return instantaneous.resample_instantaneous(A.hourly(spark, sf_dir), HOUR / 2, "nearest", "Europe/Amsterdam")


# distributions --------------------------------------------------------------------

CUT = "q AS (SELECT *, lag(cumulative_probability) OVER w AS cp0, lag(event_value) OVER w AS v0, max(cumulative_probability) OVER k AS top, count(*) OVER k AS depth FROM p WINDOW k AS (PARTITION BY sensor, event_start, belief_time, source), w AS (PARTITION BY sensor, event_start, belief_time, source ORDER BY cumulative_probability))"


@query(also("bp", f"{CUT} SELECT {times(KEYS)}, round(sum(event_value * (CASE WHEN cumulative_probability = top THEN 1.0 ELSE cumulative_probability END - coalesce(cp0, 0))), 6) AS event_value FROM q GROUP BY q.sensor, q.event_start, q.belief_time, q.source"))
def cdf_mean_discrete(spark, sf_dir):
    """The mean of each belief's values themselves."""
    return propagate.pack(A.probabilistic(spark, sf_dir)).select("sensor", "event_start", "belief_time", "source", C.mean(F.col("cdf"), "discrete").alias("event_value"))


PARTIAL = "r AS (SELECT *, CASE WHEN cumulative_probability = top THEN 1.0 ELSE cumulative_probability END AS hi, coalesce(cp0, 0) AS lo FROM q), s AS (SELECT *, (least(hi, 0.75) - 0.25) / 0.5 AS cp FROM r WHERE hi > lo AND least(hi, 0.75) > greatest(lo, 0.25))"


@query(also("bp", f"{CUT}, {PARTIAL} SELECT {times(KEYS)}, round(cp, 6) AS cumulative_probability, round(event_value, 6) AS event_value FROM s"))
def cdf_partial(spark, sf_dir):
    """The middle half of each belief's distribution, scaled to its own."""
    packed = propagate.pack(A.probabilistic(spark, sf_dir)).withColumn("cdf", C.partial(C.complete(F.col("cdf")), F.lit(0.25), F.lit(0.75)))
    return propagate.unpack(packed)


@query(also("bp", f"{CUT}, m AS (SELECT sensor, event_start, belief_time, source, CASE WHEN count(*) = 1 THEN min(event_value) ELSE sum(coalesce((cumulative_probability - cp0) * (event_value + v0) / 2, cumulative_probability * event_value)) END AS v FROM q GROUP BY ALL) SELECT {times(KEYS)}, round(v, 6) AS event_value FROM m"))
def make_deterministic(spark, sf_dir):
    """Every belief as one value, its mean."""
    return scoring.make_deterministic(A.probabilistic(spark, sf_dir)).drop("cumulative_probability")


# frames, searches, forecasts --------------------------------------------------------


@query(with_("b", "SELECT count(*) = count(DISTINCT (sensor, event_start, source, cumulative_probability)) AS every_one FROM b"))
def unique_beliefs_per_event(spark, sf_dir):
    """Whether each source has one belief about each event."""
    return spark.createDataFrame([(lineage.unique_beliefs_per_event_per_source(A.deterministic(spark, sf_dir)),)], "every_one boolean")


@query(with_("b", "SELECT DISTINCT source FROM b"))
def lineage_sources(spark, sf_dir):
    """The sources of a frame."""
    return lineage.unique(A.deterministic(spark, sf_dir), "source")


@query(with_("b", f"SELECT {times(ROWS)}, horizon / 1e6 AS belief_horizon FROM b WHERE event_start > TIMESTAMP '2024-01-05' - INTERVAL 6 HOUR AND event_start <= TIMESTAMP '2024-01-20' - INTERVAL 6 HOUR AND event_value > 50 AND horizon <= 0"))
def search_event_ends(spark, sf_dir):
    """A search by event ends and a condition of one's own, over all sensors."""
    from credence.sources.store import search

    day = lambda d: datetime(2024, 1, d, tzinfo=timezone.utc)
    rows = A.horizons(A.deterministic(spark, sf_dir)).drop("belief_time")
    return search(rows, A.EVENTS, event_ends_after=day(5), event_ends_before=day(20), horizons_at_most=timedelta(0), custom_filters=[F.col("event_value") > 50])


@query(_naive("avg(event_value)"))
def custom_forecast(spark, sf_dir):
    """A day ahead by a function of one's own, here the mean of what is known."""

    def mean(past: pd.DataFrame, asked: list) -> list:
        return [past["event_value"].mean()] * len(asked)

    return forecast.form_beliefs(A.hourly(spark, sf_dir), DAY_AHEAD, HOUR, datetime(2024, 3, 1, 1, tzinfo=timezone.utc), "N", (START, END), forecaster=mean)


@query(also("b", f"l AS ({latest_sql('b')}) SELECT sensor, {T.format('event_start', 'event_start')}, source, round(event_value, 6) AS event_value FROM l"))
def without_belief_times(spark, sf_dir):
    """The latest beliefs without the level of belief times."""
    return V.most_recent(A.deterministic(spark, sf_dir)).drop("belief_time", "cumulative_probability")
