"""The engine's queries over the general-purpose tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.functions import cdf as C
from credence.functions import knowledge
from credence.operators import forecast, instantaneous, joint, lineage, plotdata, propagate, resample, scoring
from credence.operators import viewpoint as V
from credence.plans import adapters as A
from credence.sensors import Sensor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MOMENT = datetime(2024, 1, 15, 12, tzinfo=timezone.utc)
EARLIER = datetime(2024, 1, 15, 2, tzinfo=timezone.utc)
HOUR = timedelta(hours=1)
ROWS = "sensor, event_start, belief_time, source, cumulative_probability, event_value"
T = "strftime({}, '%Y-%m-%d %H:%M:%S.%f') AS {}"


def shown(df: DataFrame) -> DataFrame:
    """Moments as text, spans as seconds, figures to six places: the same in any engine."""
    out = []
    for c, kind in df.dtypes:
        if kind.startswith("timestamp"):
            out.append(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c))
        elif kind.startswith("interval"):
            out.append(seconds(F.col(c)).alias(c))
        elif kind == "double":
            out.append(F.round(c, 6).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def seconds(span):
    """A span in seconds."""
    zero = F.lit(datetime(1970, 1, 1, tzinfo=timezone.utc)).cast("timestamp")
    return F.unix_micros(zero + span) / F.lit(1e6)


def times(columns: str) -> str:
    """A SELECT list in SQL that shows columns as ``shown`` does."""
    out = []
    for c in (x.strip() for x in columns.split(",")):
        if c in ("event_start", "belief_time", "first", "last", "knowledge_time"):
            out.append(T.format(c, c))
        elif c in ("sensor", "source", "depth", "n_beliefs", "n"):
            out.append(c)
        else:
            out.append(f"round({c}, 6) AS {c}")
    return ", ".join(out)


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: shown(f(spark, sf_dir))
        QUERIES[key].__doc__ = f.__doc__
        if sql:
            ORACLES[key] = sql
        return f

    return add


def with_(parts: str, select: str) -> str:
    return "WITH " + ", ".join(A.SQL[p] for p in parts) + " " + select


def latest_sql(source: str, where: str = "true", order: str = "belief_time DESC", columns: str = "*") -> str:
    return f"SELECT {columns} FROM (SELECT *, rank() OVER (PARTITION BY sensor, event_start, source ORDER BY {order}) AS rk FROM {source} WHERE event_value IS NOT NULL AND {where}) WHERE rk = 1"


# viewpoints -------------------------------------------------------------------


@query(with_("b", f"SELECT {times(ROWS)} FROM ({latest_sql('b')})"))
def most_recent_belief(spark, sf_dir):
    """The latest belief of each source about each event."""
    return V.most_recent(A.deterministic(spark, sf_dir))


@query(with_("bp", f"SELECT {times(ROWS)} FROM ({latest_sql('p')})"))
def most_recent_probabilistic(spark, sf_dir):
    """The latest belief of each source about each event, with all its points."""
    return V.most_recent(A.probabilistic(spark, sf_dir), probabilistic=True)


AT = "TIMESTAMP '2024-01-15 12:00:00'"
BEFORE = "TIMESTAMP '2024-01-15 02:00:00'"


@query(with_("b", f"SELECT {times(ROWS)} FROM ({latest_sql('b', f'belief_time <= {AT}')})"))
def fixed_viewpoint(spark, sf_dir):
    """What was believed as of a moment."""
    return V.fixed_viewpoint(A.deterministic(spark, sf_dir), MOMENT)


@query(with_("b", f"SELECT {times(ROWS).replace(T.format('belief_time', 'belief_time'), T.format(AT, 'belief_time'))} FROM ({latest_sql('b', f'belief_time BETWEEN {BEFORE} AND {AT}')})"))
def fixed_viewpoint_window(spark, sf_dir):
    """The latest beliefs formed within a window, stamped with its end."""
    return V.fixed_viewpoint(A.deterministic(spark, sf_dir), window=(EARLIER, MOMENT), update_belief_times=True)


@query(with_("b", f"SELECT {times(ROWS)} FROM ({latest_sql('b', 'horizon >= -3600000000 * 4')})"))
def rolling_viewpoint(spark, sf_dir):
    """What was believed until four hours after each event could be known."""
    return V.rolling_viewpoint(A.horizons(A.deterministic(spark, sf_dir)), -4 * HOUR).drop("belief_horizon")


@query(with_("b", f"SELECT {times(ROWS)} FROM ({latest_sql('b', 'horizon BETWEEN -3600000000 * 10 AND 3600000000 * 2')})"))
def rolling_viewpoint_window(spark, sf_dir):
    """The latest beliefs within a window of horizons."""
    return V.rolling_viewpoint(A.horizons(A.deterministic(spark, sf_dir)), window=(-10 * HOUR, 2 * HOUR)).drop("belief_horizon")


@query(with_("b", f"SELECT {times('sensor, belief_time, source, cumulative_probability, event_value')}, horizon / 1e6 AS belief_horizon FROM b WHERE event_start = TIMESTAMP '2024-01-10' AND horizon <= 0"))
def belief_history(spark, sf_dir):
    """All beliefs about a day's events formed after they could be known."""
    return V.belief_history(A.horizons(A.deterministic(spark, sf_dir)), datetime(2024, 1, 10, tzinfo=timezone.utc), belief_horizon_window=(None, timedelta(0)))


def previous_sql(value: str) -> str:
    return f"(SELECT *, {value} AS before FROM r WINDOW w AS (PARTITION BY sensor, event_start, source ORDER BY belief_time))"


ROUNDED = "r AS (SELECT * REPLACE (round(event_value / 50)::DOUBLE AS event_value) FROM b)"


def _rounded(spark, sf_dir):
    return A.horizons(A.deterministic(spark, sf_dir)).withColumn("event_value", F.round(F.col("event_value") / 50))


@query(with_("b", "").strip() + f", {ROUNDED} SELECT {times(ROWS)} FROM {previous_sql('lag(event_value) OVER w')} WHERE event_value = before")
def unchanged_beliefs(spark, sf_dir):
    """Beliefs that say what the one before said."""
    return V.unchanged_beliefs(_rounded(spark, sf_dir)).drop("belief_horizon")


@query(with_("b", "").strip() + f", {ROUNDED} SELECT {times(ROWS)} FROM {previous_sql('(last_value(CASE WHEN horizon > 0 THEN {v: event_value} END IGNORE NULLS) OVER (PARTITION BY sensor, event_start, source ORDER BY belief_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)).v')} WHERE event_value = before")
def unchanged_since_forecast(spark, sf_dir):
    """Beliefs that say what the last forecast before them said."""
    return V.unchanged_beliefs(_rounded(spark, sf_dir), include_non_positive_horizons=False).drop("belief_horizon")


@query(with_("b", "").strip() + f", {ROUNDED} SELECT {times(ROWS)} FROM {previous_sql('lag(event_value) OVER w')} WHERE before IS NULL OR event_value <> before")
def changed_beliefs(spark, sf_dir):
    """Beliefs that are first or say something new."""
    return V.changed_beliefs(_rounded(spark, sf_dir)).drop("belief_horizon")


@query(with_("b", f"SELECT {times(ROWS)} FROM (SELECT *, rank() OVER (PARTITION BY sensor, source ORDER BY event_start DESC) AS rk FROM b) WHERE rk = 1"))
def most_recent_event_per_source(spark, sf_dir):
    """All beliefs of each source about its latest event."""
    return V.most_recent_events(A.deterministic(spark, sf_dir))


@query(with_("b", f"SELECT {times(ROWS)} FROM (SELECT * FROM b ORDER BY event_start DESC, belief_time DESC, source, cumulative_probability LIMIT 1)"))
def most_recent_only_topk(spark, sf_dir):
    """The latest belief about the latest event."""
    return V.most_recent_only(A.deterministic(spark, sf_dir))


# knowledge horizons -------------------------------------------------------------


def _horizons(spark, sf_dir, name, parameters, resolution=HOUR):
    t = A.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("event_start")).distinct()
    return t.select("event_start", seconds(knowledge.horizon(name, parameters, F.col("event_start"), resolution)).alias("horizon"))


def _horizon_sql(value: str) -> str:
    return f"SELECT {T.format('ts', 'event_start')}, round(({value})::DOUBLE, 6) AS horizon FROM (SELECT DISTINCT ts FROM events)"


@query(_horizon_sql("-3600 - 900"))
def knowledge_horizon_ex_post(spark, sf_dir):
    return _horizons(spark, sf_dir, "ex_post", {"ex_post_horizon": timedelta(minutes=15)})


@query(_horizon_sql("7200"))
def knowledge_horizon_ex_ante(spark, sf_dir):
    return _horizons(spark, sf_dir, "ex_ante", {"ex_ante_horizon": 2 * HOUR})


@query(_horizon_sql(f"(epoch_us(ts) - epoch_us({AT})) / 1e6"))
def knowledge_horizon_at_date(spark, sf_dir):
    return _horizons(spark, sf_dir, "at_date", {"knowledge_time": MOMENT})


@query(_horizon_sql("(epoch_us(ts) - epoch_us((date_trunc('day', ts + INTERVAL 1 HOUR) - INTERVAL 1 DAY + INTERVAL 12 HOUR) - INTERVAL 1 HOUR)) / 1e6"))
def knowledge_horizon_x_days_ago(spark, sf_dir):
    """Noon of the day before, in a zone that is an hour ahead of UTC throughout the table's month."""
    return _horizons(spark, sf_dir, "x_days_ago_at_y_oclock", {"x": 1, "y": 12, "z": "Europe/Amsterdam"})


@query(_horizon_sql("(epoch_us(ts) - epoch_us(make_timestamp(year(ts + INTERVAL 1 HOUR) - 2, 6, 1, 0, 0, 0) - INTERVAL 2 HOUR)) / 1e6"))
def knowledge_horizon_x_years_ago(spark, sf_dir):
    """Midnight of a summer day two years before."""
    return _horizons(spark, sf_dir, "x_years_ago_at_date", {"x": 2, "day": 1, "month": 6, "z": "Europe/Amsterdam"})


@query(with_("s", f"SELECT {times('event_start, belief_time, source, event_value')}, (epoch_us(event_start) + 86400000000 - epoch_us(belief_time)) / 1e6 AS belief_horizon FROM s"))
def belief_horizons(spark, sf_dir):
    """Belief times to horizons, for events of a day."""
    return A.horizons(A.shipments(spark, sf_dir), A.DAILY).select("event_start", "belief_time", "source", "event_value", "belief_horizon")


# search, propagation, lineage ---------------------------------------------------


@query(with_("b", f"SELECT {times(ROWS)} FROM ({latest_sql('b', f'''sensor = 'click' AND event_start >= TIMESTAMP '2024-01-05' AND event_start < TIMESTAMP '2024-01-25' AND belief_time <= {AT} AND horizon >= -3600000000 * 12 AND source IN ('S0', 'S2')''')})"))
def search_filters(spark, sf_dir):
    """A search by sensor, event time, belief time, horizon and source, for the latest beliefs."""
    from credence.sources.store import search

    rows = A.horizons(A.deterministic(spark, sf_dir)).where("sensor = 'click'").drop("belief_time")
    found = search(
        rows, A.EVENTS, event_starts_after=datetime(2024, 1, 5, tzinfo=timezone.utc), event_starts_before=datetime(2024, 1, 25, tzinfo=timezone.utc),
        beliefs_before=MOMENT, horizons_at_least=-12 * HOUR, source=["S0", "S2"], most_recent_beliefs_only=True, probabilistic=False,
    )
    return found.select([c.strip() for c in ROWS.split(",")])


GAPS = "g AS (SELECT * REPLACE (CASE WHEN epoch_us(belief_time) // 1000000 % 3 = 0 THEN NULL ELSE event_value END AS event_value) FROM b)"


@query(with_("b", "").strip() + f", {GAPS} SELECT {times('sensor, event_start, belief_time, source, cumulative_probability')}, round(last_value(event_value IGNORE NULLS) OVER (PARTITION BY sensor, event_start, source ORDER BY belief_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS event_value FROM g")
def propagate_beliefs(spark, sf_dir):
    """Nulls filled with what was believed before."""
    b = A.deterministic(spark, sf_dir)
    gone = F.floor(F.unix_micros("belief_time") / 1_000_000) % 3 == 0
    return propagate.propagate_beliefs(b.withColumn("event_value", F.when(~gone, F.col("event_value"))))


@query(with_("bp", f", t AS (SELECT DISTINCT sensor, belief_time FROM p), f AS (SELECT sensor, event_start, source, min(belief_time) AS first FROM p GROUP BY ALL), w AS (SELECT f.sensor, f.event_start, f.source, t.belief_time, max(x.belief_time) AS held FROM f JOIN t ON f.sensor = t.sensor AND t.belief_time >= f.first JOIN (SELECT DISTINCT sensor, event_start, source, belief_time FROM p) x ON x.sensor = f.sensor AND x.event_start = f.event_start AND x.source = f.source AND x.belief_time <= t.belief_time GROUP BY ALL) SELECT {times(ROWS).replace('sensor,', 'w.sensor,').replace('(event_start', '(w.event_start').replace('(belief_time', '(w.belief_time').replace(' source,', ' w.source,')} FROM w JOIN p ON p.sensor = w.sensor AND p.event_start = w.event_start AND p.source = w.source AND p.belief_time = w.held").replace(") ,", "),"))
def align_belief_times(spark, sf_dir):
    """Every event and source at every belief time of its sensor, points and all."""
    return propagate.align_belief_times(A.probabilistic(spark, sf_dir))


@query(with_("bp", """, d AS (SELECT sensor, event_start, belief_time, source, count(*) AS depth FROM p GROUP BY ALL)
SELECT count(DISTINCT (sensor, event_start)) AS number_of_events, count(DISTINCT belief_time) AS number_of_belief_times, count(DISTINCT source) AS number_of_sources,
count(*) AS number_of_beliefs, count(*) FILTER (depth = 1) AS number_of_deterministic_beliefs, count(*) FILTER (depth > 1) AS number_of_probabilistic_beliefs,
round(count(*) FILTER (depth = 1) / count(*), 6) AS percentage_of_deterministic_beliefs, round(count(*) FILTER (depth > 1) / count(*), 6) AS percentage_of_probabilistic_beliefs,
round(sum(depth) / count(*), 6) AS probabilistic_depth FROM d""").replace(") ,", "),"))
def lineage_stats(spark, sf_dir):
    """Counts of events, belief times, sources, beliefs and points."""
    return lineage.stats(A.probabilistic(spark, sf_dir))


@query(with_("bp", ", d AS (SELECT count(*) AS depth FROM p GROUP BY sensor, event_start, belief_time, source) SELECT depth, count(*) AS n_beliefs FROM d GROUP BY depth").replace(") ,", "),"))
def probabilistic_depth_count(spark, sf_dir):
    """How many beliefs have how many points."""
    return lineage.depth_count(A.probabilistic(spark, sf_dir))


GAPPED = ", g AS (SELECT sensor, epoch_us(event_start) - epoch_us(lag(event_start) OVER (PARTITION BY sensor ORDER BY event_start)) AS gap FROM (SELECT DISTINCT sensor, event_start FROM h))"


@query(with_("h", f"{GAPPED}, c AS (SELECT sensor, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY ALL) SELECT sensor, first(gap ORDER BY n DESC, gap) / 1e6 AS frequency FROM c GROUP BY sensor").replace(") ,", "),"))
def event_frequency_mode(spark, sf_dir):
    """The most common spacing of each sensor's events."""
    return lineage.most_common_event_frequency(A.hourly(spark, sf_dir), HOUR)


@query(with_("h", f"{GAPPED} SELECT sensor, CASE WHEN count(DISTINCT gap) = 0 THEN 3600.0 WHEN count(DISTINCT gap) = 1 THEN min(gap) / 1e6 END AS frequency FROM g GROUP BY sensor").replace(") ,", "),"))
def event_frequency(spark, sf_dir):
    """The spacing of each sensor's events where it is constant."""
    return lineage.event_frequency(A.hourly(spark, sf_dir), HOUR)


# resampling ---------------------------------------------------------------------

BELIEF = "TIMESTAMP '2024-03-01'"


def _binned(value: str, hours: int) -> str:
    step = hours * 3_600_000_000
    return with_("h", f", o AS (SELECT sensor, min(event_start) AS origin FROM h GROUP BY sensor) SELECT h.sensor, {T.format(f'make_timestamp(epoch_us(origin) + (epoch_us(event_start) - epoch_us(origin)) // {step} * {step})', 'event_start')}, {T.format(f'max({BELIEF})', 'belief_time')}, 'S' AS source, 0.5::DOUBLE AS cumulative_probability, round({value}, 6) AS event_value FROM h JOIN o USING (sensor) GROUP BY h.sensor, origin, (epoch_us(event_start) - epoch_us(origin)) // {step}").replace(") ,", "),")


@query(_binned("avg(event_value)", 5))
def downsample_mean(spark, sf_dir):
    """Hourly means to means of five hours."""
    return resample.downsample(A.hourly(spark, sf_dir), 5 * HOUR)


@query(_binned("sum(event_value)", 3))
def downsample_sum(spark, sf_dir):
    """Hourly values to sums of three hours."""
    return resample.downsample(A.hourly(spark, sf_dir), 3 * HOUR, "sum")


def _upsampled(value: str, minutes: int, steps: int) -> str:
    size = minutes * 60_000_000
    return with_("h", f", o AS (SELECT *, min(epoch_us(event_start)) OVER (PARTITION BY sensor) AS origin, max(epoch_us(event_start)) OVER (PARTITION BY sensor) + 3600000000 AS fin FROM h), n AS (SELECT *, epoch_us(event_start) AS own, lead(epoch_us(event_start)) OVER (PARTITION BY sensor ORDER BY event_start) AS nxt FROM o WHERE (epoch_us(event_start) - origin) % {size} = 0), k AS (SELECT n.*, own + i * {size} AS s FROM n, range({steps}) AS r(i)) SELECT sensor, {T.format('make_timestamp(s)', 'event_start')}, {T.format(BELIEF, 'belief_time')}, 'S' AS source, 0.5::DOUBLE AS cumulative_probability, round({value}, 6) AS event_value FROM k WHERE s < fin AND (nxt IS NULL OR s < nxt)").replace(") ,", "),")


@query(_upsampled("event_value", 15, 4))
def upsample_ffill(spark, sf_dir):
    """Hourly values to quarters of an hour."""
    return resample.upsample(A.hourly(spark, sf_dir), HOUR, HOUR / 4)


@query(_upsampled("event_value / 3", 20, 3))
def upsample_split_sum(spark, sf_dir):
    """Hourly sums split into twenty minutes each."""
    return resample.upsample(A.hourly(spark, sf_dir), HOUR, HOUR / 3, "sum")


def _instants(value: str) -> str:
    return with_("h", f", e AS (SELECT sensor, event_start, event_value, true AS own FROM h UNION ALL SELECT sensor, event_start + INTERVAL 1 HOUR, event_value, false FROM h) SELECT sensor, {T.format('event_start', 'event_start')}, {T.format(BELIEF, 'belief_time')}, 'S' AS source, 0.5::DOUBLE AS cumulative_probability, round({value}, 6) AS event_value FROM e GROUP BY sensor, event_start").replace(") ,", "),")


for _policy, _value in (("first", "coalesce(max(event_value) FILTER (own), max(event_value))"), ("min", "min(event_value)"), ("max", "max(event_value)")):
    query(_instants(_value), f"to_instantaneous_{_policy}")(lambda spark, sf_dir, policy=_policy: resample.to_instantaneous(A.hourly(spark, sf_dir), HOUR, policy))


def _instant_bins(value: str, hours: int, zone_us: int = 3_600_000_000) -> str:
    step = hours * 3_600_000_000
    return with_("h", f", l AS (SELECT *, epoch_us(event_start) + {zone_us} AS loc FROM h), o AS (SELECT sensor, min(loc) // 86400000000 * 86400000000 AS origin FROM l GROUP BY sensor) SELECT sensor, 'S' AS source, {T.format(f'make_timestamp(origin + (loc - origin) // {step} * {step} - {zone_us})', 'event_start')}, round({value}, 6) AS event_value, {T.format(f'max({BELIEF})', 'belief_time')}, 0.5::DOUBLE AS cumulative_probability FROM l JOIN o USING (sensor) GROUP BY sensor, origin, (loc - origin) // {step}").replace(") ,", "),")


@query(_instant_bins("first(event_value ORDER BY event_start)", 6))
def instantaneous_first(spark, sf_dir):
    """The first instant of every six hours from local midnight."""
    return instantaneous.resample_instantaneous(A.hourly(spark, sf_dir), 6 * HOUR, "first", "Europe/Amsterdam")


@query(_instant_bins("max(event_value)", 8))
def instantaneous_max(spark, sf_dir):
    """The largest instant of every eight hours from local midnight."""
    return instantaneous.resample_instantaneous(A.hourly(spark, sf_dir), 8 * HOUR, "max", "Europe/Amsterdam")


@query(with_("h", f"SELECT sensor, 'S' AS source, {T.format('event_start', 'event_start')}, round(event_value, 6) AS event_value, {T.format(BELIEF, 'belief_time')}, 0.5::DOUBLE AS cumulative_probability FROM h WHERE (epoch_us(event_start) + 3600000000) % 14400000000 = 0"))
def instantaneous_asfreq(spark, sf_dir):
    """The instants at every fourth hour from local midnight."""
    return instantaneous.resample_instantaneous(A.hourly(spark, sf_dir), 4 * HOUR, "asfreq", "Europe/Amsterdam")


# references and accuracy ----------------------------------------------------------

TRUTH = f"r AS ({latest_sql('b', columns='sensor, event_start, source, event_value AS reference_value')})"
TRUTH_S0 = f"z AS ({latest_sql('b')}), r AS (SELECT k.sensor, k.event_start, k.source, z.event_value AS reference_value FROM (SELECT DISTINCT sensor, event_start, source FROM z) k JOIN z ON z.sensor = k.sensor AND z.event_start = k.event_start AND z.source = 'S0')"
SCORES = "avg(crps) AS mae, avg(crps / nullif(reference_value, 0)) AS mape, avg(crps) / nullif(avg(reference_value), 0) AS wape"


@query(with_("b", f", {TRUTH} SELECT {times(ROWS)}, horizon / 1e6 AS belief_horizon, round(reference_value, 6) AS reference_value FROM b LEFT JOIN r USING (sensor, event_start, source)").replace(") ,", "),"))
def set_reference_values_latest(spark, sf_dir):
    """Beliefs beside the latest one of their source."""
    return scoring.set_reference_values(A.horizons(A.deterministic(spark, sf_dir)), kind="median")


@query(with_("b", f", {TRUTH_S0} SELECT {times(ROWS)}, horizon / 1e6 AS belief_horizon, round(reference_value, 6) AS reference_value FROM b LEFT JOIN r USING (sensor, event_start, source)").replace(") ,", "),"))
def set_reference_values_source(spark, sf_dir):
    """Beliefs beside the latest one of a reference source."""
    return scoring.set_reference_values(A.horizons(A.deterministic(spark, sf_dir)), source="S0", kind="mean")


def _accuracy(view: str, truth: str = TRUTH) -> str:
    return with_("b", f", {truth}, f AS ({view}), c AS (SELECT r.source, abs(f.event_value - reference_value) AS crps, reference_value FROM r LEFT JOIN f USING (sensor, event_start, source)), a AS (SELECT source, {SCORES} FROM c GROUP BY source) SELECT source, round(mae, 6) AS mae, round(mape, 6) AS mape, round(wape, 6) AS wape FROM a").replace(") ,", "),")


@query(_accuracy(latest_sql("b", f"belief_time <= {AT}")))
def accuracy_fixed(spark, sf_dir):
    """Accuracy of each source as of a moment, against its latest beliefs."""
    return scoring.fixed_viewpoint_accuracy(A.deterministic(spark, sf_dir), MOMENT)


@query(_accuracy(latest_sql("b", "horizon >= 0"), TRUTH_S0))
def accuracy_rolling(spark, sf_dir):
    """Accuracy of each source at the time that events can be known, against a reference source."""
    return scoring.rolling_viewpoint_accuracy(A.horizons(A.deterministic(spark, sf_dir)), timedelta(0), source="S0")


@query(with_("b", f", {TRUTH}, w AS (SELECT *, lead(horizon) OVER (PARTITION BY sensor, event_start, source ORDER BY horizon DESC) AS newer FROM b), n AS (SELECT i * 3600000000 AS hz FROM range(-18, 7) AS q(i)), k AS (SELECT hz, r.* FROM n CROSS JOIN r), m AS (SELECT hz, k.source, abs(w.event_value - reference_value) AS crps, reference_value FROM k LEFT JOIN w ON w.sensor = k.sensor AND w.event_start = k.event_start AND w.source = k.source AND hz <= horizon AND (newer IS NULL OR hz > newer)), a AS (SELECT hz, source, {SCORES} FROM m GROUP BY ALL) SELECT hz / 1e6 AS horizon, source, round(mae, 6) AS mae, round(mape, 6) AS mape, round(wape, 6) AS wape FROM a").replace(") ,", "),"))
def accuracy_by_horizon(spark, sf_dir):
    """Accuracy at every whole hour's horizon, in one pass."""
    h = spark.createDataFrame([(HOUR * i,) for i in range(-18, 7)], "horizon interval day to second")
    return scoring.accuracy_by_horizon(A.horizons(A.deterministic(spark, sf_dir)), h)


# distributions ----------------------------------------------------------------------

KEYS = "sensor, event_start, belief_time, source"


def _quantile(q: float) -> str:
    return f"coalesce(min(event_value) FILTER (cumulative_probability >= {q}), max(event_value))"


@query(with_("bp", f"SELECT {times(KEYS)}, round({_quantile(0.5)}, 6) AS event_value FROM p GROUP BY p.sensor, p.event_start, p.belief_time, p.source"))
def cdf_median(spark, sf_dir):
    """The median of each belief."""
    return propagate.pack(A.probabilistic(spark, sf_dir)).select("sensor", "event_start", "belief_time", "source", C.value_at(F.col("cdf"), 0.5)["v"].alias("event_value"))


@query(with_("bp", f"SELECT {times(KEYS)}, round({_quantile(0.1)}, 6) AS p10, round({_quantile(0.25)}, 6) AS p25, round({_quantile(0.75)}, 6) AS p75, round({_quantile(0.9)}, 6) AS p90 FROM p GROUP BY p.sensor, p.event_start, p.belief_time, p.source"))
def cdf_percentiles(spark, sf_dir):
    """Percentiles of each belief."""
    at = {f"p{round(100 * q)}": C.value_at(F.col("cdf"), q)["v"] for q in (0.1, 0.25, 0.75, 0.9)}
    return propagate.pack(A.probabilistic(spark, sf_dir)).select("sensor", "event_start", "belief_time", "source", *(v.alias(k) for k, v in at.items()))


@query(with_("bp", f", q AS (SELECT *, lag(cumulative_probability) OVER w AS cp0, lag(event_value) OVER w AS v0 FROM p WINDOW w AS (PARTITION BY sensor, event_start, belief_time, source ORDER BY cumulative_probability)) SELECT {times(KEYS)}, round(CASE WHEN count(*) = 1 THEN min(event_value) ELSE sum(coalesce((cumulative_probability - cp0) * (event_value + v0) / 2, cumulative_probability * event_value)) END, 6) AS event_value FROM q GROUP BY q.sensor, q.event_start, q.belief_time, q.source").replace(") ,", "),"))
def cdf_mean_uniform(spark, sf_dir):
    """The mean of each belief where values between its points are equally likely."""
    return propagate.pack(A.probabilistic(spark, sf_dir)).select("sensor", "event_start", "belief_time", "source", C.mean_uniform(F.col("cdf")).alias("event_value"))


LATEST_P = f"lp AS ({latest_sql('p')})"
MASS = "SELECT sensor, event_start, source, event_value AS v, coalesce(lag(cp) OVER k, 0) AS lo, cp AS hi FROM (SELECT *, CASE WHEN cumulative_probability = max(cumulative_probability) OVER (PARTITION BY sensor, event_start, source) THEN 1.0 ELSE cumulative_probability END AS cp FROM {}) WINDOW k AS (PARTITION BY sensor, event_start, source ORDER BY cp)"


@query(with_("bp", f", {LATEST_P}, fv AS ({latest_sql('p', f'belief_time <= {AT}')}), f AS ({MASS.format('fv')}), r AS ({MASS.format('lp')}), o AS (SELECT r.sensor, r.event_start, r.source, r.lo, r.hi, r.v AS rv, f.v, (least(f.hi, r.hi) - greatest(f.lo, r.lo)) / (r.hi - r.lo) AS w FROM r JOIN f ON f.sensor = r.sensor AND f.event_start = r.event_start AND f.source = r.source AND least(f.hi, r.hi) > greatest(f.lo, r.lo)), m AS (SELECT sensor, event_start, source, lo, hi, sum(w * abs(v - rv)) AS miss FROM o GROUP BY ALL), d AS (SELECT a.sensor, a.event_start, a.source, a.lo, sum(a.w * b.w * abs(a.v - b.v)) AS spread FROM o a JOIN o b ON a.sensor = b.sensor AND a.event_start = b.event_start AND a.source = b.source AND a.lo = b.lo GROUP BY ALL), c AS (SELECT sensor, event_start, source, sum((miss - spread / 2) * (hi - m.lo)) AS crps FROM m JOIN d USING (sensor, event_start, source, lo) GROUP BY ALL), g AS (SELECT sensor, event_start, source, {_quantile(0.5)} AS reference_value FROM lp GROUP BY ALL) SELECT sensor, {T.format('event_start', 'event_start')}, source, round(crps, 6) AS crps, round(reference_value, 6) AS reference_value FROM g LEFT JOIN c USING (sensor, event_start, source)").replace(") ,", "),"))
def crps_probabilistic(spark, sf_dir):
    """The score of each source's belief as of a moment, against its latest one, point by point."""
    p = A.probabilistic(spark, sf_dir)
    return scoring.scores(V.fixed_viewpoint(p, MOMENT, probabilistic=True), scoring.reference(p, probabilistic=True))


@query(with_("bp", f", {LATEST_P}, m AS ({MASS.format('lp')}), e AS (SELECT sensor, source, event_start, (epoch_us(event_start) - epoch_us(min(event_start) OVER (PARTITION BY sensor))) // 172800000000 AS bin, v, hi - lo AS p FROM m WHERE hi > lo), k AS (SELECT sensor, source, bin, count(DISTINCT event_start) AS n, min(event_start) AS a, max(event_start) AS z FROM e GROUP BY ALL), x AS (SELECT k.sensor, k.source, k.a AS event_start, k.n, CASE WHEN k.n = 1 THEN l.v ELSE (l.v + h.v) / 2 END AS event_value, CASE WHEN k.n = 1 THEN l.p ELSE l.p * h.p END AS p FROM k JOIN e l ON l.sensor = k.sensor AND l.source = k.source AND l.event_start = k.a LEFT JOIN e h ON h.sensor = k.sensor AND h.source = k.source AND h.event_start = k.z AND k.n = 2), y AS (SELECT sensor, source, event_start, n, event_value, sum(p) AS p FROM x GROUP BY ALL) SELECT sensor, source, {T.format('event_start', 'event_start')}, n, round(sum(p) OVER (PARTITION BY sensor, source, event_start ORDER BY event_value ROWS UNBOUNDED PRECEDING), 6) AS cumulative_probability, round(event_value, 6) AS event_value FROM y").replace(") ,", "),"))
def joint_mean_two_events(spark, sf_dir):
    """The distribution of the mean of each two days' events, taken as independent."""
    p = V.most_recent(A.probabilistic(spark, sf_dir), probabilistic=True)
    packed = propagate.pack(p, V.EVENT).withColumn("cdf", C.complete(F.col("cdf")))
    first = packed.groupBy("sensor").agg(F.min("event_start").alias("_first"))
    bins = packed.join(first, "sensor").withColumn("_bin", F.floor((F.unix_micros("event_start") - F.unix_micros("_first")) / F.lit(172_800_000_000)))
    return joint.joint_of_two(bins, ["sensor", "source", "_bin"]).drop("_bin")


# forecasting, storing, files, charts ----------------------------------------------------

START, END = datetime(2024, 3, 2, tzinfo=timezone.utc), datetime(2024, 3, 3, tzinfo=timezone.utc)
DAY_AHEAD = Sensor("hourly", "", "UTC", HOUR)


def _naive(value: str, season: bool = False) -> str:
    known = "k AS (SELECT sensor, {} AS ph, {} AS event_value FROM h GROUP BY ALL)".format("epoch_us(event_start) % 86400000000" if season else "0", value)
    return with_("h", f", {known}, g AS (SELECT unnest(range(TIMESTAMP '2024-03-02', TIMESTAMP '2024-03-03', INTERVAL 1 HOUR)) AS event_start), s AS (SELECT DISTINCT sensor FROM h) SELECT s.sensor, {T.format('event_start', 'event_start')}, {T.format(BELIEF + ' + INTERVAL 1 HOUR', 'belief_time')}, 'N' AS source, 0.5::DOUBLE AS cumulative_probability, round(event_value, 6) AS event_value FROM s CROSS JOIN g LEFT JOIN k ON k.sensor = s.sensor AND k.ph = {'epoch_us(event_start) % 86400000000' if season else '0'}").replace(") ,", "),")


def _form(spark, sf_dir, **options):
    return forecast.form_beliefs(A.hourly(spark, sf_dir), DAY_AHEAD, HOUR, datetime(2024, 3, 1, 1, tzinfo=timezone.utc), "N", (START, END), **options)


@query(_naive("max_by(event_value, event_start)"))
def naive_forecast_last(spark, sf_dir):
    """A day ahead, each hour as the last known one."""
    return _form(spark, sf_dir)


@query(_naive("avg(event_value)"))
def naive_forecast_mean(spark, sf_dir):
    """A day ahead, each hour as the mean of all known."""
    return _form(spark, sf_dir, forecaster="mean")


@query(_naive("max_by(event_value, event_start)", True))
def naive_forecast_seasonal(spark, sf_dir):
    """A day ahead, each hour as the last known one of that hour."""
    return _form(spark, sf_dir, season=24)


@query(with_("b", f", l AS ({latest_sql('b')}) SELECT {times('sensor, event_start, source, cumulative_probability')}, horizon / 1e6 AS belief_horizon, round(CASE WHEN extract('day' FROM event_start) % 2 = 0 THEN event_value * 2 ELSE event_value END, 6) AS event_value FROM l").replace(") ,", "),"))
def upsert_merge(spark, sf_dir):
    """Beliefs of every sensor stored, then half of them stored anew with other values, then read."""
    from credence.sources.store import BeliefStore

    latest = V.most_recent(A.deterministic(spark, sf_dir))
    store = BeliefStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    out = None
    for i, name in enumerate(sorted(r["sensor"] for r in latest.select("sensor").distinct().collect())):  # sensors are a dimension
        sensor = Sensor(name, "", "UTC", A.EVENTS.event_resolution, id=i + 1)
        rows = latest.where(F.col("sensor") == name).drop("sensor")
        store.add(rows, sensor)
        store.add(rows.where(F.dayofmonth("event_start") % 2 == 0).withColumn("event_value", F.col("event_value") * 2), sensor, allow_overwrite=True)
        found = store.search(sensor).select("sensor", "event_start", "source", "cumulative_probability", "belief_horizon", "event_value")
        out = found if out is None else out.unionByName(found)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for shared files; a temporary one where all runs in one process."""
    import tempfile

    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/credence-scratch"


SHIFTED = "x AS (SELECT sensor, CASE WHEN hour(event_start) % 5 = 0 THEN event_start + INTERVAL 20 MINUTE ELSE event_start END AS event_start FROM h)"


@query(with_("h", f", {SHIFTED}, g AS (SELECT sensor, event_start, epoch_us(event_start) - epoch_us(lag(event_start) OVER (PARTITION BY sensor ORDER BY event_start)) AS gap FROM (SELECT DISTINCT sensor, event_start FROM x)), c AS (SELECT sensor, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY ALL), u AS (SELECT sensor, first(gap ORDER BY n DESC, gap) AS usual FROM c GROUP BY sensor) SELECT g.sensor, {T.format('event_start', 'event_start')}, gap, usual FROM g JOIN u USING (sensor) WHERE gap % usual <> 0").replace(") ,", "),"))
def csv_dedup_irregularity(spark, sf_dir):
    """Events, some twenty minutes late and all there twice, whose distance from the one before is no multiple of the usual one."""
    h = A.hourly(spark, sf_dir)
    late = h.withColumn("event_start", F.when(F.hour("event_start") % 5 == 0, F.col("event_start") + F.expr("INTERVAL '20' MINUTE")).otherwise(F.col("event_start")))
    return lineage.irregular_starts(late.union(late).dropDuplicates())


@query(with_("bp", f"SELECT {times(KEYS)}, round({_quantile(0.05)}, 6) AS lower_value, round({_quantile(0.5)}, 6) AS expected_value, round({_quantile(0.95)}, 6) AS upper_value FROM p GROUP BY p.sensor, p.event_start, p.belief_time, p.source"))
def plot_confidence_bands(spark, sf_dir):
    """Lower, expected and upper value of each belief."""
    return plotdata.confidence_bands(A.probabilistic(spark, sf_dir))


@query(with_("b", f"SELECT {T.format('min(event_start)', 'first')}, {T.format('max(event_start) + INTERVAL 6 HOUR', 'last')} FROM b"))
def event_time_window(spark, sf_dir):
    """From the first event's start to the last one's end."""
    return lineage.event_time_window(A.deterministic(spark, sf_dir), A.EVENTS.event_resolution)


@query()
def joint_mean_drawn(spark, sf_dir):
    """The mean of each week's events by convolution, or drawn with a seed where that has too many values."""
    p = V.most_recent(A.probabilistic(spark, sf_dir), probabilistic=True)
    return resample.join_beliefs(p, timedelta(days=1), timedelta(days=7))


@query()
def density_normal(spark, sf_dir):
    """Points of the normal density through each belief's first two points."""
    return plotdata.density_points(V.most_recent(A.probabilistic(spark, sf_dir), probabilistic=True), 0.0, 500.0, 51)
