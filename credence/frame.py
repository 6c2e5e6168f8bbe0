"""A frame of beliefs: a DataFrame of fixed key columns, its sensor, and the resolution of its events."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.durations import duration, moment
from credence.functions import cdf as C
from credence.operators import forecast, lineage, plotdata, propagate, resample, scoring
from credence.operators import viewpoint as V
from credence.sensors import Sensor, source_name

SCHEMA = "sensor string, event_start timestamp, belief_time timestamp, source string, cumulative_probability double, event_value double"
KEYS = ["sensor", "event_start", "belief_time", "source", "cumulative_probability"]


def belief(sensor: Sensor, source, value: float, event_start=None, event_time=None, belief_time=None, belief_horizon=None, cumulative_probability=None, cp=None, sigma=None) -> tuple:
    """One row, checked: one way to say when the event is, one when it was believed, at most one probability."""
    if (event_start is None) == (event_time is None):
        raise ValueError("give either event_start or event_time")
    if event_time is not None and sensor.event_resolution:
        raise KeyError("event_time is for instantaneous sensors")
    if (belief_time is None) == (belief_horizon is None):
        raise ValueError("give either belief_time or belief_horizon")
    if sum(x is not None for x in (cumulative_probability, cp, sigma)) > 1:
        raise ValueError("give one of cumulative_probability, cp and sigma")
    start = moment(event_start if event_start is not None else event_time)
    probability = next((x for x in (cumulative_probability, cp) if x is not None), 0.5 if sigma is None else C.sigma_to_cp(sigma))
    return (start, moment(belief_time) if belief_time is not None else duration(belief_horizon), source_name(source), float(probability), value)


@dataclass
class BeliefFrame:
    """Beliefs in time form (belief_time); ``horizons`` gives them with belief_horizon. All methods are lazy unless said."""

    df: DataFrame
    sensor: Sensor | None = None
    event_resolution: timedelta | None = None
    probabilistic: bool = True
    timezone: str = "UTC"

    def __post_init__(self):
        if self.event_resolution is None and self.sensor is not None:
            self.event_resolution = self.sensor.event_resolution
        df = self.df
        if "sensor" not in df.columns and self.sensor is not None:
            df = df.withColumn("sensor", F.lit(self.sensor.name))
        if "event_end" in df.columns and "event_start" not in df.columns:
            df = df.withColumn("event_start", F.col("event_end") - F.lit(self.event_resolution)).drop("event_end")
        if "cumulative_probability" not in df.columns:
            df = df.withColumn("cumulative_probability", F.lit(0.5))
        if "belief_time" not in df.columns and "belief_horizon" in df.columns:
            df = df.withColumn("belief_time", self.sensor.knowledge_time(F.col("event_start"), self.event_resolution) - F.col("belief_horizon")).drop("belief_horizon")
        lacking = [c for c in (*KEYS, "event_value") if c not in df.columns]
        if lacking:
            raise KeyError(f"columns are missing: {lacking}")
        kinds = dict(df.dtypes)
        for c in ("event_start", "belief_time"):
            if not kinds[c].startswith("timestamp"):
                raise TypeError(f"{c} must be a timestamp")
            if kinds[c] == "timestamp_ntz":
                df = df.withColumn(c, F.col(c).cast("timestamp"))
        value = F.col("event_value").cast("double")
        self.df = df.withColumn("event_value", F.when(F.isnan(value), None).otherwise(value))

    @classmethod
    def of(cls, spark: SparkSession, rows: Iterable[tuple], sensor: Sensor, **options) -> "BeliefFrame":
        """From rows (event_start, belief_time or belief_horizon, source, probability, value), as ``belief`` makes them."""
        rows = list(rows)
        timed = not rows or not isinstance(rows[0][1], timedelta)
        kind = "belief_time timestamp" if timed else "belief_horizon interval day to second"
        df = spark.createDataFrame(rows, f"event_start timestamp, {kind}, source string, cumulative_probability double, event_value double")
        return cls(df, sensor, **options)

    @classmethod
    def from_columns(cls, df: DataFrame, sensor: Sensor, source=None, event_start=None, belief_time=None, belief_horizon=None, cumulative_probability=None, event_resolution=None) -> "BeliefFrame":
        """From any DataFrame, with constants for the columns that it lacks."""
        given = {"source": source if source is None else source_name(source), "event_start": event_start, "belief_time": belief_time, "belief_horizon": belief_horizon, "cumulative_probability": cumulative_probability}
        return cls(df.withColumns({c: F.lit(v) for c, v in given.items() if v is not None}), sensor, event_resolution)

    @classmethod
    def empty(cls, spark: SparkSession, sensor: Sensor | None = None) -> "BeliefFrame":
        return cls(spark.createDataFrame([], SCHEMA), sensor)

    def __repr__(self) -> str:
        return f"BeliefFrame(sensor: {self.sensor and self.sensor.name}, event_resolution: {self.event_resolution})"

    def _with(self, df: DataFrame, **changes) -> "BeliefFrame":
        return replace(self, df=df, **changes)

    # columns -----------------------------------------------------------------

    @property
    def knowledge_time(self) -> Column:
        return self.sensor.knowledge_time(F.col("event_start"), self.event_resolution)

    @property
    def event_end(self) -> Column:
        return F.col("event_start") + F.lit(self.event_resolution)

    @property
    def horizons(self) -> DataFrame:
        """The beliefs with both belief_time and belief_horizon."""
        return self.df.withColumn("belief_horizon", self.knowledge_time - F.col("belief_time"))

    def in_horizon_form(self) -> DataFrame:
        return self.horizons.drop("belief_time")

    def with_event_end(self) -> DataFrame:
        return self.df.withColumn("event_end", self.event_end).drop("event_start")

    def in_timezone(self, zone: str, column: str = "event_start") -> DataFrame:
        """A column as local wall time of a zone, for display."""
        return self.df.withColumn(column, F.from_utc_timestamp(column, zone))

    def ordered(self) -> DataFrame:
        return self.df.orderBy("event_start", "belief_time", "source", "cumulative_probability")

    # viewpoints --------------------------------------------------------------

    def most_recent(self) -> "BeliefFrame":
        return self._with(V.most_recent(self.df, probabilistic=self.probabilistic))

    def fixed_viewpoint(self, belief_time=None, window=(None, None), update_belief_times=False) -> "BeliefFrame":
        return self._with(V.fixed_viewpoint(self.df, belief_time, window, update_belief_times, self.probabilistic))

    def rolling_viewpoint(self, belief_horizon=None, window=(None, None)) -> "BeliefFrame":
        return self._with(V.rolling_viewpoint(self.horizons, belief_horizon and duration(belief_horizon) if belief_horizon is not None else None, window, self.probabilistic).drop("belief_horizon"))

    def belief_history(self, event_start, **options) -> DataFrame:
        return V.belief_history(self.horizons, event_start, **options)

    def unchanged(self, **flags) -> DataFrame:
        return V.unchanged_beliefs(self.horizons, **flags)

    # accuracy ----------------------------------------------------------------

    def reference(self, **options) -> DataFrame:
        return scoring.reference(self.horizons, probabilistic=self.probabilistic, **options)

    def set_reference_values(self, **options) -> DataFrame:
        return scoring.set_reference_values(self.horizons, probabilistic=self.probabilistic, **options)

    def fixed_viewpoint_accuracy(self, belief_time, reference_source=None, lite=False) -> DataFrame:
        return scoring.fixed_viewpoint_accuracy(self.df, belief_time, reference_source, self.probabilistic, lite)

    def rolling_viewpoint_accuracy(self, belief_horizon, reference_source=None, lite=False) -> DataFrame:
        return scoring.rolling_viewpoint_accuracy(self.horizons, duration(belief_horizon), reference_source, self.probabilistic, lite)

    def accuracy(self, t=None, reference_source=None, lite=False) -> DataFrame:
        """By every horizon where t is None; else as of a moment, or at a horizon."""
        if t is None:
            return scoring.accuracy_by_horizon(self.horizons, source=reference_source, probabilistic=self.probabilistic, lite=lite)
        if isinstance(t, datetime):
            return self.fixed_viewpoint_accuracy(t, reference_source, lite)
        return self.rolling_viewpoint_accuracy(t, reference_source, lite)

    # events ------------------------------------------------------------------

    def resample_events(self, event_resolution, **options) -> "BeliefFrame":
        """Runs a count to choose the path."""
        new = duration(event_resolution)
        return self._with(resample.resample_events(self.df, self.event_resolution, new, zone=self.sensor.timezone, **options), event_resolution=new if self.event_resolution else timedelta(0))

    def propagate(self) -> "BeliefFrame":
        """Deterministic beliefs alone; runs a check."""
        if not self.df.groupBy(*lineage.BELIEF).count().where("count > 1").isEmpty():
            raise NotImplementedError("only deterministic beliefs are propagated")
        return self._with(propagate.propagate_beliefs(self.df))

    def align_belief_times(self, belief_times: DataFrame | None = None) -> "BeliefFrame":
        return self._with(propagate.align_belief_times(self.df, belief_times))

    def make_deterministic(self) -> "BeliefFrame":
        return self._with(scoring.make_deterministic(self.df), probabilistic=False)

    def form_beliefs(self, belief_time, source, window, **options) -> "BeliefFrame":
        return self._with(forecast.form_beliefs(self.df, self.sensor, self.event_resolution, belief_time, source_name(source), window, **options))

    def append(self, other: "BeliefFrame") -> "BeliefFrame":
        return self._with(self.df.unionByName(other.df, allowMissingColumns=True))

    # groups, lineage, charts -------------------------------------------------

    def for_each_belief(self, function: Callable, schema: str) -> DataFrame:
        """A pandas function over each belief's rows."""
        return self.df.groupBy(*lineage.BELIEF).applyInPandas(function, schema)

    def for_each_collective_belief(self, function: Callable, schema: str) -> DataFrame:
        """A pandas function over the rows of all sources that believed at one time."""
        return self.df.groupBy("sensor", "event_start", "belief_time").applyInPandas(function, schema)

    @functools.cached_property
    def lineage(self) -> dict:
        """Counts of events, beliefs, sources and points; runs one aggregate."""
        return lineage.stats(self.df).first().asDict()

    def confidence_bands(self, **options) -> DataFrame:
        return plotdata.confidence_bands(self.df, **options)
