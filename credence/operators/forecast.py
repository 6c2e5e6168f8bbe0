"""Forming new beliefs with a forecaster."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.durations import micros
from credence.operators.lineage import BELIEF
from credence.operators.viewpoint import EVENT
from credence.sensors import Sensor

#: Takes a series' known (event_start, event_value) and the starts asked for; gives their values.
Forecaster = Callable[[pd.DataFrame, list], list]


def form_beliefs(df: DataFrame, sensor: Sensor, resolution: timedelta, belief_time: datetime, source: str, window: tuple[datetime, datetime], forecaster: str | Forecaster = "last", season: int = 1, concatenate: bool = False) -> DataFrame:
    """Beliefs about the window's events, formed at ``belief_time`` from what was known then.

    Naive forecasters: "last" (the last value, or the last one in the same phase of a
    season of so many events) and "mean" (of all, or of the same phase). A function is
    given each series. Without known values the beliefs have null values.
    """
    start, end = window
    known = df.where(F.col("belief_time") <= F.lit(belief_time))
    first_known = known.sparkSession.range(1).select(sensor.knowledge_time(F.lit(start).cast("timestamp"), resolution).alias("t")).first()["t"]
    if first_known is not None and first_known.timestamp() < belief_time.timestamp():
        raise NotImplementedError("beliefs about events that are known already can't be formed")
    seen = known.agg(F.count_distinct("source").alias("sources"), F.count_distinct(*EVENT).alias("events"), F.count_distinct(*BELIEF).alias("beliefs"), F.count("*").alias("rows")).first()
    if seen["sources"] > 1:
        raise NotImplementedError("the beliefs to forecast from must have one source")
    if seen["rows"] != seen["beliefs"]:
        raise NotImplementedError("the beliefs to forecast from must be deterministic")
    if seen["beliefs"] != seen["events"]:
        raise NotImplementedError("the beliefs to forecast from must be one for each event")
    starts = F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.lit(resolution))
    grid = df.select("sensor").distinct().withColumn("event_start", F.explode(starts)).where(F.col("event_start") < F.lit(end).cast("timestamp"))
    known = known.where("event_value is not null").select("sensor", "event_start", "event_value")
    if callable(forecaster):
        values = _by_function(known, grid, forecaster)
    elif forecaster in ("last", "mean"):
        step = season * micros(resolution)
        phase = F.pmod(F.unix_micros("event_start"), F.lit(step)).alias("_phase") if season > 1 else F.lit(0).cast("long").alias("_phase")
        value = F.max_by("event_value", "event_start") if forecaster == "last" else F.avg("event_value")
        per_phase = known.select("*", phase).groupBy("sensor", "_phase").agg(value.alias("event_value"))
        values = grid.select("*", phase).join(per_phase, ["sensor", "_phase"], "left").drop("_phase")
    else:
        raise NotImplementedError(f"forecaster {forecaster!r} is not supported")
    out = values.select("sensor", "event_start", F.lit(belief_time).cast("timestamp").alias("belief_time"), F.lit(source).alias("source"), F.lit(0.5).alias("cumulative_probability"), "event_value")
    return df.select(out.columns).unionByName(out) if concatenate else out


def _by_function(known: DataFrame, grid: DataFrame, forecaster: Forecaster) -> DataFrame:
    def run(known_rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        asked = asked.sort_values("event_start")
        past = known_rows.sort_values("event_start")[["event_start", "event_value"]]
        values = forecaster(past, list(asked["event_start"])) if len(past) else [None] * len(asked)
        return asked.assign(sensor=asked["_asked"], event_value=pd.Series(values, index=asked.index, dtype="float64"))[["sensor", "event_start", "event_value"]]

    grid = grid.select(F.col("sensor").alias("_asked"), "event_start")
    return known.groupBy("sensor").cogroup(grid.groupBy("_asked")).applyInPandas(run, "sensor string, event_start timestamp, event_value double")
