"""What a frame holds: counts of events, beliefs, sources and points, and the spacing of events."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credence.operators.viewpoint import EVENT

BELIEF = (*EVENT, "belief_time")


def unique(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of events, belief times, horizons or sources."""
    return df.select(column).distinct()


def depth_per_belief(df: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Number of points of each belief."""
    return df.groupBy(*BELIEF, *also).agg(F.count("*").alias("depth"))


def depth_count(df: DataFrame) -> DataFrame:
    """How many beliefs have how many points."""
    return depth_per_belief(df).groupBy("depth").agg(F.count("*").alias("n_beliefs"))


def stats(df: DataFrame) -> DataFrame:
    """One row of counts, over beliefs that are aggregated once."""
    sure = F.count_if(F.col("depth") == 1)
    n = F.count("*")
    horizons = [F.count_distinct("belief_horizon").alias("number_of_belief_horizons")] if "belief_horizon" in df.columns else []
    beliefs = depth_per_belief(df, ["belief_horizon"] if horizons else [])
    return beliefs.agg(
        *horizons,
        F.count_distinct("sensor", "event_start").alias("number_of_events"),
        F.count_distinct("belief_time").alias("number_of_belief_times"),
        F.count_distinct("source").alias("number_of_sources"),
        n.alias("number_of_beliefs"),
        sure.alias("number_of_deterministic_beliefs"),
        (n - sure).alias("number_of_probabilistic_beliefs"),
        F.coalesce(F.try_divide(sure, n), F.lit(1.0)).alias("percentage_of_deterministic_beliefs"),
        F.coalesce(F.try_divide(n - sure, n), F.lit(0.0)).alias("percentage_of_probabilistic_beliefs"),
        F.coalesce(F.try_divide(F.sum("depth"), n), F.lit(1.0)).alias("probabilistic_depth"),
    )


def unique_beliefs_per_event_per_source(df: DataFrame) -> bool:
    """Whether no event has two rows of one source and probability."""
    return df.groupBy(*EVENT, "cumulative_probability").count().where("count > 1").isEmpty()


def event_time_window(df: DataFrame, resolution: timedelta) -> DataFrame:
    """(first, last): from the first event's start to the last one's end."""
    return df.agg(F.min("event_start").alias("first"), (F.max("event_start") + F.lit(resolution)).alias("last"))


def with_previous_start(df: DataFrame, days: int = 30) -> DataFrame:
    """(sensor, event_start, previous): each distinct event start and the one before it.

    Starts are compared within spans of days, and over the borders of spans through one
    row for each, so that a sensor of very many events doesn't meet in a task.
    """
    span = F.floor(F.unix_micros("event_start") / F.lit(days * 86_400_000_000))
    starts = df.select("sensor", "event_start").distinct().withColumn("_span", span)
    ends = starts.groupBy("sensor", "_span").agg(F.max("event_start").alias("_last"))
    ends = ends.select("sensor", "_span", F.lag("_last").over(Window.partitionBy("sensor").orderBy("_span")).alias("_before"))
    inside = starts.withColumn("_inside", F.lag("event_start").over(Window.partitionBy("sensor", "_span").orderBy("event_start")))
    return inside.join(ends, ["sensor", "_span"]).select("sensor", "event_start", F.coalesce("_inside", "_before").alias("previous"))


def spacings(df: DataFrame) -> DataFrame:
    """(sensor, gap, n): how often neighbouring event starts lie how far apart."""
    gaps = with_previous_start(df).select("sensor", (F.col("event_start") - F.col("previous")).alias("gap"))
    return gaps.where("gap is not null").groupBy("sensor", "gap").agg(F.count("*").alias("n"))


def event_frequency(df: DataFrame, resolution: timedelta) -> DataFrame:
    """(sensor, frequency): the constant spacing of events; the resolution of a single event; null if it varies."""
    known = df.select("sensor").distinct().join(spacings(df), "sensor", "left").groupBy("sensor").agg(F.count("gap").alias("kinds"), F.min("gap").alias("gap"))
    return known.select("sensor", F.when(F.col("kinds") == 0, F.lit(resolution)).when(F.col("kinds") == 1, F.col("gap")).alias("frequency"))


def most_common_event_frequency(df: DataFrame, resolution: timedelta) -> DataFrame:
    """(sensor, frequency): the most common spacing, the smallest on a tie; the resolution of a single event."""
    order = F.struct(F.col("n").alias("n"), (-F.col("gap")).alias("g"))
    known = df.select("sensor").distinct().join(spacings(df), "sensor", "left").groupBy("sensor").agg(F.max_by("gap", order).alias("gap"))
    return known.select("sensor", F.coalesce("gap", F.lit(resolution)).alias("frequency"))


def irregular_starts(df: DataFrame) -> DataFrame:
    """(event_start, gap) of events whose distance from the one before is no multiple of the most common one."""
    gaps = with_previous_start(df).withColumn("gap", F.unix_micros("event_start") - F.unix_micros("previous")).where("gap is not null")
    usual = gaps.groupBy("sensor", "gap").agg(F.count("*").alias("n")).groupBy("sensor").agg(F.max_by("gap", F.struct(F.col("n").alias("n"), (-F.col("gap")).alias("g"))).alias("usual"))
    return gaps.join(usual, "sensor").where(F.pmod("gap", "usual") != 0).select("sensor", "event_start", "gap", "usual")


def replace_level(df: DataFrame, level: str, values: DataFrame) -> DataFrame:
    """Rows whose level is among ``values`` (one column of that name) stay; new values get null rows with the first row's other keys."""
    values = values.select(level).distinct()
    stay = df.join(values, level, "left_semi")
    fresh = values.join(df.select(level).distinct(), level, "left_anti")
    others = [c for c in df.columns if c not in (level, "event_value")]
    first = df.orderBy("event_start", *others).limit(1).select(*others)  # one row
    return stay.unionByName(fresh.crossJoin(F.broadcast(first)).withColumn("event_value", F.lit(None).cast("double")))


def time_grid(spark, start, end, resolution: timedelta, inclusive: str = "left") -> DataFrame:
    """(event_start): moments from start to end in steps; the end is left out unless "both"."""
    grid = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.lit(resolution))).alias("event_start"))
    return grid if inclusive == "both" else grid.where(F.col("event_start") < F.lit(end).cast("timestamp"))


def respect_event_resolution(df: DataFrame, parent: timedelta, resolution: timedelta) -> DataFrame:
    """Null rows for the sub-events that a parent event lacks, for every belief about it."""
    start = F.timestamp_micros((F.floor(F.unix_micros("event_start") / F.lit(int(parent.total_seconds() * 1e6))) * F.lit(int(parent.total_seconds() * 1e6))).cast("long"))
    k = int(parent / resolution)
    keys = ["sensor", "belief_time", "source", "cumulative_probability"]
    whole = df.select(*keys, start.alias("_p")).distinct().withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))))
    whole = whole.withColumn("event_start", F.timestamp_micros((F.unix_micros("_p") + F.col("_k") * F.lit(int(resolution.total_seconds() * 1e6))).cast("long"))).drop("_p", "_k")
    return whole.join(df, [*keys, "event_start"], "left").select(*df.columns)
