"""What was believed as of a moment, or at a horizon before each event."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Keys of an event as one source sees it.
EVENT = ("sensor", "event_start", "source")


def most_recent(df: DataFrame, order: Column | None = None, keys: Sequence[str] = EVENT, probabilistic: bool = False) -> DataFrame:
    """All rows of the latest belief of each source about each event; beliefs without any value don't count.

    ``order`` rises with recency (belief time by default). Deterministic beliefs are one
    row each, so null values go first and the ranking keeps one row for a key before the
    shuffle. Probabilistic ones keep their null rows if any of their rows has a value.
    """
    order = F.col("belief_time") if order is None else order
    if not probabilistic:
        rank = F.rank().over(Window.partitionBy(*keys).orderBy(order.desc()))
        return df.where(F.col("event_value").isNotNull()).withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    latest = F.max(F.when(F.col("event_value").isNotNull(), order)).over(Window.partitionBy(*keys))
    return df.withColumn("_latest", latest).where(order == F.col("_latest")).drop("_latest")


def between(column: Column, low, high) -> Column:
    """Inclusive bounds; None is none."""
    out = F.lit(True)
    if low is not None:
        out = out & (column >= F.lit(low))
    if high is not None:
        out = out & (column <= F.lit(high))
    return out


def fixed_viewpoint(df: DataFrame, belief_time: datetime | None = None, window: tuple = (None, None), update_belief_times: bool = False, probabilistic: bool = False) -> DataFrame:
    """The latest beliefs as of a moment, or within a window of belief times (both ends inclusive)."""
    if belief_time is not None and tuple(window) != (None, None):
        raise ValueError("give a belief time or a window, not both")
    low, high = (None, belief_time) if belief_time is not None else window
    out = most_recent(df.where(between(F.col("belief_time"), low, high)), probabilistic=probabilistic)
    if update_belief_times and high is not None:
        out = out.withColumn("belief_time", F.lit(high).cast("timestamp"))
    return out


def rolling_viewpoint(df: DataFrame, belief_horizon: timedelta | None = None, window: tuple = (None, None), probabilistic: bool = False) -> DataFrame:
    """The latest beliefs formed at least a horizon before each event could be known, or within a window of horizons.

    ``df`` has a belief_horizon column.
    """
    if belief_horizon is not None and tuple(window) != (None, None):
        raise ValueError("give a belief horizon or a window, not both")
    low, high = (belief_horizon, None) if belief_horizon is not None else window
    return most_recent(df.where(between(F.col("belief_horizon"), low, high)), order=-F.col("belief_horizon"), probabilistic=probabilistic)


def belief_history(df: DataFrame, event_start: datetime, belief_time_window: tuple = (None, None), belief_horizon_window: tuple = (None, None), keep_event_start: bool = False) -> DataFrame:
    """All beliefs about one event, optionally within a window of belief times or of horizons."""
    by_time, by_horizon = tuple(belief_time_window) != (None, None), tuple(belief_horizon_window) != (None, None)
    if by_time and by_horizon:
        raise ValueError("give a window of belief times or of horizons, not both")
    out = df.where(F.col("event_start") == F.lit(event_start))
    if by_time:
        out = out.where(between(F.col("belief_time"), *belief_time_window))
    if by_horizon:
        out = out.where(between(F.col("belief_horizon"), *belief_horizon_window))
    return out if keep_event_start else out.drop("event_start")


def compared_with_previous(df: DataFrame, include_positive_horizons: bool = True, include_non_positive_horizons: bool = True, keys: Sequence[str] = EVENT) -> DataFrame:
    """Adds previous_value: what the belief before said; one flag limits which beliefs may be that one, both off limit none.

    A belief before that has no value is the one before all the same. ``df`` has belief_time,
    and belief_horizon where one flag is off. Deterministic beliefs.
    """
    order = Window.partitionBy(*keys).orderBy("belief_time")
    if include_positive_horizons == include_non_positive_horizons:
        return df.withColumn("previous_value", F.lag("event_value").over(order))
    zero = F.lit(timedelta(0))
    allowed = F.col("belief_horizon") > zero if include_positive_horizons else F.col("belief_horizon") <= zero
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("previous_value", F.last(F.when(allowed, F.struct("event_value")), ignorenulls=True).over(before)["event_value"])


def unchanged_beliefs(df: DataFrame, include_positive_horizons: bool = True, include_non_positive_horizons: bool = True) -> DataFrame:
    """Beliefs that say what the belief before them said."""
    out = compared_with_previous(df, include_positive_horizons, include_non_positive_horizons)
    return out.where(F.col("event_value") == F.col("previous_value")).drop("previous_value")


def unchanged_probabilistic(df: DataFrame) -> DataFrame:
    """Rows of beliefs of several rows whose value any row of the belief just before has too."""
    previous = F.lag("belief_time").over(Window.partitionBy(*EVENT).orderBy("belief_time"))
    times = df.select(*EVENT, "belief_time").distinct().withColumn("_previous", previous)
    before = df.select(*EVENT, F.col("belief_time").alias("_previous"), "event_value").distinct()
    return df.join(times, [*EVENT, "belief_time"]).join(before, [*EVENT, "_previous", "event_value"], "left_semi").drop("_previous")


def changed_beliefs(df: DataFrame) -> DataFrame:
    """Beliefs that are the first about an event, or say something else than the one before."""
    out = compared_with_previous(df)
    return out.where(F.col("previous_value").isNull() | (F.col("event_value") != F.col("previous_value"))).drop("previous_value")


def most_recent_events(df: DataFrame, keys: Sequence[str] = ("sensor", "source")) -> DataFrame:
    """All rows of the latest event of each source."""
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(F.col("event_start").desc()))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def most_recent_only(df: DataFrame) -> DataFrame:
    """One row: the latest belief about the latest event; ties by source and probability."""
    return df.orderBy(F.col("event_start").desc(), F.col("belief_time").desc(), "source", "cumulative_probability").limit(1)


def at_horizons(df: DataFrame, horizons: DataFrame, keys: Sequence[str] = EVENT) -> DataFrame:
    """The belief that holds at each of many horizons, in one pass: a row for each event and horizon.

    ``horizons`` (horizon: interval) is distinct; the result has a row for each pair. A belief holds from its own
    horizon down to just above the next more recent one's. Deterministic beliefs.
    """
    newer = F.lead("belief_horizon").over(Window.partitionBy(*keys).orderBy(F.col("belief_horizon").desc()))
    spans = df.where(F.col("event_value").isNotNull()).withColumn("_newer", newer)
    holds = (F.col("horizon") <= F.col("belief_horizon")) & (F.col("_newer").isNull() | (F.col("horizon") > F.col("_newer")))
    return spans.join(horizons, holds).drop("_newer")
