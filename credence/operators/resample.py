"""Resampling of events. Each path has its own anchor for its bins; none shares it with another."""

from __future__ import annotations

import math
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.durations import micros
from credence.functions import cdf as C
from credence.operators import joint
from credence.operators.propagate import align_belief_times, pack
from credence.operators.viewpoint import most_recent

DAY = 86_400_000_000
SERIES = ["sensor", "source"]


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def _moment(us: Column) -> Column:
    return F.timestamp_micros(us.cast("long"))


def local_micros(ts: Column, zone: str) -> Column:
    """Local wall time as microseconds."""
    return _micros(F.from_utc_timestamp(ts, zone))


def downsample(df: DataFrame, resolution: timedelta, method: str = "mean", zone: str = "UTC") -> DataFrame:
    """One deterministic belief per event to coarser events: bins begin at the series' first event.

    Whole days are days of the zone. Empty bins give no row; the latest belief time stays.
    """
    step = micros(resolution)
    by_day = step % DAY == 0
    at = local_micros(F.col("event_start"), zone) if by_day else _micros(F.col("event_start"))
    first = df.groupBy(*SERIES).agg(F.min("event_start").alias("_start"))
    origin = local_micros(F.col("_start"), zone) if by_day else _micros(F.col("_start"))
    bin_ = F.floor((at - origin) / F.lit(step))
    binned = df.join(first, SERIES).withColumn("_bin", origin + bin_ * F.lit(step))
    start = F.to_utc_timestamp(_moment(F.col("_bin")), zone) if by_day else _moment(F.col("_bin"))
    value = {"mean": F.avg, "sum": F.sum}[method]("event_value")
    out = binned.groupBy(*SERIES, "_bin").agg(F.max("belief_time").alias("belief_time"), F.avg("cumulative_probability").alias("cumulative_probability"), value.alias("event_value"))
    return out.select("sensor", start.alias("event_start"), "belief_time", "source", "cumulative_probability", "event_value")


def upsample(df: DataFrame, old: timedelta, new: timedelta, method: str = "mean", keep_nulls: bool = False) -> DataFrame:
    """One deterministic belief per event to finer events on a grid from the series' first event.

    Each event fills the grid's starts from its own on, at most ceil(old / new) of them, up
    to the next event that starts on the grid; gaps stay. "sum" divides by the ratio.
    """
    if method not in ("mean", "sum"):
        raise ValueError(f"unsupported resampling method {method!r}")
    ratio = micros(old) / micros(new)
    steps, size = max(math.ceil(ratio), 1), micros(new)
    at = _micros(F.col("event_start"))
    ends = df.groupBy(*SERIES).agg(F.min(at).alias("_from"), (F.max(at) + F.lit(micros(old))).alias("_end"))
    rows = df.withColumn("_at", at).join(ends, SERIES).where(F.pmod(F.col("_at") - F.col("_from"), F.lit(size)) == 0)
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps - 1).cast("long"))))
    rows = rows.withColumn("_start", F.col("_at") + F.col("_k") * F.lit(size)).where("_start < _end")
    # Where events overlap, the one that starts last counts; a key is a series and a start, so no long series meets in a task.
    kept = F.max_by(F.struct("belief_time", "cumulative_probability", "event_value"), "_at").alias("_row")
    rows = rows.groupBy(*SERIES, "_start").agg(kept).select(*SERIES, "_start", "_row.*")
    if not keep_nulls:
        rows = rows.where("event_value is not null")
    value = F.col("event_value") / F.lit(ratio) if method == "sum" else F.col("event_value")
    return rows.select("sensor", _moment(F.col("_start")).alias("event_start"), "belief_time", "source", "cumulative_probability", value.alias("event_value"))


def to_instantaneous(df: DataFrame, resolution: timedelta, boundary: str = "first") -> DataFrame:
    """Each event becomes its start and its end instant; where two meet, the own start, the least or the largest value counts."""
    starts = df.withColumn("_own", F.lit(True))
    ends = df.withColumn("event_start", F.col("event_start") + F.lit(resolution)).withColumn("_own", F.lit(False))
    keys = ["sensor", "event_start", "belief_time", "source", "cumulative_probability"]
    own, other = F.max(F.when(F.col("_own"), F.col("event_value"))), F.max(F.when(~F.col("_own"), F.col("event_value")))
    value = {"first": F.coalesce(own, other), "min": F.min("event_value"), "max": F.max("event_value")}[boundary]
    return starts.unionByName(ends).groupBy(*keys).agg(value.alias("event_value"))


def join_beliefs(df: DataFrame, old: timedelta, new: timedelta, zone: str = "UTC", native_pairs: bool = False) -> DataFrame:
    """Probabilistic beliefs to coarser events: the joint distribution of the mean over each bin.

    Bins begin at midnight of the series' first day; a bin is named by its earliest event.
    """
    if not old or micros(new) % micros(old):
        raise NotImplementedError("the new resolution must be a multiple of the old one, which must not be zero")
    packed = pack(df.where("event_value is not null")).withColumn("cdf", C.complete(F.col("cdf")))
    first = df.groupBy("sensor").agg(F.min("event_start").alias("_start"))
    local = lambda c: local_micros(F.col(c), zone)
    midnight = F.floor(local("_start") / F.lit(DAY)) * F.lit(DAY)
    binned = packed.join(first, "sensor").withColumn("_bin", F.floor((local("event_start") - midnight) / F.lit(micros(new))))
    keys = ["sensor", "_bin", "belief_time", "source"]
    out = joint.joint_of_two(binned, keys) if native_pairs else joint.joint_of_groups(binned, keys)
    return out.select("sensor", "event_start", "belief_time", "source", "cumulative_probability", "event_value")


def split_beliefs(df: DataFrame, old: timedelta, new: timedelta) -> DataFrame:
    """Probabilistic beliefs to finer events: each row repeats; nulls stay null."""
    if micros(old) % micros(new):
        raise NotImplementedError("the old resolution must be a multiple of the new one")
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(micros(old) // micros(new) - 1).cast("long"))).alias("_k")
    start = _moment(_micros(F.col("event_start")) + F.col("_k") * F.lit(micros(new)))
    return df.select("*", k).withColumn("event_start", start).drop("_k")


def resample_events(df: DataFrame, old: timedelta, new: timedelta, keep_only_most_recent_belief: bool = False, keep_nulls: bool = False, boundary: str = "first", method: str = "mean", zone: str = "UTC") -> DataFrame:
    """Events of one resolution to another: picks the path by what the frame holds."""
    if old == new:
        return df
    if not old:
        if method != "mean":
            raise NotImplementedError("instantaneous events are resampled by 'mean' only")
        from credence.operators.instantaneous import resample_instantaneous

        return resample_instantaneous(df, new, "asfreq", zone)
    if not new:
        return to_instantaneous(df, old, boundary)
    seen = df.agg(F.count_distinct("sensor", "event_start", "belief_time", "source").alias("beliefs"), F.count("*").alias("rows"), F.count_distinct("sensor", "event_start").alias("events"), F.count_distinct("source").alias("sources"), F.count_distinct("belief_time").alias("times")).first()
    if not seen["rows"]:
        return df
    plain = seen["rows"] == seen["beliefs"] == seen["events"] and seen["sources"] == 1
    if plain and (keep_only_most_recent_belief or new < old or seen["times"] == 1):
        return downsample(df, new, method, zone) if new > old else upsample(df, old, new, method, keep_nulls)
    if method != "mean":
        raise NotImplementedError("beliefs that differ in time, source or probability are resampled by 'mean' only")
    if keep_only_most_recent_belief:
        latest = most_recent(df, probabilistic=True)
        now = df.agg(F.max("belief_time").alias("t")).first()["t"]
        df = latest.withColumn("belief_time", F.lit(now).cast("timestamp"))
    else:
        df = align_belief_times(df)
    return join_beliefs(df, old, new, zone) if new > old else split_beliefs(df, old, new)


def rounded(ts: Column, resolution: timedelta, how: str, zone: str = "UTC") -> Column:
    """Event starts moved to whole steps of the resolution: "floor", "ceil" or "round" (half to even)."""
    step = micros(resolution)
    at = local_micros(ts, zone) if step % DAY == 0 else _micros(ts)
    ratio = at / F.lit(step)
    whole = {"floor": F.floor(ratio), "ceil": F.ceil(ratio), "round": F.bround(ratio, 0).cast("long")}[how] * F.lit(step)
    return F.to_utc_timestamp(_moment(whole), zone) if step % DAY == 0 else _moment(whole)
