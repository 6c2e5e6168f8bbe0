"""Resampling of instantaneous events so that bins stay in step with local midnight across clock changes."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.durations import micros
from credence.operators.resample import DAY
from credence.operators.running import neighbours

AGGREGATES = {
    "mean": F.avg, "max": F.max, "min": F.min, "median": lambda c: F.percentile(c, F.lit(0.5)), "count": F.count,
    "nunique": F.count_distinct, "first": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("event_start"))),
    "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("event_start"))),
    "prod": F.product, "size": lambda c: F.count("*"), "sem": lambda c: F.try_divide(F.stddev(c), F.sqrt(F.count(c))),
    "std": F.stddev, "sum": F.sum, "var": F.variance, "quantile": lambda c: F.percentile(c, F.lit(0.5)),
    "ohlc": lambda c: F.struct(F.min_by(c, "event_start").alias("open"), F.max(c).alias("high"), F.min(c).alias("low"), F.max_by(c, "event_start").alias("close")),
}
#: Steps of a series that are filled in one task.
SPAN = 4096
FILLS = ("asfreq", "ffill", "pad", "bfill", "backfill", "nearest", "interpolate")


def offset(ts: Column, zone: str) -> Column:
    """Microseconds that local time is ahead of UTC."""
    return F.unix_micros(F.from_utc_timestamp(ts, zone)) - F.unix_micros(ts)


def resample_instantaneous(df: DataFrame, resolution: timedelta, method: str = "asfreq", zone: str = "UTC", dropna: bool = True) -> DataFrame:
    """(sensor, source, event_start, event_value) at a new frequency; rows of a series share belief columns.

    For each offset from UTC that occurs, all rows are binned from that offset's midnight,
    and the bins that fall in the offset stay. "asfreq" and the fills give values at the
    bins' starts; the aggregates give one value for each bin.
    """
    if method not in AGGREGATES and method not in FILLS:
        raise NotImplementedError(f"method {method!r} is not supported")
    step = micros(resolution)
    series = ["sensor", "source"]
    offsets = df.select("sensor", offset(F.col("event_start"), zone).alias("_offset")).distinct()  # a zone has a few
    shifted = df.join(offsets, "sensor").withColumn("_local", F.unix_micros("event_start") + F.col("_offset"))
    keys = [*series, "_offset"]
    origins = shifted.groupBy(*keys).agg((F.floor(F.min("_local") / F.lit(DAY)) * F.lit(DAY)).alias("_origin"))
    shifted = shifted.join(origins, keys).withColumn("_bin", F.floor((F.col("_local") - F.col("_origin")) / F.lit(step)))
    at = F.timestamp_micros((F.col("_origin") + F.col("_bin") * F.lit(step) - F.col("_offset")).cast("long"))
    extra = [c for c in ("belief_time", "belief_horizon", "cumulative_probability") if c in df.columns]
    if method in AGGREGATES:
        how = [F.max(c).alias(c) if c != "belief_horizon" else F.min(c).alias(c) for c in extra]
        out = shifted.groupBy(*keys, "_origin", "_bin").agg(AGGREGATES[method]("event_value").alias("event_value"), *how).withColumn("event_start", at)
    else:
        ends = shifted.groupBy(*keys, "_origin").agg(F.min("_bin").alias("_low"), F.max("_bin").alias("_high"))
        grid = ends.withColumn("_bin", F.explode(F.sequence("_low", "_high"))).select(*keys, "_origin", "_bin")
        here = shifted.select(*keys, "_local", "event_value", *extra)
        points = grid.select(*keys, (F.col("_origin") + F.col("_bin") * F.lit(step)).alias("_local")).withColumn("_asked", F.lit(True))
        both = here.withColumn("_asked", F.lit(False)).unionByName(points, allowMissingColumns=True)
        met = both.groupBy(*keys, "_local").agg(F.max("_asked").alias("_asked"), *(F.first(c, ignorenulls=True).alias(c) for c in ["event_value", *extra]), F.max(~F.col("_asked")).alias("_real"))
        if method == "asfreq":
            met = met.where("_asked and _real")
        else:
            met = _filled(met, method, keys, ["event_value", *extra], SPAN * step).where("_asked")
        out = met.withColumn("event_start", F.timestamp_micros((F.col("_local") - F.col("_offset")).cast("long")))
    out = out.where(offset(F.col("event_start"), zone) == F.col("_offset")).select(*series, "event_start", "event_value", *extra)
    return out.where("event_value is not null") if dropna else out


def _filled(met: DataFrame, method: str, keys: list[str], columns: list[str], span: int) -> DataFrame:
    """The columns filled from the known values around, which are found in spans of a series."""
    near = neighbours(met.withColumn("_known", F.when(F.col("event_value").isNotNull(), F.col("_local"))), keys, "_local", [*columns, "_known"], span)
    before, after = (lambda c: F.col(f"{c}_before")), (lambda c: F.col(f"{c}_after"))
    at_before, at_after = before("_known"), after("_known")
    if method in ("ffill", "pad"):
        return near.withColumns({c: before(c) for c in columns})
    if method in ("bfill", "backfill"):
        return near.withColumns({c: after(c) for c in columns})
    if method == "nearest":
        first = at_after.isNull() | (F.col("_local") - at_before < at_after - F.col("_local"))
        return near.withColumns({c: F.when(at_before.isNotNull() & first, before(c)).otherwise(after(c)) for c in columns})
    share = F.try_divide((F.col("_local") - at_before).cast("double"), (at_after - at_before).cast("double"))
    value = F.when(at_after.isNull() | (at_after == at_before), before("event_value")).otherwise(before("event_value") + (after("event_value") - before("event_value")) * share)
    return near.withColumns({"event_value": value} | {c: before(c) for c in columns if c != "event_value"})
