"""Carrying beliefs forward along belief time, and putting them on common belief times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credence.operators.viewpoint import EVENT

#: Keys that the events of a sensor are dealt to where they meet its belief times.
SALT = 16
FORWARD = (Window.unboundedPreceding, Window.currentRow)


def propagate_beliefs(df: DataFrame, values: Sequence[str] = ("event_value",), keys: Sequence[str] = EVENT) -> DataFrame:
    """Fills nulls of each value column with the last value believed before; deterministic beliefs."""
    w = Window.partitionBy(*keys).orderBy("belief_time").rowsBetween(*FORWARD)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in values})


def pack(df: DataFrame, keys: Sequence[str] = (*EVENT, "belief_time")) -> DataFrame:
    """One row for each belief: its points as an array of (cp, v), by probability."""
    point = F.struct(F.col("cumulative_probability").alias("cp"), F.col("event_value").alias("v"))
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("cdf"))


def unpack(df: DataFrame) -> DataFrame:
    """A row for each point again."""
    other = [c for c in df.columns if c != "cdf"]
    return df.select(*other, F.explode("cdf").alias("_p")).select(*other, F.col("_p.cp").alias("cumulative_probability"), F.col("_p.v").alias("event_value"))


def align_belief_times(df: DataFrame, belief_times: DataFrame | None = None) -> DataFrame:
    """Every event and source gets every belief time of its sensor, with what was believed then.

    ``belief_times`` (sensor, belief_time) are those that occur by default. Rows before
    the first belief are dropped; beliefs may have several points.
    """
    beliefs = pack(df)
    times = df.select("sensor", "belief_time").distinct() if belief_times is None else belief_times.select("sensor", "belief_time").distinct()
    first = beliefs.groupBy(*EVENT).agg(F.min("belief_time").alias("_first"))
    # A sensor's events are dealt to sixteen keys, so that a busy sensor is not one.
    first = first.withColumn("_salt", F.pmod(F.xxhash64("event_start", "source"), F.lit(SALT)))
    times = times.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    grid = first.join(times, ["sensor", "_salt"]).where(F.col("belief_time") >= F.col("_first")).drop("_first", "_salt")
    keys = [*EVENT, "belief_time"]
    both = beliefs.withColumn("_asked", F.lit(False)).unionByName(grid.withColumn("cdf", F.lit(None).cast(beliefs.schema["cdf"].dataType)).withColumn("_asked", F.lit(True)))
    met = both.groupBy(*keys).agg(F.first("cdf", ignorenulls=True).alias("cdf"), F.max("_asked").alias("_asked"))
    w = Window.partitionBy(*EVENT).orderBy("belief_time").rowsBetween(*FORWARD)
    return unpack(met.withColumn("cdf", F.last("cdf", ignorenulls=True).over(w)).where("_asked").drop("_asked").select(*keys, "cdf"))


def align_belief_horizons(df: DataFrame, horizons: DataFrame) -> DataFrame:
    """Every event and source gets every horizon up to its oldest, with the belief that holds then (older beliefs copy down)."""
    beliefs = pack(df, (*EVENT, "belief_horizon"))
    older = Window.partitionBy(*EVENT).orderBy(F.col("belief_horizon").desc()).rowsBetween(*FORWARD)
    oldest = beliefs.groupBy(*EVENT).agg(F.max("belief_horizon").alias("_oldest"))
    grid = oldest.join(horizons.select(F.col("horizon").alias("belief_horizon")).distinct(), F.col("belief_horizon") <= F.col("_oldest")).drop("_oldest")
    both = beliefs.unionByName(grid.withColumn("cdf", F.lit(None).cast(beliefs.schema["cdf"].dataType)))
    met = both.groupBy(*EVENT, "belief_horizon").agg(F.first("cdf", ignorenulls=True).alias("cdf"))
    return unpack(met.withColumn("cdf", F.last("cdf", ignorenulls=True).over(older)))


def to_wide(df: DataFrame, probabilities: Sequence[float] | None = None) -> DataFrame:
    """A column event_value_<cp> for each cumulative probability."""
    keys = [c for c in df.columns if c not in ("cumulative_probability", "event_value")]
    grouped = df.groupBy(*keys).pivot("cumulative_probability", list(probabilities) if probabilities is not None else None)
    wide = grouped.agg(F.first("event_value"))
    return wide.select(*keys, *(F.col(f"`{c}`").alias(f"event_value_{float(c):g}") for c in wide.columns if c not in keys))


def to_long(df: DataFrame) -> DataFrame:
    """The reverse of ``to_wide``; nulls are dropped."""
    values = [c for c in df.columns if c.startswith("event_value_")]
    keys = [c for c in df.columns if c not in values]
    points = F.explode(F.array(*[F.struct(F.lit(float(c[12:])).alias("cp"), F.col(f"`{c}`").alias("v")) for c in values])).alias("_p")
    return df.select(*keys, points).select(*keys, F.col("_p.cp").alias("cumulative_probability"), F.col("_p.v").alias("event_value")).where("event_value is not null")
