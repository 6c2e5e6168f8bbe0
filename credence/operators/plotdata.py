"""Tables for charts; drawing is left to others."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credence.functions import cdf as C
from credence.operators import scoring
from credence.operators.propagate import align_belief_horizons, pack
from credence.operators.running import running_sums

UNITS = [("years", timedelta(days=365)), ("days", timedelta(days=1)), ("hours", timedelta(hours=1)), ("minutes", timedelta(minutes=1)), ("seconds", timedelta(seconds=1)), ("microseconds", timedelta(microseconds=1))]


def human_unit(span: timedelta) -> tuple[str, timedelta]:
    """The largest unit of which a span has four or more."""
    return next(((n, u) for n, u in UNITS if span >= 4 * u), UNITS[-1])


def confidence_bands(df: DataFrame, ci: float = 0.9, reference_source: str | None = None) -> DataFrame:
    """Each belief's lower, expected and upper value, in one pass; with the reference value where a source is given."""
    packed = pack(df)
    low = (1 - ci) / 2
    value = lambda q: C.value_at(F.col("cdf"), q)["v"]
    out = packed.select("sensor", "event_start", "belief_time", "source", value(low).alias("lower_value"), value(0.5).alias("expected_value"), value(1 - low).alias("upper_value"))
    if reference_source is None:
        return out
    refs = scoring.reference(df, source=reference_source, probabilistic=True)
    return out.join(refs.select(*scoring.EVENT, C.value_at(F.col("reference"), 0.5)["v"].alias("reference_value")), scoring.EVENT, "left")


def horizon_numbers(df: DataFrame, unit: timedelta, intuitive: bool = True) -> DataFrame:
    """belief_horizon as a number of units: before the event's start if ``intuitive``, else before it can be known."""
    span = F.col("event_start") - F.col("belief_time") if intuitive else F.col("belief_horizon")
    return df.withColumn("belief_horizon", F.extract(F.lit("DAY"), span) * F.lit(86400.0 / unit.total_seconds()) + (F.extract(F.lit("HOUR"), span) * 3600 + F.extract(F.lit("MINUTE"), span) * 60 + F.extract(F.lit("SECOND"), span)) / F.lit(unit.total_seconds()))


def accuracy_by_event(df: DataFrame, source: str | None = None) -> DataFrame:
    """mae and reference value of each event and source, over aligned horizons (means by horizon or event follow by groupBy)."""
    horizons = df.select(F.col("belief_horizon").alias("horizon")).distinct()
    held = align_belief_horizons(df, horizons)
    met = held.join(scoring.deterministic_truth(df, source), scoring.EVENT)
    return met.select(*scoring.EVENT, "belief_horizon", F.abs(F.col("event_value") - F.col("reference_value")).alias("mae"), "reference_value")


def mean_accuracy_by_event(df: DataFrame, source: str | None = None) -> DataFrame:
    """Mean error and reference value of each event and source over all horizons that occur, without a row for each of them.

    A belief is held at as many horizons as lie above the next more recent belief's and up
    to its own: a difference of two places in the order of horizons. Deterministic beliefs.
    """
    micros = F.unix_micros(F.lit(scoring.EPOCH).cast("timestamp") + F.col("belief_horizon"))
    known = df.where("event_value is not null").withColumn("_at", micros)
    places = df.select(micros.alias("_at")).distinct().withColumn("one", F.lit(1).cast("long")).withColumn("_all", F.lit(0))
    places = running_sums(places, ["_all"], "_at", ["one"], scoring.SPAN).select("_at", F.col("one_sum").alias("_place"))
    newer = F.lead("_place").over(Window.partitionBy(*scoring.EVENT).orderBy(F.col("_at").desc()))
    held = known.join(places, "_at").withColumn("_n", F.col("_place") - F.coalesce(newer, F.lit(0)))
    met = held.join(scoring.deterministic_truth(df, source), scoring.EVENT)
    error = F.abs(F.col("event_value") - F.col("reference_value"))
    return met.groupBy(*scoring.EVENT).agg((F.sum(error * F.col("_n")) / F.sum("_n")).alias("mae"), F.max("reference_value").alias("reference_value"))


def density_points(df: DataFrame, low: float, high: float, points: int = 101, distribution: str = "normal") -> DataFrame:
    """Densities of each belief at points of a value window, for ridgelines: normal, or the masses of a discrete belief."""
    packed = pack(df)
    if distribution == "discrete":
        cut = packed.select("sensor", "event_start", "belief_time", "source", F.explode(C.masses(C.complete(F.col("cdf")))).alias("m"))
        return cut.select("sensor", "event_start", "belief_time", "source", F.col("m.v").alias("event_value"), (F.col("m.hi") - F.col("m.lo")).alias("density"))
    if distribution == "uniform":
        widths = packed.withColumn("_i", F.explode(F.sequence(F.lit(1), F.greatest(F.size("cdf") - 1, F.lit(1)))))
        a, b = F.get("cdf", F.col("_i") - 1), F.get("cdf", F.col("_i"))
        step = F.lit((high - low) / (points - 1))
        grid = widths.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("event_value", F.col("_k") * step + F.lit(low))
        return grid.where((F.col("event_value") >= a["v"]) & (F.col("event_value") < b["v"])).select("sensor", "event_start", "belief_time", "source", "event_value", F.try_divide(b["cp"] - a["cp"], b["v"] - a["v"]).alias("density"))
    fitted = packed.withColumn("_n", C.normal(F.col("cdf")))
    step = F.lit((high - low) / (points - 1))
    grid = fitted.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("event_value", F.col("_k") * step + F.lit(low))
    z = F.try_divide(F.col("event_value") - F.col("_n.mu"), F.col("_n.sigma"))
    return grid.select("sensor", "event_start", "belief_time", "source", "event_value", F.try_divide(F.exp(-z * z / 2), F.col("_n.sigma") * F.sqrt(2 * F.pi())).alias("density"))
