"""References and accuracy of beliefs."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credence.functions import cdf as C
from credence.operators import viewpoint as V
from credence.operators.propagate import pack, unpack
from credence.operators.running import running_sums

EVENT = list(V.EVENT)
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def set_event_value_from_source(df: DataFrame, source: str) -> DataFrame:
    """Every source of an event gets the rows of the reference source; events without it are dropped."""
    truth = df.where(F.col("source") == F.lit(source)).drop("source")
    return truth.join(df.select("sensor", "event_start", "source").distinct(), ["sensor", "event_start"])


def require_source(df: DataFrame, source: str) -> None:
    """Raises where an event lacks the reference source."""
    lacking = df.groupBy("sensor", "event_start").agg(F.max(F.col("source") == F.lit(source)).alias("there")).where("not there").limit(1).collect()
    if lacking:
        raise KeyError(f"source {source!r} has no belief about {lacking[0]['event_start']}")


def reference(df: DataFrame, belief_time: datetime | None = None, belief_horizon: timedelta | None = None, source: str | None = None, kind: str = "full", probabilistic: bool = False) -> DataFrame:
    """(sensor, event_start, source, reference): the reference of each event and source as a complete cdf.

    It is the latest belief, or that at a horizon or as of a moment, of each source or of
    one; ``kind`` leaves it as it is ("full") or reduces it to its "mean" or "median".
    """
    if belief_time is not None and belief_horizon is not None:
        raise ValueError("give a reference belief time or a horizon, not both")
    if kind not in ("full", "mean", "median"):
        raise ValueError(f"unknown kind of reference {kind!r}: use 'full', 'mean' or 'median'")
    if belief_time is not None:
        latest = V.fixed_viewpoint(df, belief_time, probabilistic=probabilistic)
    elif belief_horizon is not None:
        latest = V.rolling_viewpoint(df, belief_horizon, probabilistic=probabilistic)
    else:
        latest = V.most_recent(df, probabilistic=probabilistic)
    if source is not None:
        latest = set_event_value_from_source(latest, source)
    cdfs = pack(latest, EVENT)
    point = lambda cp, v: F.array(F.struct(cp.alias("cp"), v.alias("v")))
    if kind == "mean":
        mean = C.mean_uniform(F.col("cdf"))
        cdfs = cdfs.withColumn("cdf", point(F.lit(1.0), mean))
    elif kind == "median":
        cdfs = cdfs.withColumn("cdf", point(F.lit(1.0), C.value_at(F.col("cdf"), 0.5)["v"]))
    return cdfs.select(*EVENT, C.complete(F.col("cdf")).alias("reference"))


def set_reference_values(df: DataFrame, belief_time: datetime | None = None, belief_horizon: timedelta | None = None, source: str | None = None, kind: str = "full", probabilistic: bool = False) -> DataFrame:
    """The beliefs with a reference_value column.

    Full references keep their own probabilities and stand at every belief horizon of the
    frame's events, joined outer; means and medians join every row of the event and source.
    """
    if kind != "full":
        refs = reference(df, belief_time, belief_horizon, source, kind, probabilistic)
        return df.join(refs.select(*EVENT, F.element_at("reference", 1)["v"].alias("reference_value")), EVENT, "left")
    if belief_time is not None:
        latest = V.fixed_viewpoint(df, belief_time, probabilistic=probabilistic)
    elif belief_horizon is not None:
        latest = V.rolling_viewpoint(df, belief_horizon, probabilistic=probabilistic)
    else:
        latest = V.most_recent(df, probabilistic=probabilistic)
    if source is not None:
        latest = set_event_value_from_source(latest, source)
    points = latest.select(*EVENT, "cumulative_probability", F.col("event_value").alias("reference_value"))
    horizons = df.select("sensor", "event_start", "belief_horizon").distinct()
    return df.join(points.join(horizons, ["sensor", "event_start"]), [*EVENT, "belief_horizon", "cumulative_probability"], "full_outer")


def scores(forecast: DataFrame, refs: DataFrame) -> DataFrame:
    """(sensor, event_start, source, crps, reference_value) of probabilistic beliefs; the value is the reference's median."""
    beliefs = pack(forecast.where("event_value is not null"), EVENT).withColumn("cdf", C.complete(F.col("cdf")))
    met = beliefs.join(refs, EVENT, "right")
    return met.select(*EVENT, F.when(F.col("cdf").isNotNull(), C.crps(F.col("cdf"), F.col("reference"))).alias("crps"), C.value_at(F.col("reference"), 0.5)["v"].alias("reference_value"))


def deterministic_scores(forecast: DataFrame, truth: DataFrame) -> DataFrame:
    """The same of single values: the score is the distance. ``truth`` (sensor, event_start, source, reference_value)."""
    met = truth.join(forecast.select(*EVENT, "event_value"), EVENT, "left")
    return met.select(*EVENT, F.abs(F.col("event_value") - F.col("reference_value")).alias("crps"), "reference_value")


def accuracy_of(scored: DataFrame, lite: bool = False, by: tuple[str, ...] = ("source",)) -> DataFrame:
    """mae, mape and wape by source; nulls are skipped, and a division by zero gives null."""
    mae, ref = F.avg("crps"), F.avg("reference_value")
    if lite:
        return scored.groupBy(*by).agg(mae.alias("mae"), ref.alias("reference_value"))
    return scored.groupBy(*by).agg(mae.alias("mae"), F.avg(F.try_divide("crps", "reference_value")).alias("mape"), F.try_divide(mae, ref).alias("wape"))


def deterministic_truth(df: DataFrame, source: str | None = None, belief_time: datetime | None = None, belief_horizon: timedelta | None = None) -> DataFrame:
    """(sensor, event_start, source, reference_value) of single-valued beliefs."""
    if belief_time is not None:
        latest = V.fixed_viewpoint(df, belief_time)
    elif belief_horizon is not None:
        latest = V.rolling_viewpoint(df, belief_horizon)
    else:
        latest = V.most_recent(df)
    if source is not None:
        latest = set_event_value_from_source(latest, source)
    return latest.select(*EVENT, F.col("event_value").alias("reference_value"))


def fixed_viewpoint_accuracy(df: DataFrame, belief_time: datetime, source: str | None = None, probabilistic: bool = False, lite: bool = False, by: tuple[str, ...] = ("source",)) -> DataFrame:
    """Accuracy of the beliefs held at a moment, against the latest belief of each source or of one."""
    view = V.fixed_viewpoint(df, belief_time, probabilistic=probabilistic)
    if probabilistic:
        return accuracy_of(scores(view, reference(df, source=source, probabilistic=True)), lite, by)
    return accuracy_of(deterministic_scores(view, deterministic_truth(df, source)), lite, by)


def rolling_viewpoint_accuracy(df: DataFrame, belief_horizon: timedelta, source: str | None = None, probabilistic: bool = False, lite: bool = False, by: tuple[str, ...] = ("source",)) -> DataFrame:
    """Accuracy of the beliefs held at a horizon before each event."""
    view = V.rolling_viewpoint(df, belief_horizon, probabilistic=probabilistic)
    if probabilistic:
        return accuracy_of(scores(view, reference(df, source=source, probabilistic=True)), lite, by)
    return accuracy_of(deterministic_scores(view, deterministic_truth(df, source)), lite, by)


#: Microseconds of horizons that are summed in one task.
SPAN = 3_600_000_000


def accuracy_by_horizon(df: DataFrame, horizons: DataFrame | None = None, source: str | None = None, probabilistic: bool = False, lite: bool = False) -> DataFrame:
    """Accuracy at every horizon (those that occur, by default), by horizon and source: each as ``rolling_viewpoint_accuracy`` gives it.

    ``horizons`` (horizon: interval). A belief is held from its own horizon down to just
    above the next more recent one's, and is scored once; sums over the beliefs held at a
    horizon are running sums of what begins less what ends, so no belief meets all horizons.
    """
    known = df.where("event_value is not null")
    if probabilistic:
        held = pack(known, (*EVENT, "belief_horizon")).withColumn("cdf", C.complete(F.col("cdf")))
        refs = reference(df, source=source, probabilistic=True).withColumn("reference_value", C.value_at(F.col("reference"), 0.5)["v"])
        score = C.crps(F.col("cdf"), F.col("reference"))
    else:
        held, refs = known, deterministic_truth(df, source)
        score = F.abs(F.col("event_value") - F.col("reference_value"))
    newer = F.lead("belief_horizon").over(Window.partitionBy(*EVENT).orderBy(F.col("belief_horizon").desc()))
    spans = held.withColumn("_newer", newer).join(refs, EVENT).withColumn("crps", score).withColumn("ratio", F.try_divide("crps", "reference_value"))
    micros = lambda c: F.unix_micros(F.lit(EPOCH).cast("timestamp") + F.col(c))
    count = lambda c: F.col(c).isNotNull().cast("long")
    sums = {"_crps": F.coalesce("crps", F.lit(0.0)), "_n": count("crps"), "_ratio": F.coalesce("ratio", F.lit(0.0)), "_m": count("ratio")}
    # Both ends of a span come from one row, so that a belief is scored once.
    begin = F.struct((-micros("belief_horizon")).alias("_at"), *(v.alias(c) for c, v in sums.items()))
    end = F.struct((-micros("_newer")).alias("_at"), *((-v).alias(c) for c, v in sums.items()))
    moves = spans.select("source", F.explode(F.array(begin, end)).alias("_move")).select("source", "_move.*").where("_at is not null")
    means = refs.groupBy("source").agg(F.avg("reference_value").alias("_mean"))  # a row for each source; sources are a dimension
    asked = df.select(F.col("belief_horizon").alias("horizon")).distinct() if horizons is None else horizons.select("horizon").distinct()
    asked = asked.crossJoin(F.broadcast(means)).select("horizon", (-micros("horizon")).alias("_at"), "source", "_mean")
    moves = moves.unionByName(asked.select("source", "_at"), allowMissingColumns=True)
    at = moves.groupBy("source", "_at").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums))
    # The asked horizons join again afterwards: running_sums reads ``at`` twice, and reads the same columns each time.
    summed = running_sums(at, ["source"], "_at", list(sums), SPAN).join(asked, ["source", "_at"])
    mae = F.when(F.col("_n_sum") > 0, F.col("_crps_sum") / F.col("_n_sum"))
    if lite:
        return summed.select("horizon", "source", mae.alias("mae"), F.col("_mean").alias("reference_value"))
    mape = F.when(F.col("_m_sum") > 0, F.col("_ratio_sum") / F.col("_m_sum"))
    return summed.select("horizon", "source", mae.alias("mae"), mape.alias("mape"), F.try_divide(mae, F.col("_mean")).alias("wape"))


def make_deterministic(df: DataFrame) -> DataFrame:
    """Beliefs of several points become their uniform mean, at its cumulative probability."""
    packed = pack(df)
    mean = C.mean_uniform(F.col("cdf"))
    one = packed.withColumn("_mean", mean).withColumn("cdf", F.when(F.size("cdf") == 1, F.col("cdf")).otherwise(F.array(F.struct(C.cp_at_uniform(F.col("cdf"), F.col("_mean")).alias("cp"), F.col("_mean").alias("v")))))
    return unpack(one.drop("_mean"))
