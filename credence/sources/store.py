"""A store of beliefs in Parquet: insert, upsert and search.

Rows hold belief horizons, as beliefs do in time form once the sensor's knowledge time is
known. Files are partitioned by sensor and by the date of the event, so searches read
only the dates they ask for.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credence.operators import viewpoint as V
from credence.sensors import SENSOR_SCHEMA, Sensor, source_name

KEY = ["sensor_id", "event_start", "belief_horizon", "source_id", "cumulative_probability"]
SCHEMA = "event_start timestamp, belief_horizon interval day to second, source_id long, cumulative_probability double, event_value double, sensor_id long, event_date date"


class DuplicateBelief(ValueError):
    """An insert met a belief that is stored already."""


@dataclass
class BeliefStore:
    """Tables below a path: beliefs, sensors, sources. ``extra`` columns of beliefs pass through."""

    spark: SparkSession
    path: str
    extra: str = ""
    beliefs_table: str = "beliefs"

    def _at(self, name: str) -> str:
        return f"{self.path.rstrip('/')}/{name}"

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(self._at(name))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    @property
    def beliefs(self) -> DataFrame:
        schema = SCHEMA.replace(", sensor_id", f", {self.extra}, sensor_id") if self.extra else SCHEMA
        return self._read(self.beliefs_table, schema)

    @property
    def sources(self) -> DataFrame:
        return self._read("sources", "source_id long, name string")

    @property
    def sensors(self) -> DataFrame:
        return self._read("sensors", SENSOR_SCHEMA)

    def add_sensor(self, sensor: Sensor) -> None:
        self.spark.createDataFrame([sensor.row()], SENSOR_SCHEMA).coalesce(1).write.mode("append").parquet(self._at("sensors"))

    def sensor(self, id: int) -> Sensor:
        rows = self.sensors.where(F.col("id") == id).collect()
        if not rows:
            raise ValueError(f"no sensor has id {id}")
        return Sensor.from_row(rows[0])

    def _with_sources(self, df: DataFrame) -> DataFrame:
        """Source names to ids; new names are stored first."""
        new = df.select(F.col("source").alias("name")).distinct().join(self.sources, "name", "left_anti")
        first = self.sources.agg(F.coalesce(F.max("source_id"), F.lit(0))).first()[0]
        names = sorted(r["name"] for r in new.collect())  # sources are a dimension, a few rows
        rows = [(first + i + 1, name) for i, name in enumerate(names)]
        if rows:
            self.spark.createDataFrame(rows, "source_id long, name string").coalesce(1).write.mode("append").parquet(self._at("sources"))
        return df.join(self.sources.withColumnRenamed("name", "source"), "source").drop("source")

    def add(self, df: DataFrame, sensor: Sensor, resolution: timedelta | None = None, allow_overwrite: bool = False) -> None:
        """Stores beliefs (event_start, belief_time or belief_horizon, source, cumulative_probability, event_value).

        Without ``allow_overwrite`` a belief whose key is there raises DuplicateBelief and
        nothing is written. With it the stored value is replaced; only dates that the new
        beliefs touch are written anew. Of new beliefs with one key the one of the largest
        value counts. Each writer has a folder of its own for what it writes before.
        """
        if "belief_horizon" not in df.columns:
            df = df.withColumn("belief_horizon", sensor.knowledge_time(F.col("event_start"), resolution) - F.col("belief_time")).drop("belief_time")
        keep = [c.strip().split()[0] for c in self.extra.split(",")] if self.extra else []
        columns = ["event_start", "belief_horizon", "source_id", "cumulative_probability", "event_value", *keep, "sensor_id", "event_date"]
        new = self._with_sources(df.drop("sensor", "sensor_id")).withColumn("sensor_id", F.lit(sensor.id).cast("long")).withColumn("event_date", F.to_date("event_start")).select(*columns)
        old = self.beliefs
        if not allow_overwrite:
            if not new.join(old, KEY, "left_semi").isEmpty() or not new.groupBy(*KEY).count().where("count > 1").isEmpty():
                raise DuplicateBelief("a belief with this key is stored already")
            self._ordered(new).write.mode("append").partitionBy("sensor_id", "event_date").parquet(self._at(self.beliefs_table))
            return
        rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("event_value").desc_nulls_last(), *keep))
        new = new.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
        touched = new.select("sensor_id", "event_date").distinct()
        stay = old.join(touched, ["sensor_id", "event_date"], "left_semi").join(new, KEY, "left_anti").select(*columns)
        merged = stay.unionByName(new)
        staged = self._at(f"_{self.beliefs_table}_{uuid.uuid4().hex}")
        try:
            self._ordered(merged).write.partitionBy("sensor_id", "event_date").parquet(staged)
            back = self.spark.read.schema(old.schema).parquet(staged)
            back.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sensor_id", "event_date").parquet(self._at(self.beliefs_table))
        finally:
            there = self.spark._jvm.org.apache.hadoop.fs.Path(staged)
            there.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(there, True)

    @staticmethod
    def _ordered(df: DataFrame) -> DataFrame:
        """Sorted files, so that row groups can be skipped by event start and source."""
        return df.repartition("sensor_id", "event_date").sortWithinPartitions("sensor_id", "event_date", "event_start", "source_id")

    def search(self, sensor: Sensor | int, **options) -> DataFrame:
        """The stored beliefs that ``search`` (below) finds, with sensor and source names."""
        sensor = self.sensor(sensor) if isinstance(sensor, int) else sensor
        rows = self.beliefs.where(F.col("sensor_id") == sensor.id).withColumn("sensor", F.lit(sensor.name))
        rows = date_pruned(rows, sensor, **{k: v for k, v in options.items() if k in PRUNING})
        named = rows.join(self.sources.withColumnRenamed("name", "source"), "source_id").drop("source_id", "sensor_id", "event_date")
        return search(named, sensor, **options)


PRUNING = ("event_starts_after", "event_ends_after", "event_starts_before", "event_ends_before", "beliefs_after", "horizons_at_least", "beliefs_before", "horizons_at_most")


def date_pruned(rows: DataFrame, sensor: Sensor, event_starts_after=None, event_ends_after=None, event_starts_before=None, event_ends_before=None, beliefs_after=None, horizons_at_least=None, beliefs_before=None, horizons_at_most=None) -> DataFrame:
    """Dates that can hold an event asked for: also from bounds on belief times, through the knowledge horizon's bounds."""
    low = [x for x in (event_starts_after, event_ends_after and event_ends_after - sensor.event_resolution) if x]
    high = [x for x in (event_starts_before, event_ends_before) if x]
    least, most = sensor.horizon_bounds()
    if beliefs_after and horizons_at_least is not None and least is not None:
        low.append(beliefs_after + least + horizons_at_least)
    if beliefs_before and horizons_at_most is not None and most is not None:
        high.append(beliefs_before + most + horizons_at_most)
    if low:
        rows = rows.where(F.col("event_date") >= F.to_date(F.lit(max(low)).cast("timestamp")))
    if high:
        rows = rows.where(F.col("event_date") <= F.to_date(F.lit(min(high)).cast("timestamp")))
    return rows


def search(
    beliefs: DataFrame,
    sensor: Sensor,
    resolution: timedelta | None = None,
    event_starts_after: datetime | None = None,
    event_ends_after: datetime | None = None,
    event_starts_before: datetime | None = None,
    event_ends_before: datetime | None = None,
    beliefs_after: datetime | None = None,
    beliefs_before: datetime | None = None,
    horizons_at_least: timedelta | None = None,
    horizons_at_most: timedelta | None = None,
    source: str | Sequence[str] | None = None,
    most_recent_beliefs_only: bool = False,
    most_recent_events_only: bool = False,
    most_recent_only: bool = False,
    custom_filters: Sequence[Column] = (),
    custom_joins: Sequence[Callable[[DataFrame], DataFrame]] = (),
    probabilistic: bool = True,
) -> DataFrame:
    """Beliefs of a sensor (horizon form) that meet all conditions, with belief_time added.

    Bounds are inclusive where events are instants; otherwise an event that only touches a
    bound from outside is left out. All filters come before the choice of the latest.
    """
    resolution = sensor.event_resolution if resolution is None else resolution
    instant = not resolution
    start = F.col("event_start")
    moment = lambda x: F.lit(x).cast("timestamp")
    conditions = list(custom_filters)
    if event_starts_after is not None:
        conditions.append(start >= moment(event_starts_after))
    if event_ends_after is not None:
        conditions.append(start >= moment(event_ends_after) if instant else start > moment(event_ends_after) - F.lit(resolution))
    if event_starts_before is not None:
        conditions.append(start <= moment(event_starts_before) if instant else start < moment(event_starts_before))
    if event_ends_before is not None:
        conditions.append(start <= moment(event_ends_before) - F.lit(resolution))
    if horizons_at_least is not None:
        conditions.append(F.col("belief_horizon") >= F.lit(horizons_at_least))
    if horizons_at_most is not None:
        conditions.append(F.col("belief_horizon") <= F.lit(horizons_at_most))
    if source is not None:
        names = [source_name(s) for s in ([source] if isinstance(source, str) or not isinstance(source, Sequence) else source)]
        conditions.append(F.col("source").isin(names) if names else F.lit(False))
    out = beliefs.withColumn("belief_time", sensor.knowledge_time(start, resolution) - F.col("belief_horizon"))
    if beliefs_after is not None:
        conditions.append(F.col("belief_time") >= moment(beliefs_after))
    if beliefs_before is not None:
        conditions.append(F.col("belief_time") <= moment(beliefs_before))
    for join in custom_joins:
        out = join(out)
    for condition in conditions:
        out = out.where(condition)
    one_source = isinstance(source, str) or source is not None and len(list(source)) == 1
    if most_recent_beliefs_only and most_recent_events_only and one_source:
        most_recent_only, most_recent_beliefs_only, most_recent_events_only = True, False, False
    if most_recent_only:
        if most_recent_beliefs_only or most_recent_events_only:
            raise ValueError("most_recent_only can't be combined with the other two")
        return V.most_recent_only(out)
    if most_recent_beliefs_only:
        out = V.most_recent(out, probabilistic=probabilistic)
    if most_recent_events_only:
        out = V.most_recent_events(out)
    return out
