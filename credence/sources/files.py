"""Beliefs from CSV and spreadsheet files, and back."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credence.operators import lineage, resample
from credence.sensors import Sensor

#: Operations on the value column that a file may ask for by name.
TRANSFORMATIONS = {
    "add": lambda c, x: c + x, "sub": lambda c, x: c - x, "mul": lambda c, x: c * x, "div": lambda c, x: F.try_divide(c, F.lit(x)),
    "abs": lambda c: F.abs(c), "round": lambda c, n=0: F.round(c, n), "fillna": lambda c, x: F.coalesce(c, F.lit(x)),
    "clip": lambda c, low=None, high=None: F.least(F.greatest(c, F.lit(low)), F.lit(high)),
}


def localize(df: DataFrame, column: str, zone: str, order: str, series: Sequence[str] = ()) -> DataFrame:
    """Local times as moments. Of an hour that occurs twice, the second time a series comes to a local time (by ``order``) is the later one.

    ``series`` names the columns that tell beliefs about one event apart: two beliefs
    about one local time are about one event, unless the same belief comes to it twice.
    Only rows of such hours are ordered.
    """
    local = F.col(column)
    first = F.to_utc_timestamp(local, zone)
    later = first + F.expr("INTERVAL '1' HOUR")
    twice = F.from_utc_timestamp(later, zone) == local
    rows = df.withColumn("_first", first).withColumn("_later", F.when(twice, later))
    turn = F.row_number().over(Window.partitionBy(column, *series).orderBy(order))
    hours = rows.where("_later is not null").withColumn(column, F.when(turn > 1, F.col("_later")).otherwise(F.col("_first")))
    others = rows.where("_later is null").withColumn(column, F.col("_first"))
    return others.unionByName(hours).drop("_first", "_later")


#: Ways to write a day before its month.
DAY_FIRST = ("d/M/yyyy H:mm:ss", "d/M/yyyy H:mm", "d/M/yyyy", "d-M-yyyy H:mm:ss", "d-M-yyyy H:mm", "d-M-yyyy", "d.M.yyyy H:mm:ss", "d.M.yyyy H:mm", "d.M.yyyy")


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """The file's columns as text, with _line as the order of rows."""
    kind = path.lower().rsplit(".", 1)[-1]
    if kind == "csv":
        raw = spark.read.options(header=True, inferSchema=False, **options).csv(path)
        return raw.withColumn("_line", F.monotonically_increasing_id())
    if kind in ("xlsx", "xlsm", "xls"):
        import pandas as pd

        sheet = pd.read_excel(path, dtype=str)
        return spark.createDataFrame(sheet.assign(_line=range(len(sheet))))
    raise TypeError(f"files ending in .{kind} are not supported")


def read_beliefs(
    spark: SparkSession,
    path: str,
    sensor: Sensor,
    source: str | None = None,
    sources: Sequence[str] | None = None,
    belief_horizon: timedelta | None = None,
    belief_time: datetime | None = None,
    cumulative_probability: float | None = None,
    resample_to_sensor: bool | timedelta = False,
    timezone: str | None = None,
    filter_by_column: dict | None = None,
    columns: Sequence[str] | None = None,
    event_ends_after: datetime | None = None,
    event_starts_before: datetime | None = None,
    datetime_split: str | None = None,
    datetime_format: str | None = None,
    dayfirst: bool = False,
    round_to_resolution: str | None = None,
    drop_nulls: bool = False,
    transformations: Sequence[dict] = (),
    check_frequency: bool = True,
    **options,
) -> DataFrame:
    """Beliefs (event_start, belief_time or belief_horizon, source, cumulative_probability, event_value) of a file.

    Files with headers that name belief columns keep them; files of two columns hold event
    starts and values, of three also belief times in between.
    """
    raw = read_table(spark, path, **options)
    for name, value in (filter_by_column or {}).items():
        raw = raw.where(F.col(name) == F.lit(str(value)))
    names = list(columns) if columns else [c for c in raw.columns if c != "_line" and c not in (filter_by_column or {})]
    raw = raw.select(*names, "_line")
    if "event_start" not in names:
        if len(names) not in (2, 3):
            raise ValueError("a file without belief columns has two or three")
        given = ["event_start", "event_value"] if len(names) == 2 else ["event_start", "belief_time", "event_value"]
        raw, names = raw.toDF(*given, "_line"), given
    if datetime_split:
        raw = raw.withColumn("event_start", F.split("event_start", datetime_split, 2)[0])
    for c in ("event_start", "belief_time"):
        if c in names:
            text = F.trim(c)
            has_zone = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & text.rlike(r"\d:\d")
            zoned = raw.agg(F.max(has_zone)).first()[0]
            formats = (datetime_format,) if datetime_format else DAY_FIRST if dayfirst else ()
            parsed = F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats), *([] if datetime_format else [F.try_to_timestamp(text)]))
            raw = raw.withColumn(c, parsed)
            if not zoned:
                if timezone is None:
                    raise TypeError(f"{c} has no time zone; give one")
                series = [n for n in ("belief_time", "belief_horizon", "source", "cumulative_probability") if n in names and n != c]
                raw = localize(raw, c, timezone, "_line", series) if c == "event_start" else raw.withColumn(c, F.to_utc_timestamp(c, timezone))
    df = raw.withColumn("event_value", F.expr("try_cast(event_value AS double)"))
    if drop_nulls:
        df = df.dropna(subset=[c for c in names if c in df.columns])
    instant, start = not sensor.event_resolution, F.col("event_start")
    if event_ends_after is not None:
        bound = F.lit(event_ends_after).cast("timestamp")
        df = df.where(start >= bound if instant else start + F.lit(sensor.event_resolution) > bound)
    if event_starts_before is not None:
        bound = F.lit(event_starts_before).cast("timestamp")
        df = df.where(start <= bound if instant else start < bound)
    if belief_horizon is not None and belief_time is not None:
        raise ValueError("give a belief horizon or a belief time, not both")
    if belief_time is not None:
        df = df.withColumn("belief_time", F.lit(belief_time).cast("timestamp"))
    elif belief_horizon is not None:
        df = df.withColumn("belief_time", sensor.knowledge_time(start) - F.lit(belief_horizon))
    df = _with_source(df, source, sources)
    cp = F.lit(0.5 if cumulative_probability is None else cumulative_probability)
    df = df.withColumn("cumulative_probability", F.expr("try_cast(cumulative_probability AS double)") if "cumulative_probability" in names else cp)
    df = df.withColumn("sensor", F.lit(sensor.name)).drop("_line")
    if "belief_time" not in df.columns:
        raise ValueError("a belief time or a belief horizon is asked for")
    df = df.select("sensor", "event_start", "belief_time", "source", "cumulative_probability", "event_value")
    if round_to_resolution:
        df = df.withColumn("event_start", resample.rounded(F.col("event_start"), sensor.event_resolution, round_to_resolution, sensor.timezone))
    df = df.dropDuplicates()
    if resample_to_sensor:
        seen = lineage.most_common_event_frequency(df, sensor.event_resolution).first()
        old = resample_to_sensor if isinstance(resample_to_sensor, timedelta) else seen["frequency"]
        if old != sensor.event_resolution:
            df = resample.downsample(df, sensor.event_resolution, zone=sensor.timezone) if old < sensor.event_resolution else resample.upsample(df, old, sensor.event_resolution)
    if check_frequency and not instant:
        odd = lineage.irregular_starts(df)
        n = odd.count()
        if n:
            raise ValueError(f"{n} events are not spaced by a multiple of the usual frequency, the first at {odd.orderBy('event_start').first()['event_start']}")
    for t in transformations:
        if t["func"] not in TRANSFORMATIONS:
            raise ValueError(f"transformation {t['func']!r} is not supported")
        df = df.withColumn("event_value", TRANSFORMATIONS[t["func"]](F.col("event_value"), *t.get("args", ()), **t.get("kwargs", {})))
    return df


def _with_source(df: DataFrame, source: str | None, sources: Sequence[str] | None) -> DataFrame:
    if source is not None:
        return df.withColumn("source", F.lit(source))
    if "source" not in df.columns:
        raise ValueError("a source is asked for")
    if sources is not None:
        unknown = df.where(~F.col("source").isin(list(sources))).select("source").distinct().limit(3).collect()
        if unknown:
            raise ValueError(f"unknown sources: {[r[0] for r in unknown]}")
    return df


def write_csv(df: DataFrame, path: str) -> None:
    """Beliefs as CSV files with a header; times as ISO 8601 in UTC."""
    shown = df.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") for c, kind in df.dtypes if kind == "timestamp"})
    shown.write.mode("overwrite").option("header", True).csv(path)


def load_time_series(spark: SparkSession, series, sensor: Sensor, source: str, belief_horizon: timedelta, cumulative_probability: float = 0.5) -> DataFrame:
    """Beliefs from a pandas series with a time index, all formed at one horizon."""
    rows = [(t.to_pydatetime(), float(v)) for t, v in series.items()]
    df = spark.createDataFrame(rows, "event_start timestamp, event_value double")
    return df.select(F.lit(sensor.name).alias("sensor"), "event_start", (sensor.knowledge_time(F.col("event_start")) - F.lit(belief_horizon)).alias("belief_time"), F.lit(source).alias("source"), F.lit(cumulative_probability).alias("cumulative_probability"), "event_value")
