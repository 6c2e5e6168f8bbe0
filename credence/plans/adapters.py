"""Beliefs from the general-purpose tables, and their sensors."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credence.sensors import Sensor

#: Events of a day, known six hours after their start at the latest.
EVENTS = Sensor("events", "", "UTC", timedelta(hours=6), id=1)
#: Events of a whole day.
DAILY = Sensor("daily", "", "UTC", timedelta(days=1), id=2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def deterministic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beliefs of three sources about each day's value of each event type; one row each."""
    return beliefs_of(table(spark, sf_dir, "events"))


def beliefs_of(t: DataFrame) -> DataFrame:
    """The same of any frame, or stream, of events."""
    beliefs = t.select(
        F.col("event_type").alias("sensor"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("event_start"), F.col("ts").cast("timestamp").alias("belief_time"),
        F.concat(F.lit("S"), (F.col("user_id") % 3).cast("string")).alias("source"), F.lit(0.5).alias("cumulative_probability"), F.col("value").alias("event_value"),
    )
    return beliefs.where("event_start is not null and belief_time is not null")


def horizons(beliefs: DataFrame, sensor: Sensor = EVENTS) -> DataFrame:
    return beliefs.withColumn("belief_horizon", sensor.knowledge_time(F.col("event_start")) - F.col("belief_time"))


def probabilistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beliefs of several points: the spread of the values that a source saw in six hours."""
    b = deterministic(spark, sf_dir)
    end = F.timestamp_micros(((F.floor(F.unix_micros("belief_time") / F.lit(21_600_000_000)) + 1) * F.lit(21_600_000_000)).cast("long"))
    b = b.withColumn("belief_time", end)
    belief = Window.partitionBy("sensor", "event_start", "source", "belief_time")
    spread = b.withColumn("cumulative_probability", F.cume_dist().over(belief.orderBy("event_value")))
    return spread.distinct().select(b.columns)


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beliefs formed when an order was made about the quantity shipped on a day, by return flag."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_shipdate", "l_returnflag").agg(F.sum("l_quantity").alias("quantity"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.lit("quantity").alias("sensor"), F.col("l_shipdate").cast("timestamp").alias("event_start"), F.col("o_orderdate").cast("timestamp").alias("belief_time"),
        F.col("l_returnflag").alias("source"), F.lit(0.5).alias("cumulative_probability"), F.col("quantity").alias("event_value"),
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value by hour of each event type: one belief of one source for each event, formed after all of them."""
    t = table(spark, sf_dir, "events")
    rows = t.groupBy(F.col("event_type").alias("sensor"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("event_start")).agg(F.avg("value").alias("event_value"))
    return rows.select("sensor", "event_start", F.lit("2024-03-01").cast("timestamp").alias("belief_time"), F.lit("S").alias("source"), F.lit(0.5).alias("cumulative_probability"), "event_value")



#: The same in DuckDB's SQL.
SQL = {
    "b": """b AS (SELECT event_type AS sensor, date_trunc('day', ts) AS event_start, ts AS belief_time, 'S' || (user_id % 3) AS source,
      0.5::DOUBLE AS cumulative_probability, value AS event_value,
      epoch_us(date_trunc('day', ts) + INTERVAL 6 HOUR) - epoch_us(ts) AS horizon FROM events WHERE ts IS NOT NULL)""",
    "p": """p0 AS (SELECT sensor, event_start, source, make_timestamp((epoch_us(belief_time) // 21600000000 + 1) * 21600000000) AS belief_time, event_value FROM b),
    p AS (SELECT DISTINCT sensor, event_start, belief_time, source, event_value,
      cume_dist() OVER (PARTITION BY sensor, event_start, source, belief_time ORDER BY event_value) AS cumulative_probability FROM p0)""",
    "s": """s AS (SELECT l_shipdate::TIMESTAMP AS event_start, o_orderdate::TIMESTAMP AS belief_time, l_returnflag AS source, quantity AS event_value
      FROM (SELECT l_orderkey, l_shipdate, l_returnflag, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL) JOIN orders ON l_orderkey = o_orderkey)""",
    "h": """h AS (SELECT event_type AS sensor, date_trunc('hour', ts) AS event_start, avg(value) AS event_value FROM events GROUP BY ALL)""",
}
