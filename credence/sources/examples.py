"""Small frames for examples and tests."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import SparkSession

from credence.frame import BeliefFrame
from credence.sensors import Sensor


# What Source A believes at two times about four events, at one standard deviation below, at and above the mean.
WEIGHTS = [
    [(90, 100, 110), (180, 200, 220), (270, 300, 330), (360, 400, 440)],
    [(99, 100, 101), (198, 200, 202), (297, 300, 303), (396, 400, 404)],
]


def sixteen_beliefs(spark: SparkSession) -> BeliefFrame:
    """Sixteen probabilistic beliefs: four hourly events, two belief times, two sources."""
    sensor = Sensor("weight", "kg", "UTC", timedelta(minutes=15), id=1)
    start = datetime(2000, 1, 3, 9, tzinfo=timezone.utc)
    rows = []
    for b, events in enumerate(WEIGHTS):
        when = datetime(2000, 1, 1, b, tzinfo=timezone.utc)
        for e, values in enumerate(events):
            rows += [(start + timedelta(hours=e), when, "Source A", cp, float(v)) for cp, v in zip((0.1587, 0.5, 0.8413), values)]
            rows += [(start + timedelta(hours=e), when, "Source B", cp, v) for cp, v in ((0.5, 0.0), (1.0, 100.0 * (e + 1)))]
    return BeliefFrame.of(spark, rows, sensor)


def grid_beliefs(spark: SparkSession, sensor: Sensor, events: int, times: int, sources: int, points: int, start: datetime) -> BeliefFrame:
    """Events by the hour, belief times by the hour, sources and points of equal steps; value = 1000 e + 100 b + 10 s + p."""
    rows = []
    for e in range(events):
        for b in range(times):
            for s in range(sources):
                for p in range(points):
                    cp = (p + 1) / points if points > 1 else 0.5
                    when = start - timedelta(days=2) + timedelta(hours=b)
                    rows.append((start + timedelta(hours=e), when, f"Source {s}", cp, 1000.0 * e + 100 * b + 10 * s + p))
    return BeliefFrame.of(spark, rows, sensor)
