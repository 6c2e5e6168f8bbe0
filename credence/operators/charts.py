"""Charts as Vega-Lite specifications, from tables that are small by then; drawing them is left to a browser."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.functions import cdf as C
from credence.operators import plotdata
from credence.operators import viewpoint as V

SCHEMA = "https://vega.github.io/schema/vega-lite/v5.json"


def _rows(df: DataFrame) -> list[dict]:
    shown = df.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX") for c, kind in df.dtypes if kind == "timestamp"})
    return [r.asDict(recursive=True) for r in shown.collect()]


def time_series(df: DataFrame, ci: float = 0.9, reference_source: str | None = None, unit: str = "", show_accuracy: bool = False) -> dict:
    """Expected values over event starts by source, with confidence bands; the reference, where one is named, as a line."""
    if show_accuracy and reference_source is None:
        raise ValueError("accuracy is shown against a reference source")
    rows = _rows(plotdata.confidence_bands(df, ci, reference_source))
    x = {"field": "event_start", "type": "temporal", "title": "Time of event"}
    color = {"field": "source", "type": "nominal"}
    layers = [
        {"mark": {"type": "area", "opacity": 0.3}, "encoding": {"x": x, "y": {"field": "lower_value", "type": "quantitative", "title": unit}, "y2": {"field": "upper_value"}, "color": color}},
        {"mark": {"type": "line", "point": True}, "encoding": {"x": x, "y": {"field": "expected_value", "type": "quantitative", "title": unit}, "color": color}},
    ]
    if reference_source is not None:
        layers.append({"mark": {"type": "line", "strokeDash": [4, 4], "color": "black"}, "encoding": {"x": x, "y": {"field": "reference_value", "type": "quantitative"}}})
    if show_accuracy:
        layers.append({"mark": "rule", "transform": [{"calculate": "abs(datum.expected_value - datum.reference_value)", "as": "mae"}], "encoding": {"x": x, "size": {"field": "mae", "type": "quantitative"}}})
    return {"$schema": SCHEMA, "data": {"values": rows}, "layer": layers}


def _ridges(points: list[dict], row: dict) -> dict:
    return {
        "$schema": SCHEMA, "data": {"values": points}, "mark": {"type": "area", "opacity": 0.7, "interpolate": "monotone"},
        "encoding": {"x": {"field": "event_value", "type": "quantitative"}, "y": {"field": "density", "type": "quantitative", "axis": None}, "row": row},
    }


def _one_source(df: DataFrame) -> None:
    if df.select("source").distinct().limit(2).count() != 1:
        raise ValueError("a ridgeline shows the beliefs of one source")


def ridgeline_fixed_viewpoint(df: DataFrame, belief_time: datetime, window: tuple[float, float], distribution: str = "normal") -> dict:
    """A density for each event, as believed at a moment."""
    _one_source(df)
    view = V.fixed_viewpoint(df, belief_time, probabilistic=True)
    points = plotdata.density_points(view, *window, distribution=distribution)
    return _ridges(_rows(points), {"field": "event_start", "type": "temporal"})


def ridgeline_belief_history(df: DataFrame, event_start: datetime, window: tuple[float, float], distribution: str = "normal") -> dict:
    """A density for each belief about an event, from the oldest to the latest."""
    _one_source(df)
    history = V.belief_history(df, event_start, keep_event_start=True)
    points = plotdata.density_points(history, *window, distribution=distribution)
    return _ridges(_rows(points), {"field": "belief_time", "type": "temporal"})


def horizon_axis(df: DataFrame) -> tuple[str, timedelta]:
    """The unit in which a frame's horizons read best."""
    span = df.agg(F.max("belief_horizon").alias("a"), F.min("belief_horizon").alias("b")).first()
    return plotdata.human_unit(span["a"] - span["b"]) if span["a"] is not None else plotdata.UNITS[-1]


def median_line(df: DataFrame) -> DataFrame:
    """The median of each belief, for a plain line."""
    return plotdata.pack(df).select("sensor", "event_start", "belief_time", "source", C.value_at(F.col("cdf"), 0.5)["v"].alias("event_value"))
