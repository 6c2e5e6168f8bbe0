"""Knowledge horizons: how long before an event's start its value can be known at the latest.

Each function gives a Column of the horizon for a Column of event starts, and bounds on
it that hold for all events, which let filters on belief times reach event starts.
Only registered functions run.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from credence.durations import duration, iso, moment

Bounds = tuple[timedelta | None, timedelta | None]


def instant_of(local: Column, zone: str) -> Column:
    """The moment of a local time; of a time that occurs twice, the later one."""
    first = F.to_utc_timestamp(local, zone)
    later = first + F.expr("INTERVAL '1' HOUR")
    return F.when(F.from_utc_timestamp(later, zone) == local, later).otherwise(first)


def ex_post(event_start: Column, resolution: timedelta, ex_post_horizon: timedelta) -> Column:
    return F.lit(-resolution - ex_post_horizon)


def ex_ante(event_start: Column, resolution: timedelta, ex_ante_horizon: timedelta) -> Column:
    return F.lit(ex_ante_horizon)


def at_date(event_start: Column, resolution: timedelta, knowledge_time: datetime) -> Column:
    return event_start - F.lit(moment(knowledge_time))


def x_days_ago_at_y_oclock(event_start: Column, resolution: timedelta, x: int, y: float, z: str) -> Column:
    day = F.date_sub(F.to_date(F.from_utc_timestamp(event_start, z)), x)
    return event_start - instant_of(day.cast("timestamp") + F.lit(timedelta(microseconds=int(y * 3_600_000_000))), z)


def x_years_ago_at_date(event_start: Column, resolution: timedelta, x: int, day: int, month: int, z: str) -> Column:
    if x <= 0:
        raise ValueError("x must be positive")
    year = F.year(F.from_utc_timestamp(event_start, z)) - F.lit(x)
    local = F.make_date(year, F.lit(month), F.lit(day)).cast("timestamp")
    return event_start - instant_of(local, z)


@dataclass(frozen=True)
class Function:
    horizon: Callable[..., Column]
    bounds: Callable[..., Bounds]


_HOUR, _DAY = timedelta(hours=1), timedelta(days=1)
FUNCTIONS: dict[str, Function] = {
    "ex_post": Function(ex_post, lambda r, ex_post_horizon: (-r - ex_post_horizon,) * 2),
    "ex_ante": Function(ex_ante, lambda r, ex_ante_horizon: (ex_ante_horizon,) * 2),
    "at_date": Function(at_date, lambda r, knowledge_time: (None, None)),
    "x_days_ago_at_y_oclock": Function(x_days_ago_at_y_oclock, lambda r, x, y, z: (x * _DAY - y * _HOUR - 2 * _HOUR, (x + 1) * _DAY - y * _HOUR + 2 * _HOUR)),
    "x_years_ago_at_date": Function(x_years_ago_at_date, lambda r, x, day, month, z: (((x - 1) * 365 + 1) * _DAY, (x + 1) * 366 * _DAY)),
}
FUNCTIONS["x_days_ago_at_y_o_clock"] = FUNCTIONS["x_days_ago_at_y_oclock"]


def _registered(name: str) -> Function:
    if name not in FUNCTIONS:
        raise KeyError(f"{name!r} is no registered knowledge horizon function")
    return FUNCTIONS[name]


def horizon(name: str, parameters: dict, event_start: Column, resolution: timedelta) -> Column:
    """The horizon of a registered function as an interval Column."""
    return _registered(name).horizon(event_start, resolution, **parameters)


def bounds(name: str, parameters: dict, resolution: timedelta) -> Bounds:
    """(least, largest) horizon over all events; None where there is no bound."""
    return _registered(name).bounds(resolution, **parameters)


def to_json(parameters: dict) -> str:
    """Parameters as JSON, durations and moments as ISO 8601 text."""
    return json.dumps({k: iso(v) if isinstance(v, timedelta) else v.isoformat() if isinstance(v, datetime) else v for k, v in parameters.items()})


def from_json(text: str) -> dict:
    """Parameters from JSON; texts that are durations or moments become such."""

    def read(v):
        if isinstance(v, str) and v.lstrip("-").startswith("P"):
            return duration(v)
        if isinstance(v, str):
            try:
                return datetime.fromisoformat(v)
            except ValueError:
                return v
        return v

    return {k: read(v) for k, v in json.loads(text).items()}
