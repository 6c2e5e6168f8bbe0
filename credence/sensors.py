"""Sensors and sources of beliefs."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql import Column

from credence.durations import duration
from credence.functions import knowledge


@dataclass(frozen=True)
class Sensor:
    """What an event is measured by. Its knowledge horizon is a registered function, or a fixed time before the event."""

    name: str
    unit: str = ""
    timezone: str = "UTC"
    event_resolution: timedelta | str = timedelta(0)
    knowledge_horizon: timedelta | tuple[str, dict] | None = None
    id: int | None = None
    function: str = field(init=False, default="")
    parameters: dict = field(init=False, default_factory=dict, hash=False)

    def __post_init__(self):
        put = functools.partial(object.__setattr__, self)
        put("event_resolution", duration(self.event_resolution))
        given = self.knowledge_horizon
        if given is None:
            name, par = "ex_post", {"ex_post_horizon": timedelta(0)}
        elif isinstance(given, timedelta):
            name, par = "ex_ante", {"ex_ante_horizon": given}
        else:
            name, par = given
        if name not in knowledge.FUNCTIONS:
            raise KeyError(f"{name!r} is no registered knowledge horizon function")
        put("function", name)
        put("parameters", dict(par))

    def horizon(self, event_start: Column, resolution: timedelta | None = None) -> Column:
        """Knowledge horizon of events; the resolution of the frame at hand goes before the sensor's own."""
        return knowledge.horizon(self.function, self.parameters, event_start, self.event_resolution if resolution is None else resolution)

    def knowledge_time(self, event_start: Column, resolution: timedelta | None = None) -> Column:
        """When events can be known at the latest."""
        return event_start - self.horizon(event_start, resolution)

    def horizon_bounds(self, resolution: timedelta | None = None) -> knowledge.Bounds:
        return knowledge.bounds(self.function, self.parameters, self.event_resolution if resolution is None else resolution)

    def row(self) -> tuple:
        """As a row of a table of sensors."""
        return (self.id, self.name, self.unit, self.timezone, self.event_resolution, self.function, knowledge.to_json(self.parameters))

    @classmethod
    def from_row(cls, row) -> "Sensor":
        return cls(row["name"], row["unit"], row["timezone"], row["event_resolution"], (row["knowledge_horizon_fnc"], knowledge.from_json(row["knowledge_horizon_par"])), row["id"])


SENSOR_SCHEMA = "id long, name string, unit string, timezone string, event_resolution interval day to second, knowledge_horizon_fnc string, knowledge_horizon_par string"


@functools.total_ordering
@dataclass(frozen=True, eq=True)
class BeliefSource:
    """Who believes; sources are ordered by name."""

    name: str

    def __post_init__(self):
        if isinstance(self.name, int) and not isinstance(self.name, bool):
            object.__setattr__(self, "name", str(self.name))
        if not isinstance(self.name, str):
            raise TypeError("a source's name is a text or a whole number")

    def __lt__(self, other: "BeliefSource") -> bool:
        return self.name < other.name


def source_name(source: BeliefSource | str | int) -> str:
    return (source if isinstance(source, BeliefSource) else BeliefSource(source)).name


