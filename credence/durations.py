"""Strict parsing of durations and moments."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

UNITS = {
    "w": timedelta(weeks=1), "d": timedelta(days=1), "day": timedelta(days=1), "days": timedelta(days=1),
    "h": timedelta(hours=1), "hour": timedelta(hours=1), "hours": timedelta(hours=1),
    "min": timedelta(minutes=1), "t": timedelta(minutes=1), "minute": timedelta(minutes=1), "minutes": timedelta(minutes=1),
    "s": timedelta(seconds=1), "sec": timedelta(seconds=1), "second": timedelta(seconds=1), "seconds": timedelta(seconds=1),
    "ms": timedelta(milliseconds=1), "us": timedelta(microseconds=1),
}
ISO = re.compile(r"(-?)P(?:(\d+(?:\.\d+)?)W)?(?:(\d+(?:\.\d+)?)D)?(?:T(?:(\d+(?:\.\d+)?)H)?(?:(\d+(?:\.\d+)?)M)?(?:(\d+(?:\.\d+)?)S)?)?")
PLAIN = re.compile(r"(-?\d+(?:\.\d+)?)?\s*([A-Za-z]+)")


def duration(value: timedelta | str, name: str = "duration") -> timedelta:
    """A duration from a timedelta, an ISO 8601 text or one like "15min" or "H"; months and years are ambiguous."""
    if isinstance(value, timedelta):
        return timedelta(days=value.days, seconds=value.seconds, microseconds=value.microseconds)
    if not isinstance(value, str):
        raise ValueError(f"could not parse {name} {value!r}")
    found = ISO.fullmatch(value)
    if found and any(found.groups()[1:]):
        weeks, days, hours, minutes, seconds = (float(x or 0) for x in found.groups()[1:])
        out = timedelta(weeks=weeks, days=days, hours=hours, minutes=minutes, seconds=seconds)
        return -out if found[1] else out
    total, at, text = timedelta(0), 0, value.strip()
    while at < len(text):
        found = PLAIN.match(text, at)
        unit = found and UNITS.get(found[2] if found[2] in ("ms", "us") else found[2].lower() if found[2] not in ("M", "Y", "y") else "")
        if not unit:
            raise ValueError(f"could not parse {name} {value!r}: months, years and unknown units are not durations")
        total += float(found[1] or 1) * unit
        at = found.end()
        while at < len(text) and text[at] in " ,":
            at += 1
    if not text:
        raise ValueError(f"could not parse {name} {value!r}")
    return total


def moment(value: datetime | str, name: str = "datetime") -> datetime:
    """A moment with a time zone; without one it is rejected."""
    if isinstance(value, str):
        try:
            value = datetime.fromisoformat(value)
        except ValueError as e:
            raise ValueError(f"could not parse {name} {value!r}") from e
    if getattr(value, "tzinfo", None) is None:
        raise TypeError(f"{name} {value} has no time zone; localize it first")
    return value


def iso(value: timedelta) -> str:
    """A duration as ISO 8601 text."""
    sign, value = ("-", -value) if value < timedelta(0) else ("", value)
    hours, rest = divmod(value.seconds, 3600)
    minutes, seconds = divmod(rest, 60)
    tail = f"{seconds}.{value.microseconds:06d}".rstrip("0") if value.microseconds else str(seconds) if seconds else ""
    time = f"{hours}H" * bool(hours) + f"{minutes}M" * bool(minutes) + (f"{tail}S" if tail else "")
    day = f"{value.days}D" * bool(value.days)
    return f"{sign}P{day}{'T' + time if time else ''}" if day or time else "PT0S"


def seconds(value: timedelta) -> float:
    return value.total_seconds()


def micros(value: timedelta) -> int:
    """Whole microseconds of a duration."""
    return (value.days * 86_400 + value.seconds) * 1_000_000 + value.microseconds
