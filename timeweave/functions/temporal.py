"""Durations, ISO 8601 text and microsecond arithmetic."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
#: Microseconds of each duration unit; a month is 30 days and a year 365.
UNITS = {"us": 1, "l": 1_000, "ms": 1_000, "s": SECOND, "m": 60 * SECOND, "h": 3600 * SECOND, "d": 86400 * SECOND}
_ISO = re.compile(r"P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$")


def parse_duration(text: str) -> int:
    """Microseconds of ``1d2h30m10s`` or of ISO 8601 ``PnYnMnDTnHnMnS``; raises ValueError on anything else."""
    text = text.strip()
    sign = -1 if text.startswith("-") else 1
    body = text.lstrip("+-")
    if body.startswith("P"):
        found = _ISO.match(body)
        if not found or body in ("P", "PT"):
            raise ValueError(f"not a duration: {text!r}")
        y, mo, w, d, h, mi, s = (float(x or 0) for x in found.groups())
        return sign * int(round(((y * 365 + mo * 30 + w * 7 + d) * 86400 + h * 3600 + mi * 60 + s) * SECOND))
    parts = re.findall(r"(\d+(?:\.\d+)?)(us|ms|[lsmhd])", body)
    if not parts or "".join(n + u for n, u in parts) != body:
        raise ValueError(f"not a duration: {text!r}")
    return sign * int(round(sum(float(n) * UNITS[u] for n, u in parts)))


def parse_timestamp(text: str) -> dt.datetime:
    """A date, or a date and time, with an optional fraction and zone; UTC without one."""
    found = dt.datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    return found.astimezone(dt.UTC).replace(tzinfo=None) if found.tzinfo else found


def micros_of(value: int | str | dt.datetime) -> int:
    """Microseconds since 1970 of an integer, ISO text or naive UTC datetime."""
    if isinstance(value, int):
        return value
    when = parse_timestamp(value) if isinstance(value, str) else value
    return (when - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def format_iso8601(ts: Column) -> Column:
    """UTC text with Z; six digits of fraction unless it is zero."""
    ts = ts.cast("timestamp")
    plain, fine = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.when(F.unix_micros(ts) % SECOND == 0, plain).otherwise(fine), F.lit("Z"))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone, read as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def at(value: int | str | dt.datetime) -> Column:
    """A literal TIMESTAMP_NTZ."""
    return from_micros(F.lit(micros_of(value)))
