"""Time in microseconds since 1970 UTC, fixed intervals, window ordinals and retry delays."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE, HOUR, DAY = 60 * SECOND, 3600 * SECOND, 86_400 * SECOND
_FIXED = re.compile(r"P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)(?:\.(\d{1,6}))?S)?)?")


def micros(iso: str, allow_zero: bool = False) -> int:
    """Microseconds of an ISO-8601 duration; months and years have no fixed length."""
    m = _FIXED.fullmatch(iso)
    if not m or iso == "P" or iso.endswith("T"):
        raise ValueError(f"not a fixed interval: {iso!r}")
    days, hours, minutes, seconds, fraction = m.groups()
    total = int(days or 0) * DAY + int(hours or 0) * HOUR + int(minutes or 0) * MINUTE + int(seconds or 0) * SECOND + int((fraction or "0").ljust(6, "0"))
    if total == 0 and not allow_zero:
        raise ValueError("the interval is empty")
    return total


def epoch_micros(ts: Column) -> Column:
    """Microseconds of a timestamp; one without a zone is read in the session's, so keep that at UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def ordinal(us: Column, width: int) -> Column:
    """The number of the tumbling window, aligned to the epoch; it floors below zero too."""
    size = F.lit(width).cast("bigint")
    return F.call_function("div", us - F.pmod(us, size), size)


def bound(number: Column, width: int) -> Column:
    """The start of a window, in microseconds."""
    return number * F.lit(width).cast("bigint")


def backoff(attempt: Column, initial: int, multiplier: float, most: int) -> Column:
    """Seconds to wait after so many attempts, rounded half up and bounded."""
    return F.least(F.lit(most), F.round(F.lit(initial) * F.pow(F.lit(multiplier), attempt - 1)).cast("int"))
