"""Time columns.

UNIX times may be bigint or double; days are counted from 1970-01-01. The text
functions render in the session time zone, so run them with it set to UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86_400


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def millis_to_seconds(millis: Column | str) -> Column:
    """Milliseconds to fractional seconds (double)."""
    return _col(millis) / F.lit(1000)


def day_start(seconds: Column | str) -> Column:
    """Start of the day of a UNIX time, in seconds, as bigint.

    The remainder truncates towards zero, so -1 gives 0 and not -86400.
    """
    s = _col(seconds)
    return (s - s % F.lit(SECONDS_PER_DAY)).cast("bigint")


def day_number(seconds: Column | str) -> Column:
    """Whole days since the epoch (floor), as int."""
    return F.floor(_col(seconds) / F.lit(SECONDS_PER_DAY)).cast("int")


def day_date(day: Column | str) -> Column:
    """Day number to a calendar date; independent of any time zone."""
    return F.date_from_unix_date(_col(day).cast("int"))


def datetime_text(seconds: Column | str) -> Column:
    """UNIX time to ``yyyy-MM-dd HH:mm:ss``; fractions are cut off."""
    return F.from_unixtime(_col(seconds).cast("bigint"))


def date_text(seconds: Column | str) -> Column:
    """UNIX time to ``yyyy-MM-dd``."""
    return F.from_unixtime(_col(seconds).cast("bigint"), "yyyy-MM-dd")


def month_text(date: Column | str) -> Column:
    """Date (or ISO date text) to ``yyyy-MM``."""
    return F.date_format(_col(date).cast("date"), "yyyy-MM")


def ntz_seconds(timestamp: Column | str) -> Column:
    """Zone-less timestamp to UNIX seconds read as UTC, whatever the session zone is."""
    t = _col(timestamp)
    return (
        F.unix_date(F.to_date(t)).cast("bigint") * SECONDS_PER_DAY
        + F.hour(t) * 3600
        + F.minute(t) * 60
        + F.second(t)
    )
