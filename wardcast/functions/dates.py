"""Day arithmetic of the forecast.

Day 0 is the day before ``as_of`` (the newest complete day) and day 1 is
``as_of`` itself. All day counts are counts of midnights crossed.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def midnights(earlier, later) -> Column:
    """Midnights crossed from ``earlier`` to ``later``; negative when reversed."""
    return F.datediff(later, earlier)


def forecast_day(as_of: date, when) -> Column:
    """Day number of a date or timestamp, 1 on ``as_of``."""
    return midnights(F.lit(as_of), when) + 1


def forecast_date(as_of: date, day_num) -> Column:
    """Calendar date of a day number."""
    return F.date_add(F.lit(as_of), day_num - 1)


def within(when: Column, start: date, stop: date) -> Column:
    """``start <= when < stop``."""
    return (when >= F.lit(start)) & (when < F.lit(stop))


def open_or_since(when: Column, start: date) -> Column:
    """Still open (NULL) or at ``start`` or later."""
    return when.isNull() | (when >= F.lit(start))


def utc_to_local(when, zone: str) -> Column:
    """Wall-clock time in ``zone`` of a UTC time, daylight saving included.

    A column without zone is taken to show UTC. A column of instants is counted from the
    epoch, so the session's own zone has no part in it.
    """
    seconds = (F.unix_micros(when.cast("timestamp")).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    instant = epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    shown = F.when(F.typeof(when) == "timestamp", instant).otherwise(when.cast("timestamp_ntz"))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), shown)
