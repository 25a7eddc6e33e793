"""Calendar periods at a fixed offset from UTC. ``now`` is always a parameter."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalsieve.functions.fixed_values import DEFAULT_TZ_OFFSET_HOURS


def utc_literal(moment: datetime) -> Column:
    """A timestamp literal that does not depend on the driver's own time zone."""
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return F.timestamp_micros(F.lit(int(round(moment.timestamp() * 1_000_000))))


def shift_hours(ts: Column, hours: int) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(hours))


def local_day(ts: Column, tz_offset_hours: int = DEFAULT_TZ_OFFSET_HOURS) -> Column:
    """Calendar day of a UTC timestamp at the offset (session time zone must be UTC)."""
    return shift_hours(ts, tz_offset_hours).cast("date")


def local_week(ts: Column, tz_offset_hours: int = DEFAULT_TZ_OFFSET_HOURS) -> Column:
    """Monday of the local week."""
    return F.date_trunc("week", shift_hours(ts, tz_offset_hours)).cast("date")


def local_today(now: datetime, tz_offset_hours: int = DEFAULT_TZ_OFFSET_HOURS) -> date:
    return (now + timedelta(hours=tz_offset_hours)).date()


def day_bounds(day: date, tz_offset_hours: int = DEFAULT_TZ_OFFSET_HOURS) -> tuple[datetime, datetime]:
    """Half-open UTC range ``[start, end)`` of a local day."""
    start = datetime(day.year, day.month, day.day) - timedelta(hours=tz_offset_hours)
    return start, start + timedelta(days=1)


def week_bounds(day: date, tz_offset_hours: int = DEFAULT_TZ_OFFSET_HOURS) -> tuple[datetime, datetime]:
    """Half-open UTC range of the local Monday-to-Sunday week that holds ``day``."""
    start, _ = day_bounds(day - timedelta(days=day.weekday()), tz_offset_hours)
    return start, start + timedelta(days=7)


def in_range(ts: Column, bounds: tuple[datetime, datetime]) -> Column:
    """Half-open membership on the raw column, so that it reaches the Parquet scan."""
    return (ts >= utc_literal(bounds[0])) & (ts < utc_literal(bounds[1]))
