"""Date and time expressions (session time zone UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import GRANULE_PATTERN, MISSION_EPOCH
from .cleaning import as_col


def granule_timestamp(name: Column | str) -> Column:
    """Acquisition time from a footprint file name; NULL when it does not parse."""
    n = as_col(name)

    def part(i: int) -> Column:
        return F.regexp_extract(n, GRANULE_PATTERN, i)

    ok = part(1) != ""
    g = [F.when(ok, part(i)).cast("int") for i in range(1, 6)]
    start = F.make_timestamp_ntz(g[0], F.lit(1), F.lit(1), g[2], g[3], g[4])
    return start + F.make_dt_interval(days=g[1] - 1)


def granule_orbit(name: Column | str) -> Column:
    """Orbit number from a footprint file name; -1 when it does not parse."""
    g = F.regexp_extract(as_col(name), GRANULE_PATTERN, 6)
    return F.when(g != "", g.cast("int")).otherwise(F.lit(-1))


def parse_iso(text: Column | str) -> Column:
    """ISO-8601 with a trailing Z (or an offset) as a UTC timestamp."""
    return F.to_timestamp(as_col(text))


def mission_time(delta_seconds: Column | str) -> Column:
    """Seconds since the mission epoch as a zone-less timestamp."""
    return F.lit(MISSION_EPOCH).cast("timestamp_ntz") + F.make_dt_interval(secs=as_col(delta_seconds))


def growing_season(ts: Column | str) -> Column:
    return F.month(as_col(ts)).between(4, 9)


def month_end(ts: Column | str) -> Column:
    return F.last_day(as_col(ts))


def within_dates(ts: Column | str, first: str, last: str) -> Column:
    """Both ends are inclusive dates."""
    return F.to_date(as_col(ts)).between(F.lit(first).cast("date"), F.lit(last).cast("date"))
