"""The reporting period: which rows count, and how they are bucketed in time.

Every bound is a plain ``date``.  A date literal compared with a timestamp
column is folded to a literal of the column's own type, so the bounds of a
period reach the Parquet scan as pushed filters.
"""

from __future__ import annotations

import calendar
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallychain.constants import EPOCH_START

# period key -> bucket grain
_GRAINS = {
    "all_time": "month",
    "last_year": "week",
    "last_3_months": "week",
    "last_month": "day",
    "last_week": "day",
    "last_24h": "hour",
}

PERIOD_KEYS = tuple(_GRAINS)


def months_back(day: date, months: int) -> date:
    """``day`` moved back by whole months, clamped to the end of a shorter month."""
    index = day.year * 12 + day.month - 1 - months
    year, month = divmod(index, 12)
    last = calendar.monthrange(year, month + 1)[1]
    return date(year, month + 1, min(day.day, last))


def monday_of(day: date) -> date:
    return day - timedelta(days=day.weekday())


def grain_floor(grain: str, day: date) -> date:
    """Start of the bucket that holds midnight of ``day``."""
    if grain == "month":
        return day.replace(day=1)
    if grain == "week":
        return monday_of(day)
    return day


def grain_ceiling(grain: str, day: date) -> date:
    """Smallest bucket start that is not before ``day``."""
    start = grain_floor(grain, day)
    if start == day:
        return day
    return months_back(start, -1) if grain == "month" else start + timedelta(days=7)


def grain_bucket(grain: str, ts: str | Column) -> Column:
    """Bucket start of a timestamp, without a time zone.

    Whole days are counted from the local date, so no row pays for a time zone
    conversion and no bucket depends on the session's zone.
    """
    local = (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz")
    day = F.to_date(local)
    if grain == "hour":
        return day.cast("timestamp_ntz") + F.expr("INTERVAL '1' HOUR") * F.hour(local)
    start = day if grain == "day" else F.trunc(day, grain)
    return start.cast("timestamp_ntz")


@dataclass(frozen=True)
class Period:
    """A period key seen from the day ``as_of`` (that day itself is not over yet)."""

    key: str
    as_of: date
    epoch_start: date = EPOCH_START

    def __post_init__(self) -> None:
        if self.key not in _GRAINS:
            raise ValueError(f"unknown period {self.key!r}; expected one of {PERIOD_KEYS}")

    @property
    def grain(self) -> str:
        return _GRAINS[self.key]

    @property
    def start(self) -> date:
        """First day that counts (inclusive)."""
        match self.key:
            case "all_time":
                return self.epoch_start
            case "last_year":
                return months_back(self.as_of, 12)
            case "last_3_months":
                return months_back(self.as_of, 3)
            case "last_month":
                return months_back(self.as_of, 1)
            case "last_week":
                return self.as_of - timedelta(days=7)
            case _:
                return self.as_of - timedelta(days=1)

    @property
    def cutoff(self) -> date:
        """Start of the first bucket that is not complete (exclusive bound of a series)."""
        return self.floor(self.as_of)

    @property
    def this_week(self) -> date:
        """Monday of the current week."""
        return monday_of(self.as_of)

    def floor(self, day: date) -> date:
        """Start of the bucket that holds midnight of ``day``."""
        return grain_floor(self.grain, day)

    def ceiling(self, day: date) -> date:
        """Smallest bucket start that is not before ``day``.

        ``bucket(ts) < day`` is the same as ``ts < ceiling(day)``; only the second
        form can be pushed to the scan.
        """
        return grain_ceiling(self.grain, day)

    def bucket(self, ts: str | Column) -> Column:
        """Bucket start of a timestamp, without a time zone."""
        return grain_bucket(self.grain, ts)
