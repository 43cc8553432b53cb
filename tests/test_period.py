from datetime import date, datetime, timedelta

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tallychain.period import PERIOD_KEYS, Period, months_back


def test_bounds_on_a_wednesday():
    day = date(2001, 8, 1)
    bounds = {k: (Period(k, day).start, Period(k, day).grain, Period(k, day).cutoff) for k in PERIOD_KEYS}
    assert bounds == {
        "all_time": (date(2020, 1, 1), "month", date(2001, 8, 1)),
        "last_year": (date(2000, 8, 1), "week", date(2001, 7, 30)),
        "last_3_months": (date(2001, 5, 1), "week", date(2001, 7, 30)),
        "last_month": (date(2001, 7, 1), "day", day),
        "last_week": (date(2001, 7, 25), "day", day),
        "last_24h": (date(2001, 7, 31), "hour", day),
    }


def test_month_ends_clamp():
    assert Period("last_month", date(2023, 3, 31)).start == date(2023, 2, 28)
    assert Period("last_month", date(2024, 3, 31)).start == date(2024, 2, 29)
    assert Period("last_year", date(2024, 2, 29)).start == date(2023, 2, 28)
    assert months_back(date(2024, 1, 15), 1) == date(2023, 12, 15)
    assert months_back(date(2023, 12, 1), -1) == date(2024, 1, 1)


def test_unknown_key():
    with pytest.raises(ValueError, match="unknown period"):
        Period("yesterday", date(2024, 1, 1))


def _bucket(grain: str, ts: datetime) -> datetime:
    day = datetime(ts.year, ts.month, ts.day)
    if grain == "month":
        return day.replace(day=1)
    if grain == "week":
        return day - timedelta(days=day.weekday())
    return ts.replace(minute=0, second=0, microsecond=0) if grain == "hour" else day


@given(
    st.sampled_from(PERIOD_KEYS),
    st.datetimes(datetime(1999, 1, 1), datetime(2005, 1, 1)),
    st.dates(date(1999, 6, 1), date(2004, 6, 1)),
)
def test_bounds_on_times_agree_with_bounds_on_buckets(key, ts, as_of):
    period = Period(key, as_of)
    midnight = datetime(as_of.year, as_of.month, as_of.day)
    bucket = _bucket(period.grain, ts)
    ceiling, cutoff = period.ceiling(as_of), period.cutoff
    assert (bucket < midnight) == (ts < datetime(ceiling.year, ceiling.month, ceiling.day))
    start = datetime(cutoff.year, cutoff.month, cutoff.day)
    assert (bucket < start) == (ts < start)
    assert start == _bucket(period.grain, midnight)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kathmandu"])
def test_bucket_is_the_same_in_every_session_zone(spark, settings, zone):
    settings("spark.sql.session.timeZone", zone)
    # The hour that a clock change skips, the turn of a year, and plain times.
    times = [
        datetime(2024, 3, 10, 2, 30),
        datetime(2024, 11, 3, 1, 59, 59),
        datetime(2023, 12, 31, 23, 59, 59, 999999),
        datetime(2024, 1, 1),
        datetime(1969, 7, 20, 20, 17),
    ]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    for key in PERIOD_KEYS:
        period = Period(key, date(2024, 1, 1))
        got = [r.b for r in df.select(period.bucket("ts").alias("b")).collect()]
        assert got == [_bucket(period.grain, t) for t in times]
