"""Row filters."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallychain.constants import COA_PREFIX, DEPLOY_TOPIC
from tallychain.period import Period

PARTITION_DATE = "block_date"
#: Days that a row's own time may lie from the day folder it is in (that of its transaction's
#: block); landing a table checks it.
SLACK = timedelta(days=1)


def between(
    df: DataFrame,
    ts: str,
    lower: date | None = None,
    upper: date | None = None,
    include_upper: bool = False,
) -> DataFrame:
    """Rows with ``lower <= ts < upper`` (or ``<= upper`` midnight).

    The second predicate prunes the day folders of a table that is split by day.  A row lies
    in the folder of its transaction's day, at most `SLACK` from its own, so the folders are
    bounded more widely than the times.
    """
    tests = _bounds(ts, lower, upper, include_upper)
    if PARTITION_DATE in df.columns:
        first, last = lower and lower - SLACK, upper and upper + SLACK
        tests += _bounds(PARTITION_DATE, first, last, include_upper)
    return _where_all(df, tests)


def same_days(
    df: DataFrame, lower: date | None = None, upper: date | None = None, include_upper: bool = False
) -> DataFrame:
    """Skip the day folders outside the bounds, if the table is split by day.

    For a table that is reached by a join over the transaction, where the other side has the
    bounds.  All rows of a transaction lie in the folder of its block's day, at most `SLACK`
    from the time of the row that the bounds are about; so no partner is skipped.  A table
    that is not split by day is left whole.
    """
    if PARTITION_DATE not in df.columns:
        return df
    first, last = lower and lower - SLACK, upper and upper + SLACK
    return _where_all(df, _bounds(PARTITION_DATE, first, last, include_upper))


def _bounds(
    column: str, lower: date | None, upper: date | None, include_upper: bool
) -> list[Column]:
    value = F.col(column)
    tests = []
    if lower is not None:
        tests.append(value >= F.lit(lower))
    if upper is not None:
        tests.append(value <= F.lit(upper) if include_upper else value < F.lit(upper))
    return tests


def _where_all(df: DataFrame, tests: list[Column]) -> DataFrame:
    return df.where(reduce(Column.__and__, tests)) if tests else df


def in_period(df: DataFrame, ts: str, period: Period) -> DataFrame:
    """Rows from the start of the period on, with no upper bound."""
    return between(df, ts, lower=period.start)


def in_complete_buckets(df: DataFrame, ts: str, period: Period) -> DataFrame:
    """Rows of the period that fall in complete buckets.

    ``bucket(ts) < cutoff`` and ``ts < cutoff`` agree because the cutoff is a bucket
    start; the second form is pushed to the scan.
    """
    return between(df, ts, lower=period.start, upper=period.cutoff)


def completed(df: DataFrame, bucket: str, period: Period) -> DataFrame:
    """Bucket rows before the cutoff, for frames that are bucketed already."""
    return df.where(F.col(bucket) < F.lit(period.cutoff))


def has_topic(topics: str | Column, topic: str = DEPLOY_TOPIC) -> Column:
    """Case-insensitive substring test on the first topic; NULL if there is none."""
    return F.contains(F.lower(F.get(topics, 0)), F.lit(topic.lower()))


def is_coa(address: str | Column, prefix: str = COA_PREFIX) -> Column:
    """Prefix test; NULL for a NULL address, so neither it nor its negation holds."""
    address = F.col(address) if isinstance(address, str) else address
    return address.startswith(prefix)
