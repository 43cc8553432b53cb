"""Grouped operators.

All of them aggregate before they shuffle.  An exact distinct count is planned on
(group, value): each task drops its repeats first and the shuffle spreads a busy
bucket over all tasks by value, so neither a hot bucket nor a hot value piles up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallychain.constants import BOTH_LABEL, WEEK_TABLE_WEEKS
from tallychain.period import Period


def count_distinct(df: DataFrame, column: str | Column, alias: str) -> DataFrame:
    """One row: the exact number of distinct non-null values."""
    return df.agg(F.countDistinct(column).alias(alias))


def distinct_per_bucket(
    df: DataFrame,
    ts: str,
    column: str | Column,
    period: Period,
    alias: str,
    bucket: str = "time_stamp",
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Exact distinct count per time bucket (and per ``by`` column)."""
    return df.groupBy(period.bucket(ts).alias(bucket), *by).agg(F.countDistinct(column).alias(alias))


def first_seen(
    df: DataFrame, key: str | tuple[str, ...], ts: str, alias: str = "first_seen"
) -> DataFrame:
    """Earliest timestamp per key; a NULL key is a group of its own."""
    keys = (key,) if isinstance(key, str) else key
    return df.groupBy(*keys).agg(F.min(ts).alias(alias))


def first_bucket(df: DataFrame, key: str, ts: str, period: Period, alias: str) -> DataFrame:
    """First bucket per key.

    The bucket of the minimum is the minimum bucket, so a partial ``min`` replaces a
    sort of every key's rows.
    """
    return first_seen(df, key, ts).select(key, period.bucket("first_seen").alias(alias))


def debuts_per_bucket(
    df: DataFrame, key: str, ts: str, period: Period, alias: str, bucket: str = "day"
) -> DataFrame:
    """Number of keys whose first row falls in the bucket."""
    return (
        first_bucket(df, key, ts, period, bucket).groupBy(bucket).agg(F.count(key).alias(alias))
    )


def with_total(
    df: DataFrame, by: str, kind: str, measure: str, label: str = BOTH_LABEL
) -> DataFrame:
    """The rows of ``df`` plus, per ``by``, their sum under the type ``label``.

    One grouping-sets aggregate over the (small) per-type rows; nothing is read twice.
    """
    return df.groupingSets([[F.col(by), F.col(kind)], [F.col(by)]], by, kind).agg(
        F.sum(measure).alias(measure), F.grouping(kind).alias("_is_total")
    ).select(
        by, F.when(F.col("_is_total") == 1, F.lit(label)).otherwise(F.col(kind)).alias(kind), measure
    )


def max_per_date(df: DataFrame, key: str, *measures: str) -> DataFrame:
    return df.groupBy(key).agg(*[F.max(m).alias(m) for m in measures])


def week_pivot(
    df: DataFrame,
    measures: dict[str, str],
    weeks: int = WEEK_TABLE_WEEKS,
    row_name: str = "new_addresses_created",
) -> DataFrame:
    """One text row per measure, one column per week (``last_full_week``, ``week_ago_1`` ...).

    ``measures`` maps a column of ``df`` to the label of its row; ``df`` has one row per
    ``weeks_ago``.  The columns are fixed, so no pass is needed to find them.
    """
    long = df.select(
        "weeks_ago",
        *[F.col(name).cast("string").alias(label) for name, label in measures.items()],
    ).unpivot(["weeks_ago"], list(measures.values()), row_name, "text")
    wide = long.groupBy(row_name).pivot("weeks_ago", list(range(weeks))).agg(F.max("text"))
    names = ["last_full_week", *[f"week_ago_{n}" for n in range(1, weeks)]]
    return wide.select(row_name, *[F.col(f"`{n}`").alias(names[n]) for n in range(weeks)])
