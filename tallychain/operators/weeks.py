"""The calendar of full weeks before a day."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallychain.constants import WEEK_TABLE_WEEKS
from tallychain.functions.scalars import date_range_label, monday, trunc_date
from tallychain.period import monday_of


def week_calendar(spark: SparkSession, as_of: date, weeks: int = WEEK_TABLE_WEEKS) -> DataFrame:
    """``weeks_ago, start_date, end_date, date_range``; week 0 is the last full week."""
    this_monday = monday(F.lit(as_of))
    back = F.col("weeks_ago")
    start = F.date_add(this_monday, (back + 1) * -7)
    end = F.date_add(this_monday, back * -7)
    return spark.range(weeks).select(F.col("id").cast("int").alias("weeks_ago")).select(
        "weeks_ago",
        start.alias("start_date"),
        end.alias("end_date"),
        date_range_label(start, F.date_add(end, -1)).alias("date_range"),
    )


def weekly_debuts(firsts: DataFrame, key: str, as_of: date, weeks: int, alias: str) -> DataFrame:
    """Keys per full week (``start_date``) by their ``first_seen`` time.

    Weeks are aligned and disjoint, so truncating the time replaces a range join.
    """
    this_monday = monday_of(as_of)
    seen = F.col("first_seen")
    return (
        firsts.where(
            (seen >= F.lit(this_monday - timedelta(days=7 * weeks))) & (seen < F.lit(this_monday))
        )
        .groupBy(trunc_date("first_seen", "week").alias("start_date"))
        .agg(F.count(key).alias(alias))
    )
