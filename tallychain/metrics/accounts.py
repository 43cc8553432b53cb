"""Active, new and total accounts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallychain.constants import (
    BOTH_LABEL,
    EVM_LABEL,
    NATIVE_LABEL,
    WEEK_TABLE_ROWS,
    WEEK_TABLE_WEEKS,
)
from tallychain.functions.scalars import first_element
from tallychain.operators.accounts import explode_actors, senders
from tallychain.operators.aggregates import count_distinct, week_pivot, with_total
from tallychain.operators.filters import between, in_complete_buckets
from tallychain.operators.joins import full_outer_fill
from tallychain.operators.sketches import approx_distinct
from tallychain.operators.weeks import week_calendar, weekly_debuts
from tallychain.operators.windows import cumulative, pct_change, prev, rolling_mean
from tallychain.period import Period, monday_of
from tallychain.sources.tables import Sources

TS = "block_timestamp"


def active_accounts_total(src: Sources, period: Period, approximate: bool = False) -> DataFrame:
    """Distinct *first* actors of native transactions in ``[start, as_of)``.

    Only the native chain counts here, and only transactions that have an actor.  ``approximate``
    counts from daily sketches (see ``operators/sketches.py``).
    """
    if approximate:
        daily = src.daily_sketches("native_first_actor", period.start, period.as_of)
        return approx_distinct(daily, "total_active_addresses")
    rows = between(src.native_actors(), TS, period.start, period.as_of)
    return count_distinct(rows, first_element("actors"), "total_active_addresses")


def active_accounts_evm(src: Sources, period: Period, approximate: bool = False) -> DataFrame:
    """Distinct EVM senders in ``[start, as_of)``; ``approximate`` as above."""
    if approximate:
        daily = src.daily_sketches("evm_active", period.start, period.as_of)
        return approx_distinct(daily, "total_active_addresses")
    rows = between(src.evm_tx(), TS, period.start, period.as_of)
    return count_distinct(rows, "from_address", "total_active_addresses")


def _active_by_type(src: Sources, period: Period, upper: date) -> DataFrame:
    """Distinct active addresses per bucket and chain, from the period start to ``upper``."""

    def per_bucket(name: str, label: str) -> DataFrame:
        counts = src.bucket_counts(name, period, period.start, upper)
        return counts.select(
            F.col("bucket").alias("day"), F.lit(label).alias("type"), F.col("n").alias("active_users")
        )

    native = per_bucket("native_active", NATIVE_LABEL)
    return native.unionByName(per_bucket("evm_active", EVM_LABEL))


def active_accounts_series(src: Sources, period: Period) -> DataFrame:
    """Active addresses per bucket: each chain, and the sum of both with a rolling mean.

    The sum also shows an incomplete bucket, the chains do not; at every grain, buckets
    that start in the current week are left out.  The rolling mean only looks back, so
    leaving those buckets out at the scan changes no value.
    """
    base = _active_by_type(src, period, upper=period.ceiling(period.this_week))
    is_both = F.col("type") == BOTH_LABEL
    rows = with_total(base, "day", "type", "active_users").where(
        is_both | (F.col("day") < F.lit(period.cutoff))
    )
    rolling = F.when(is_both, rolling_mean("active_users", "day", by=("type",)))
    return rows.select("day", "type", "active_users", rolling.alias("rolling_avg")).orderBy(
        F.desc("day"), "type"
    )


def accounts_created_total(src: Sources, period: Period) -> DataFrame:
    """Addresses seen in the complete buckets of the period; one on both chains counts once."""
    both = src.dated_keys("account", period.start, period.cutoff)
    return count_distinct(both, "address", "total_new_accounts")


def accounts_created_series(src: Sources, period: Period) -> DataFrame:
    """Addresses per bucket that are seen there for the first time *in the period*."""
    new = src.debuts("account", period).select(
        F.col("bucket").alias("day"), F.col("n").alias("daily_new_accounts")
    )
    return new.select(
        "day",
        "daily_new_accounts",
        cumulative("daily_new_accounts", "day").alias("total_new_accounts"),
        rolling_mean("daily_new_accounts", "day").alias("rolling_avg_new_accounts"),
    ).orderBy(F.desc("day"))


def nat_total_accounts(src: Sources, period: Period) -> DataFrame:
    """All addresses since the epoch, up to and including midnight of ``as_of``.

    The chains are counted apart and added, so an address on both counts twice.
    """

    def until_today(df: DataFrame) -> DataFrame:
        return between(df, TS, period.epoch_start, period.as_of, include_upper=True)

    native = explode_actors(until_today(src.native_actors()))
    evm = senders(until_today(src.evm_tx()))
    counts = count_distinct(native, "address", "n").unionByName(count_distinct(evm, "address", "n"))
    return counts.agg(F.sum("n").alias("total_accounts"))


def nat_series(src: Sources, period: Period) -> DataFrame:
    """New and active accounts side by side, for the buckets that have new accounts.

    New accounts exist only before the cutoff, so active accounts are read up to there.
    Both counts come from one set of distinct (chain, bucket, address) rows: all of them
    are active, and the first one of each address is new.  An address has at most one
    row per chain and bucket there, so numbering them sorts no long group.
    """

    def seen(df: DataFrame, on_native: bool) -> DataFrame:
        chain = F.lit(on_native).alias("on_native")
        return df.select(chain, period.bucket(TS).alias("date"), "address")

    native = explode_actors(in_complete_buckets(src.native_actors(), TS, period))
    evm = senders(in_complete_buckets(src.evm_tx(), TS, period))
    addresses = seen(native, True).unionByName(seen(evm, False)).distinct()
    position = F.row_number().over(Window.partitionBy("address").orderBy("date"))
    is_first = F.col("position") == 1
    per_bucket = (
        addresses.withColumn("position", position)
        .groupBy("date")
        .agg(
            F.count("address").alias("active_users"),
            F.count(F.when(is_first, F.col("address"))).alias("new_accounts"),
            F.bool_or(is_first).alias("has_new"),
        )
        .withColumn("rolling_avg_active_users", rolling_mean("active_users", "date"))
    )
    return per_bucket.where("has_new").select(
        "date",
        "active_users",
        "rolling_avg_active_users",
        "new_accounts",
        rolling_mean("new_accounts", "date").alias("rolling_avg_new_accounts"),
        cumulative("new_accounts", "date").alias("total_new_accounts"),
    ).orderBy(F.desc("date"))


def new_accounts_by_week(src: Sources, as_of: date, weeks: int = WEEK_TABLE_WEEKS) -> DataFrame:
    """Calendar weeks with the addresses whose first transaction ever falls in them."""
    monday = monday_of(as_of)
    native = weekly_debuts(
        src.first_seen("native_address", monday), "address", as_of, weeks, "cadence_accounts"
    )
    evm = weekly_debuts(
        src.first_seen("evm_address", monday), "address", as_of, weeks, "evm_accounts"
    )
    counts = full_outer_fill(native, evm, "start_date")
    filled = (
        week_calendar(src.spark, as_of, weeks)
        .join(counts, "start_date", "left")
        .fillna(0, subset=["cadence_accounts", "evm_accounts"])
    )
    return filled.withColumn("total_accounts", F.col("cadence_accounts") + F.col("evm_accounts"))


def new_accounts_week_table(src: Sources, period: Period) -> DataFrame:
    """New addresses of the last 12 full weeks, as six text rows of one column per week."""
    weekly = new_accounts_by_week(src, period.as_of)
    oldest_first = F.desc("weeks_ago")

    def change(name: str) -> Column:
        pct = pct_change(F.col(name), prev(name, oldest_first))
        return F.round(pct, 2).cast("decimal(18,2)")

    with_change = weekly.select(
        "weeks_ago",
        "cadence_accounts",
        change("cadence_accounts").alias("cadence_pct"),
        "evm_accounts",
        change("evm_accounts").alias("evm_pct"),
        "total_accounts",
        change("total_accounts").alias("total_pct"),
    )
    return week_pivot(with_change, WEEK_TABLE_ROWS)
