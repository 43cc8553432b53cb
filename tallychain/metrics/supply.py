"""Token supply split into staked, locked and circulating parts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallychain.constants import (
    COMMIT_ACTIONS,
    LIQUID_SUPPLY,
    STAKED_BASE,
    TOKEN_SYMBOL,
    WITHDRAW_ACTIONS,
)
from tallychain.functions.scalars import floor_at_zero, trunc_date
from tallychain.operators.windows import cumulative
from tallychain.period import Period
from tallychain.sources.payloads import daily_points, highest_locked
from tallychain.sources.tables import Sources


def staked_by_day(src: Sources, staked_base: float = STAKED_BASE) -> DataFrame:
    """``date, net_staked_volume, total_staked_volume`` for days that have a commit.

    A day with withdrawals only is left out, and so is its effect on the running total.
    Both kinds of action are summed in one pass.
    """
    amount, action = F.col("amount"), F.col("action")
    commits, withdraws = action.isin(*COMMIT_ACTIONS), action.isin(*WITHDRAW_ACTIONS)
    zero = F.lit(0).cast("decimal(38,8)")
    daily = (
        src.staking_actions()
        .where(commits | withdraws)
        .groupBy(trunc_date("block_timestamp", "day").alias("date"))
        .agg(
            F.coalesce(F.sum(F.when(commits, amount)), zero).alias("committed"),
            F.coalesce(F.sum(F.when(withdraws, amount)), zero).alias("withdrawn"),
            F.bool_or(commits).alias("has_commit"),
        )
        .where("has_commit")
        .select("date", (F.col("committed") - F.col("withdrawn")).alias("net_staked_volume"))
    )
    total = cumulative("net_staked_volume", "date").cast("double") + F.lit(staked_base)
    return daily.withColumn("total_staked_volume", total)


def supply_series(
    src: Sources,
    period: Period,
    staked_base: float = STAKED_BASE,
    liquid_supply: float = LIQUID_SUPPLY,
    token: str = TOKEN_SYMBOL,
    tvl_in_tokens: bool = False,
) -> DataFrame:
    """Supply parts per day before ``as_of``; the period key plays no role.

    ``non_staked_locked`` is the locked value as reported, a currency amount; with
    ``tvl_in_tokens`` it is divided by the day's price first.  If any part of a day is
    missing, its remainder and free circulation are NULL.
    """
    market = daily_points(src.market_series()).where(F.col("date") < F.lit(period.as_of))
    locked = F.col("protocol_locked")
    if tvl_in_tokens:
        locked = locked / F.nullif(F.col("price"), F.lit(0.0))
    days = (
        market.join(highest_locked(src.tvl_values()), "date", "left")
        .join(staked_by_day(src, staked_base), "date", "left")
        .select(
            "date",
            F.lit(token).alias("token"),
            F.col("total_supply").alias("total_supply_actual"),
            F.col("total_staked_volume").alias("staked_locked"),
            locked.alias("non_staked_locked"),
            F.lit(float(liquid_supply)).alias("liquid_supply"),
        )
    )
    total = F.col("total_supply_actual")
    bound = F.col("staked_locked") + F.col("non_staked_locked") + F.col("liquid_supply")
    unstaked = floor_at_zero(total - bound)
    return days.select(
        "date",
        "token",
        "total_supply_actual",
        "staked_locked",
        "non_staked_locked",
        unstaked.alias("unstaked_circulating"),
        "liquid_supply",
        (total - unstaked).alias("free_circulating_supply"),
    ).orderBy(F.desc("date"))


def latest_before(df: DataFrame, key: str, day: date) -> DataFrame:
    """The newest row before ``day``."""
    return df.where(F.col(key) < F.lit(day)).orderBy(F.desc(key)).limit(1)


def supply_latest(
    src: Sources, period: Period, staked_base: float = STAKED_BASE, **options
) -> DataFrame:
    """The newest row of the supply series before the current week."""
    series = supply_series(src, period, staked_base, **options)
    return latest_before(series, "date", period.this_week)
