"""Accounts that deploy contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallychain.constants import CONTRACT_ADDED_EVENT
from tallychain.functions.scalars import first_element
from tallychain.operators.aggregates import count_distinct
from tallychain.operators.deploys import deploy_transactions
from tallychain.operators.filters import in_complete_buckets, in_period, same_days
from tallychain.operators.joins import full_outer_fill
from tallychain.operators.windows import cumulative, rolling_mean
from tallychain.period import Period
from tallychain.sources.tables import Sources

TS = "block_timestamp"


def _contract_added(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type") == CONTRACT_ADDED_EVENT)


def _deployers(transactions: DataFrame) -> DataFrame:
    return transactions.select("tx_id", first_element("authorizers").alias("deployer"))


def deployers_native_kpi(src: Sources, period: Period) -> DataFrame:
    """Distinct first authorizers of native deployments since the period start.

    Only the existence of an event matters, so the events shrink to distinct
    transactions, already partitioned the way the semi join needs them.
    """
    events = in_period(src.native_events(), TS, period)
    added = _contract_added(events).select("tx_id").distinct()
    transactions = same_days(src.native_tx(), lower=period.start)
    deployers = _deployers(transactions).join(added, "tx_id", "left_semi")
    return count_distinct(deployers, "deployer", "total_cadence_deployers")


def deployers_series(src: Sources, period: Period) -> DataFrame:
    """Distinct deployers per complete bucket and chain, with running totals.

    A deployer counts in every bucket it deploys in.
    """
    # One row per transaction, with its buckets (no more than the period has): the aggregate
    # and the join share one shuffle by transaction.
    added = (
        _contract_added(in_complete_buckets(src.native_events(), TS, period))
        .groupBy("tx_id")
        .agg(F.collect_set(period.bucket(TS)).alias("days"))
    )
    transactions = same_days(src.native_tx(), period.start, period.cutoff)
    native = (
        added.join(_deployers(transactions), "tx_id")
        .select(F.explode("days").alias("day"), "deployer")
        .groupBy("day")
        .agg(F.countDistinct("deployer").alias("new_cadence_deployers"))
    )
    evm = (
        deploy_transactions(src, period.start, period.cutoff)
        .where(F.col("tx_hash").isNotNull())
        .groupBy(period.bucket(TS).alias("day"))
        .agg(F.countDistinct("creator").alias("new_evm_deployers"))
    )
    joined = full_outer_fill(native, evm, "day").withColumn(
        "full_deployers", F.col("new_cadence_deployers") + F.col("new_evm_deployers")
    )
    return joined.select(
        "day",
        "new_cadence_deployers",
        cumulative("new_cadence_deployers", "day").alias("total_cadence_deployers"),
        "new_evm_deployers",
        cumulative("new_evm_deployers", "day").alias("total_evm_deployers"),
        "full_deployers",
        cumulative("full_deployers", "day").alias("total_full_deployers"),
        rolling_mean("full_deployers", "day").alias("rolling_avg_full_deployers"),
    ).orderBy(F.desc("day"))
