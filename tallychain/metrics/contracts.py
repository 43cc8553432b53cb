"""New contracts of both chains.

A native contract counts by the events it emits, an EVM contract by its deployment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallychain.constants import COA_PREFIX, EVM_LABEL, NATIVE_LABEL
from tallychain.operators.aggregates import (
    count_distinct,
    debuts_per_bucket,
    distinct_per_bucket,
)
from tallychain.operators.deploys import deploy_contracts, deploy_ids, deploy_transactions
from tallychain.operators.filters import in_complete_buckets, in_period, is_coa
from tallychain.operators.joins import combine_one_row, full_outer_fill
from tallychain.operators.windows import cumulative, rolling_mean
from tallychain.period import Period
from tallychain.sources.tables import Sources

TS = "block_timestamp"


def contracts_kpis(src: Sources, period: Period) -> DataFrame:
    """Emitting native contracts and deployed EVM contracts since the period start."""
    events = in_period(src.native_events(), TS, period)
    deploys = deploy_contracts(src, lower=period.start)
    return combine_one_row(
        count_distinct(events, "event_contract", "total_new_cadence_contracts"),
        count_distinct(deploys, "contract", "total_new_evm_contracts"),
    )


def contracts_series(src: Sources, period: Period) -> DataFrame:
    """Emitters and deployments per complete bucket, with running totals.

    An emitter counts in every bucket it emits in.
    """
    native = distinct_per_bucket(
        in_complete_buckets(src.native_events(), TS, period),
        TS, "event_contract", period, "new_cadence_contracts", "day",
    )
    evm = distinct_per_bucket(
        deploy_ids(src, period.start, period.cutoff),
        TS, "contract", period, "new_evm_contracts", "day",
    )
    joined = full_outer_fill(native, evm, "day").withColumn(
        "full_contracts", F.col("new_cadence_contracts") + F.col("new_evm_contracts")
    )
    return joined.select(
        "day",
        "new_cadence_contracts",
        cumulative("new_cadence_contracts", "day").alias("total_cadence_contracts"),
        "new_evm_contracts",
        cumulative("new_evm_contracts", "day").alias("total_evm_contracts"),
        "full_contracts",
        cumulative("full_contracts", "day").alias("total_full_contracts"),
        rolling_mean("full_contracts", "day").alias("rolling_avg_new_contracts"),
    ).orderBy(F.desc("day"))


def contracts_by_type(src: Sources, period: Period, coa_prefix: str = COA_PREFIX) -> DataFrame:
    """Native debuts within the period, and EVM deployments by kind of creator.

    A contract that both kinds created counts for both; one distinct pass over
    (bucket, kind, contract) serves the two counts.
    """
    native = debuts_per_bucket(
        in_complete_buckets(src.native_events(), TS, period),
        "event_contract", TS, period, "cadence_new",
    )
    coa = F.col("is_coa")
    evm = (
        deploy_contracts(src, period.start, period.cutoff)
        .select(
            period.bucket(TS).alias("day"),
            is_coa("creator", coa_prefix).alias("is_coa"),
            "contract",
        )
        .distinct()
        .groupBy("day")
        .agg(
            F.count(F.when(coa, F.col("contract"))).alias("evm_coa_new"),
            F.count(F.when(~coa, F.col("contract"))).alias("evm_eoa_new"),
        )
    )
    return full_outer_fill(native, evm, "day").orderBy(F.desc("day"))


def contracts_by_chain(src: Sources, period: Period) -> DataFrame:
    """Emitting contracts and deploying transactions per complete bucket."""
    native = distinct_per_bucket(
        in_complete_buckets(src.native_events(), TS, period),
        TS, "event_contract", period, "new_contracts", "day",
    )
    evm = distinct_per_bucket(
        deploy_transactions(src, period.start, period.cutoff),
        TS, "tx_hash", period, "new_contracts", "day",
    )
    columns = ["day", "type", "new_contracts"]
    return (
        native.withColumn("type", F.lit(NATIVE_LABEL)).select(columns)
        .unionByName(evm.withColumn("type", F.lit(EVM_LABEL)).select(columns))
        .orderBy(F.desc("day"))
    )


def weekly_contracts_by_type(
    src: Sources, period: Period, coa_prefix: str = COA_PREFIX
) -> DataFrame:
    """Contracts per week by their first appearance ever, for full weeks of the period.

    Native rows from the current week on cannot make an older debut, so they are not read.
    EVM rows are all read: any later row may show that the creator is native-owned.
    """
    debut = F.col("first_seen")
    in_window = (debut >= F.lit(period.start)) & (debut < F.lit(period.this_week))
    week = F.trunc("first_seen", "week").cast("timestamp_ntz").alias("week")
    native = (
        src.first_seen("native_contract", period.this_week)
        .where(in_window)
        .groupBy(week)
        .agg(F.count(F.lit(1)).alias("cadence"))
    )
    by_coa = F.coalesce(is_coa("creator", coa_prefix), F.lit(False))
    evm = (
        src.first_seen("evm_deploy", None)
        .groupBy("contract")
        .agg(F.min("first_seen").alias("first_seen"), F.bool_or(by_coa).alias("is_coa"))
        .where(in_window)
        .groupBy(week)
        .agg(
            F.count_if(F.col("is_coa")).alias("evm_coa"),
            F.count_if(~F.col("is_coa")).alias("evm_eoa"),
        )
    )
    return full_outer_fill(native, evm, "week").orderBy("week")
