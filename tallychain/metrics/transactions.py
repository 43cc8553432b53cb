"""Transaction counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallychain.constants import EVM_LABEL, NATIVE_LABEL
from tallychain.functions.scalars import diff_label
from tallychain.operators.aggregates import count_distinct
from tallychain.operators.filters import in_period
from tallychain.operators.joins import combine_one_row
from tallychain.operators.sketches import approx_distinct, approx_distinct_per_bucket
from tallychain.operators.windows import cumulative, pct_change, prev, rolling_mean
from tallychain.period import Period
from tallychain.sources.tables import Sources


def tx_kpis(src: Sources, period: Period, approximate: bool = False) -> DataFrame:
    """Distinct transactions since the start of the period, per chain and together.

    ``approximate`` counts from daily sketches (see ``operators/sketches.py``).
    """
    if approximate:
        native, evm = (
            approx_distinct(src.daily_sketches(name, period.start, None), alias)
            for name, alias in (("native_tx", "cadence"), ("evm_tx", "evm"))
        )
    else:
        native = in_period(src.native_tx(), "block_timestamp", period)
        native = count_distinct(native, "tx_id", "cadence")
        evm = count_distinct(in_period(src.evm_tx(), "block_timestamp", period), "tx_hash", "evm")
    return combine_one_row(native, evm).withColumn(
        "total_transactions", F.col("cadence") + F.col("evm")
    )


def tx_by_type(src: Sources, period: Period, approximate: bool = False) -> DataFrame:
    """Distinct transactions per complete bucket and chain; ``approximate`` as for `tx_kpis`."""

    def per_bucket(name: str, label: str) -> DataFrame:
        if approximate:
            daily = src.daily_sketches(name, period.start, period.cutoff)
            counts = approx_distinct_per_bucket(daily, period)
        else:
            counts = src.bucket_counts(name, period, period.start, period.cutoff)
        return counts.select(
            F.col("bucket").alias("period"), F.lit(label).alias("type"), F.col("n").alias("transactions")
        )

    return (
        per_bucket("native_tx", NATIVE_LABEL)
        .unionByName(per_bucket("evm_tx", EVM_LABEL))
        .orderBy(F.desc("period"))
    )


def tx_over_time(src: Sources, period: Period, approximate: bool = False) -> DataFrame:
    """Transactions per complete bucket with change, running total and rolling mean."""
    per_bucket = (
        tx_by_type(src, period, approximate)
        .groupBy(F.col("period").alias("time_stamp"))
        .agg(F.sum("transactions").alias("transactions"))
    )
    with_prev = per_bucket.withColumn(
        "prev_period_transactions", prev("transactions", "time_stamp")
    )
    n, before = F.col("transactions"), F.col("prev_period_transactions")
    return with_prev.select(
        "time_stamp",
        "transactions",
        "prev_period_transactions",
        diff_label(n, before).alias("transactions_diff"),
        F.coalesce(pct_change(n, before), F.lit(0.0)).alias("pcg_diff"),
        cumulative("transactions", "time_stamp").alias("total_transactions"),
        rolling_mean("transactions", "time_stamp").alias("rolling_avg"),
    ).orderBy(F.desc("time_stamp"))
