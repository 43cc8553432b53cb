"""Transaction fees of both chains.

A native fee is an amount inside an event; it counts once per row of its transaction.
Both sides of that join are aggregated by transaction first, so a transaction with very many
events or rows is one row by the time it is joined.  In the summary the aggregates and the join
share one partitioning by ``tx_id``, and each side is shuffled once.  In the series the events
are summed by transaction and bucket and shuffled once more for the join; there they are at most
one row per transaction and bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallychain.constants import FEE_CONTRACT, FEE_EVENT
from tallychain.functions.rejects import Rejects
from tallychain.functions.scalars import (
    exact_decimal,
    json_text,
    strict_cast,
    strict_sum,
    unreadable,
)
from tallychain.operators.filters import in_complete_buckets, in_period, same_days
from tallychain.operators.windows import cumulative, rolling_mean
from tallychain.period import Period
from tallychain.sources.schemas import EVM_AMOUNT, NATIVE_AMOUNT
from tallychain.sources.tables import Sources

TS = "block_timestamp"
PER_TX, COPIES = T.DecimalType(29, 12), T.DecimalType(8, 0)


def fee_events(
    events: DataFrame, strict: bool = True, rejects: Rejects | None = None
) -> DataFrame:
    """``tx_id, block_timestamp, amount`` of the fee events among native events.

    An amount that cannot be read exactly raises; if not ``strict`` it is NULL and counts in
    ``rejects``, if given.
    """
    events = events.where(
        (F.col("event_contract") == FEE_CONTRACT) & (F.col("event_type") == FEE_EVENT)
    )
    texts = events.select("tx_id", TS, json_text(events, "event_data", "$.amount").alias("text"))
    text = F.col("text")
    if rejects is not None:
        texts = rejects.watch(texts, text, unreadable(text, NATIVE_AMOUNT))
    return texts.select("tx_id", TS, exact_decimal(text, NATIVE_AMOUNT, strict).alias("amount"))


def _mean(total: str, count: str) -> Column:
    return F.col(total).cast("double") / F.nullif(F.col(count), F.lit(0))


def _fees_of_transactions(events: DataFrame, transactions: DataFrame, *by: Column) -> DataFrame:
    """Fee sum and count of events joined to the rows of their transaction, per it and ``by``."""
    per_tx = events.groupBy("tx_id", *by).agg(
        strict_sum("amount").alias("amount"), F.count("amount").alias("n")
    )
    copies = transactions.groupBy("tx_id").agg(F.count(F.lit(1)).alias("copies"))
    keys = [c for c in per_tx.columns if c not in ("tx_id", "amount", "n")]
    # decimal(29,12) x decimal(8,0) is exact in decimal(38,12); anything larger raises.
    fees = strict_cast(F.col("amount"), PER_TX) * strict_cast(F.col("copies"), COPIES)
    return per_tx.join(copies, "tx_id").select(
        *keys, fees.alias("tx_fees"), (F.col("n") * F.col("copies")).alias("tx_count")
    )


def _native_fees(parts: list[tuple[DataFrame, DataFrame]], *by: Column) -> DataFrame:
    """Fee sum and count per ``by``; ``parts`` are events and transactions that share no transaction."""
    each = reduce(DataFrame.unionByName, [_fees_of_transactions(e, t, *by) for e, t in parts])
    keys = [c for c in each.columns if c not in ("tx_fees", "tx_count")]
    return (
        each.groupBy(*keys)
        .agg(
            strict_cast(strict_sum("tx_fees"), EVM_AMOUNT).alias("fees"),
            F.sum("tx_count").alias("fee_count"),
        )
        .select(*keys, "fees", _mean("fees", "fee_count").alias("avg_tx_fee"))
    )


def _evm_fees(transactions: DataFrame, *by: Column) -> DataFrame:
    sums = transactions.groupBy(*by).agg(
        strict_cast(strict_sum("tx_fee"), EVM_AMOUNT).alias("fees"),
        F.count("tx_fee").alias("fee_count"),
    )
    keys = [c for c in sums.columns if c not in ("fees", "fee_count")]
    return sums.select(*keys, "fees", _mean("fees", "fee_count").alias("avg_tx_fee"))


def fees_summary(
    src: Sources, period: Period, strict: bool = True, rejects: Rejects | None = None
) -> DataFrame:
    """Fees since the period start, and the unweighted mean of the two chains' mean fees.

    The native side is bounded by the time of the transaction, not of the event.  With
    ``strict=False`` events whose amount cannot be read count as none; ``rejects`` tells them, among
    all fee events that the period's days hold.
    """
    evm = _evm_fees(in_period(src.evm_tx(), TS, period))
    parts = []
    for part in src.parts():
        events = same_days(part.native_events(), lower=period.start)
        events = fee_events(events, strict and rejects is None, rejects)
        parts.append((events, in_period(part.native_tx(), TS, period)))
    native = _native_fees(parts)
    return evm.unionByName(native).agg(
        strict_sum("fees").alias("total_fees"), F.avg("avg_tx_fee").alias("avg_tx_fee")
    )


def fees_series(
    src: Sources, period: Period, strict: bool = True, rejects: Rejects | None = None
) -> DataFrame:
    """Fees per complete bucket, bounded by the time of the event.

    The chains are merged as a set: if both have the same sum and mean in a bucket,
    that bucket counts it once.  ``strict`` and ``rejects`` are as for `fees_summary`.
    """
    bucket = period.bucket(TS).alias("date")
    evm = _evm_fees(in_complete_buckets(src.evm_tx(), TS, period), bucket)
    parts = []
    for part in src.parts():
        events = in_complete_buckets(part.native_events(), TS, period)
        events = fee_events(events, strict and rejects is None, rejects)
        parts.append((events, same_days(part.native_tx(), period.start, period.cutoff)))
    native = _native_fees(parts, bucket)
    per_bucket = (
        evm.unionByName(native)
        .distinct()
        .groupBy("date")
        .agg(strict_sum("fees").alias("fees"), F.avg("avg_tx_fee").alias("avg_tx_fee"))
    )
    return per_bucket.select(
        "date",
        "fees",
        "avg_tx_fee",
        cumulative("fees", "date").alias("total_fees"),
        rolling_mean("fees", "date").alias("rolling_avg_fees"),
    ).orderBy(F.desc("date"))
