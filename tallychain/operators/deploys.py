"""EVM contract deployments.

A transaction deploys a contract if one of its logs carries the deploy topic, or if
its call signature is an init code.  Logs are cut down to the topic before any join.
Keys of the exclusion side are made distinct first, so a transaction with very many
logs is one row there; the side that carries contract addresses is joined by an inner
join, which adaptive execution may split on either side.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallychain.constants import INIT_SIGNATURES
from tallychain.operators.filters import between, has_topic, same_days
from tallychain.sources.tables import Sources


def has_init_signature(signature: str = "origin_function_signature") -> Column:
    return F.col(signature).isin(*INIT_SIGNATURES)


def topic_logs(src: Sources, lower: date | None = None, upper: date | None = None) -> DataFrame:
    """``tx_hash, contract_address`` of the logs that carry the deploy topic.

    Logs have no time of their own; the bounds are those of their transactions.
    """
    logs = same_days(src.deploy_logs(), lower, upper)
    return logs.select("tx_hash", "contract_address")


def topic_transactions(
    src: Sources, lower: date | None = None, upper: date | None = None
) -> DataFrame:
    """Distinct ``tx_hash`` of the topic logs."""
    return topic_logs(src, lower, upper).select("tx_hash").distinct()


def _transactions(src: Sources, lower: date | None, upper: date | None) -> DataFrame:
    return between(src.evm_tx(), "block_timestamp", lower, upper)


def _part_by_part(deploys: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A deployment is a matter of one transaction: parts that share none are asked apart."""

    @wraps(deploys)
    def of_all(src: Sources, lower: date | None = None, upper: date | None = None) -> DataFrame:
        return reduce(DataFrame.unionByName, [deploys(p, lower, upper) for p in src.parts()])

    return of_all


@_part_by_part
def deploy_transactions(
    src: Sources, lower: date | None = None, upper: date | None = None
) -> DataFrame:
    """Transactions that deploy something: ``tx_hash, block_timestamp, creator``.

    The signature is a pushed filter without a join; the others meet the topic logs by a semi
    join, which can be filtered at run time.
    """
    tx = _transactions(src, lower, upper)
    others = tx.where(~F.coalesce(has_init_signature(), F.lit(False)))
    by_topic = others.join(topic_transactions(src, lower, upper), "tx_hash", "left_semi")
    both = tx.where(has_init_signature()).unionByName(by_topic)
    return both.select("tx_hash", "block_timestamp", F.col("from_address").alias("creator"))


@_part_by_part
def deploy_contracts(
    src: Sources, lower: date | None = None, upper: date | None = None
) -> DataFrame:
    """``block_timestamp, creator, contract`` of each deployment.

    The contract is the log's address where the topic is present; a transaction with
    an init signature and no topic log stands for its contract by its own hash.
    """
    tx = _transactions(src, lower, upper)
    by_topic = tx.join(topic_logs(src, lower, upper), "tx_hash").select(
        "block_timestamp",
        F.col("from_address").alias("creator"),
        F.col("contract_address").alias("contract"),
    )
    by_signature = (
        tx.where(has_init_signature() & F.col("tx_hash").isNotNull())
        .join(topic_transactions(src, lower, upper), "tx_hash", "left_anti")
        .select(
            "block_timestamp",
            F.col("from_address").alias("creator"),
            F.col("tx_hash").alias("contract"),
        )
    )
    return by_topic.unionByName(by_signature)


@_part_by_part
def deploy_ids(src: Sources, lower: date | None = None, upper: date | None = None) -> DataFrame:
    """``block_timestamp, contract`` of the log-level view of deployments.

    Each topic log gives its address.  A transaction with an init signature also gives
    its own hash, unless it has logs and all of them carry the topic; so one
    transaction with a topic log and another log gives two ids.
    """
    tx = _transactions(src, lower, upper)
    by_topic = tx.join(topic_logs(src, lower, upper), "tx_hash").select(
        "block_timestamp", F.col("contract_address").alias("contract")
    )
    # Only a transaction with a signature and a topic log can be left out: the aggregate sees
    # the logs of these few.
    signed = tx.where(has_init_signature())
    few = signed.select("tx_hash").distinct().join(
        topic_transactions(src, lower, upper), "tx_hash", "left_semi"
    )
    only_topic = (
        same_days(src.evm_logs(), lower, upper)
        .join(few, "tx_hash", "left_semi")
        .groupBy("tx_hash")
        .agg(F.bool_and(F.coalesce(has_topic("topics"), F.lit(False))).alias("all_topic"))
        .where("all_topic")
        .select("tx_hash")
    )
    by_signature = (
        signed.join(only_topic, "tx_hash", "left_anti")
        .select("block_timestamp", F.col("tx_hash").alias("contract"))
    )
    return by_topic.unionByName(by_signature)
