"""The source tables derived from order, line-item and event tables.

Every order belongs to exactly one chain and every line item to exactly one kind of
native event or EVM log, so the derived tables together hold all given rows.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallychain.constants import COA_PREFIX, DEPLOY_TOPIC, FEE_CONTRACT
from tallychain.operators.filters import PARTITION_DATE
from tallychain.sources.tables import Sources

# The day the order tables are looked at from, and the start of their history.
AS_OF = date(2001, 8, 1)
EPOCH_START = date(1995, 1, 1)
# Addresses and contracts of these tables nearly all appear in the first months, so
# metrics of first-ever appearances are looked at from an early day.
EARLY_AS_OF = date(1995, 4, 5)
STAKED_BASE = 1.0e6

# A Monday after a Sunday with orders on both chains: that day is not in the current week.
MONDAY = date(2001, 4, 16)

# The event table covers one month; this is a Monday.
EVENTS_AS_OF = date(2024, 1, 29)
EVENTS_EPOCH = date(2024, 1, 1)

# Given schemas: reading a table then needs no pass over file footers.
TABLE_SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
    " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,"
    " value double, props string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,"
    " p_retailprice double",
}


def _money(column: str) -> Column:
    return F.col(column).cast("decimal(18,2)")


class OrderSources(Sources):
    """Chain tables derived from ``orders`` and ``lineitem``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    def _orders(self, native: bool) -> DataFrame:
        on_evm = F.col("o_orderkey") % 3 == 0
        hour = F.expr("INTERVAL '1' HOUR") * (F.col("o_orderkey") % 24).cast("int")
        return (
            self.table("orders")
            .where(~on_evm if native else on_evm)
            .withColumn("block_timestamp", F.col("o_orderdate") + hour)
            # An order date is a midnight, so it is the day of the block time and takes
            # the place of a day partition: bounds on it are pushed to the scan.
            .withColumn(PARTITION_DATE, F.col("o_orderdate"))
        )

    @staticmethod
    def _unless_empty(array: Column) -> Column:
        none = F.array().cast("array<string>")
        return F.when(F.col("o_orderkey") % 50 == 1, none).otherwise(array)

    def native_tx(self) -> DataFrame:
        customer = F.concat(F.lit("0x"), F.col("o_custkey"))
        return self._orders(native=True).select(
            F.col("o_orderkey").cast("string").alias("tx_id"),
            "block_timestamp",
            PARTITION_DATE,
            self._unless_empty(F.array(customer)).alias("authorizers"),
        )

    def evm_tx(self) -> DataFrame:
        owned = F.concat(F.lit(COA_PREFIX), F.col("o_custkey"))
        plain = F.concat(F.lit("0x"), F.col("o_custkey"))
        signature = (
            F.when(F.col("o_orderpriority") == "1-URGENT", "0x60806040")
            .when(F.col("o_orderpriority") == "2-HIGH", "0x60c06040")
            .otherwise("0xa9059cbb")
        )
        return self._orders(native=False).select(
            F.concat(F.lit("0x"), F.col("o_orderkey")).alias("tx_hash"),
            "block_timestamp",
            PARTITION_DATE,
            F.when(F.col("o_custkey") % 5 == 0, owned).otherwise(plain).alias("from_address"),
            _money("o_totalprice").alias("tx_fee"),
            signature.alias("origin_function_signature"),
        )

    def native_events(self) -> DataFrame:
        lines = self.table("lineitem").select(
            "l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_extendedprice"
        )
        orders = self._orders(native=True).select("o_orderkey", "block_timestamp", PARTITION_DATE)
        flag = F.col("l_returnflag")
        amount = F.concat(
            F.lit('{"amount":"'), _money("l_extendedprice").cast("string"), F.lit('"}')
        )
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("l_orderkey").cast("string").alias("tx_id"),
            (F.col("block_timestamp") + F.expr("INTERVAL '1' MINUTE") * F.col("l_linenumber")).alias(
                "block_timestamp"
            ),
            PARTITION_DATE,
            F.when(flag == "R", FEE_CONTRACT)
            .otherwise(F.concat(F.lit("A."), F.col("l_partkey")))
            .alias("event_contract"),
            F.when(flag == "R", "FeesDeducted")
            .when(flag == "A", "AccountContractAdded")
            .otherwise("TokensDeposited")
            .alias("event_type"),
            amount.alias("event_data"),
        )

    def evm_logs(self) -> DataFrame:
        topics = (
            F.when(F.col("l_linenumber") == 7, F.array().cast("array<string>"))
            .when(F.col("l_returnflag") == "A", F.array(F.lit(DEPLOY_TOPIC.upper())))
            .otherwise(F.array(F.lit("0xddf252ad")))
        )
        return (
            self.table("lineitem")
            .where(F.col("l_orderkey") % 3 == 0)
            .select(
                F.concat(F.lit("0x"), F.col("l_orderkey")).alias("tx_hash"),
                F.concat(F.lit("0xc"), F.col("l_partkey")).alias("contract_address"),
                topics.alias("topics"),
            )
        )

    def native_actors(self) -> DataFrame:
        # One row per line of a native order: its customer, its supplier, and the
        # customer again where the line is a fee.
        lines = self.table("lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
        customer = F.concat(F.lit("0x"), F.col("o_custkey"))
        pair = F.array(customer, F.concat(F.lit("0xs"), F.col("l_suppkey")))
        actors = F.when(F.col("l_returnflag") == "R", F.array_append(pair, customer)).otherwise(pair)
        return (
            lines.join(self._orders(native=True), F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.col("o_orderkey").cast("string").alias("tx_id"),
                "block_timestamp",
                PARTITION_DATE,
                self._unless_empty(actors).alias("actors"),
            )
        )

    def staking_actions(self) -> DataFrame:
        # Day 14 of a month has no staking and day 13 no commits: their line items are
        # actions the metrics must ignore.
        flag, status = F.col("l_returnflag"), F.col("l_linestatus")
        day = F.dayofmonth("l_shipdate")
        ignored = (day == 14) | ((day == 13) & (flag == "N")) | ((flag == "R") & (status == "O"))
        action = (
            F.when(ignored, "RewardTokensWithdrawn")
            .when((flag == "N") & (status == "O"), "TokensCommitted")
            .when(flag == "N", "DelegatorTokensCommitted")
            .when(flag == "A", "UnstakedTokensWithdrawn")
            .otherwise("DelegatorUnstakedTokensWithdrawn")
        )
        return self.table("lineitem").select(
            F.col("l_shipdate").alias("block_timestamp"),
            action.alias("action"),
            _money("l_quantity").alias("amount"),
        )

    def market_payload(self) -> DataFrame:
        # One document per month; a document holds at most 31 points per series.
        daily = (
            self.table("orders")
            .groupBy(F.to_date("o_orderdate").alias("day"))
            .agg(
                (F.max("o_totalprice") / F.lit(1e6)).alias("price"),
                F.sum(_money("o_totalprice")).cast("double").alias("cap"),
                F.count(F.lit(1)).cast("double").alias("volume"),
            )
            .withColumn("ms", F.unix_date("day").cast("double") * 86_400_000)
        )
        points = [F.collect_list(F.array("ms", c)) for c in ("price", "cap", "volume")]
        series = F.struct(
            points[0].alias("prices"),
            points[1].alias("market_caps"),
            points[2].alias("total_volumes"),
        )
        return (
            daily.groupBy(F.trunc("day", "month"))
            .agg(series.alias("data"))
            .select(F.to_json(F.struct("data")).alias("payload"))
        )

    def tvl_payload(self) -> DataFrame:
        daily = (
            self.table("lineitem")
            .groupBy(F.to_date("l_shipdate").alias("day"))
            .agg(F.sum(_money("l_extendedprice")).cast("double").alias("tvl"))
        )
        point = F.struct(
            (F.unix_date("day").cast("bigint") * 86_400).alias("date"), F.col("tvl")
        )
        return (
            daily.groupBy(F.trunc("day", "month"))
            .agg(F.collect_list(point).alias("data"))
            .select(F.to_json(F.struct("data")).alias("payload"))
        )


class EventSources(OrderSources):
    """Chain tables derived from ``events``: sub-second times, so hour buckets are full."""

    _EVM_TYPES = ("error", "purchase")

    def _events(self, native: bool) -> DataFrame:
        on_evm = F.col("event_type").isin(*self._EVM_TYPES)
        return self.table("events").where(~on_evm if native else on_evm)

    def native_tx(self) -> DataFrame:
        user = F.concat(F.lit("0x"), F.col("user_id"))
        return self._events(native=True).select(
            F.col("event_id").cast("string").alias("tx_id"),
            F.col("ts").alias("block_timestamp"),
            F.array(user).alias("authorizers"),
        )

    def evm_tx(self) -> DataFrame:
        return self._events(native=False).select(
            F.concat(F.lit("0x"), F.col("event_id")).alias("tx_hash"),
            F.col("ts").alias("block_timestamp"),
            F.concat(F.lit("0x"), F.col("user_id")).alias("from_address"),
            _money("value").alias("tx_fee"),
            F.col("event_type").alias("origin_function_signature"),
        )

    def native_actors(self) -> DataFrame:
        return self.native_tx().withColumnRenamed("authorizers", "actors")
