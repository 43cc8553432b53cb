"""Where the metrics read from."""

from __future__ import annotations

import uuid
from abc import ABC, abstractmethod
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallychain.functions.scalars import first_element
from tallychain.operators.accounts import explode_actors, senders
from tallychain.operators.aggregates import debuts_per_bucket, first_seen
from tallychain.operators.filters import PARTITION_DATE, SLACK, between, has_topic
from tallychain.operators.sketches import sketches_per_day
from tallychain.period import Period, grain_bucket
from tallychain.sources import payloads
from tallychain.sources.schemas import SCHEMAS

# Kinds of keys whose first appearance is tracked, and the column that holds them.
FIRST_SEEN_KEYS = {
    "native_address": "address",
    "evm_address": "address",
    "native_contract": "event_contract",
    # A deployed contract with its creator; whether any creator is native-owned is asked later.
    "evm_deploy": ("contract", "creator"),
    # An address on either chain.
    "account": "address",
}
# Kinds of values that are counted per bucket, and those that only daily sketches are asked for.
BUCKET_KEYS = ("native_tx", "evm_tx", "native_active", "evm_active")
DISTINCT_KEYS = (*BUCKET_KEYS, "native_first_actor")


class Sources(ABC):
    """The source relations; subclasses say where they come from."""

    spark: SparkSession

    @abstractmethod
    def native_tx(self) -> DataFrame: ...

    @abstractmethod
    def evm_tx(self) -> DataFrame: ...

    @abstractmethod
    def native_events(self) -> DataFrame: ...

    @abstractmethod
    def evm_logs(self) -> DataFrame: ...

    def parts(self) -> list[Sources]:
        """Sources that share no transaction and together hold all rows of the tables of transactions."""
        return [self]

    def deploy_logs(self) -> DataFrame:
        """The EVM logs that carry the deploy topic."""
        return self.evm_logs().where(has_topic("topics"))

    def dated_keys(self, name: str, lower: date | None, upper: date | None) -> DataFrame:
        """``<key>, block_timestamp`` of the rows in which a kind of key appears."""
        from tallychain.operators.deploys import deploy_contracts

        ts = "block_timestamp"
        match name:
            case "native_address":
                return explode_actors(between(self.native_actors(), ts, lower, upper))
            case "evm_address":
                return senders(between(self.evm_tx(), ts, lower, upper))
            case "native_contract":
                return between(self.native_events(), ts, lower, upper).select("event_contract", ts)
            case "evm_deploy":
                return deploy_contracts(self, lower, upper)
            case "account":
                native = self.dated_keys("native_address", lower, upper)
                return native.unionByName(self.dated_keys("evm_address", lower, upper))
        raise ValueError(f"unknown kind of key {name!r}; expected one of {tuple(FIRST_SEEN_KEYS)}")

    def first_seen(self, name: str, upper: date | None) -> DataFrame:
        """``<key>, first_seen`` of every key that appears before ``upper`` (or at all)."""
        rows = self.dated_keys(name, None, upper)
        return first_seen(rows, FIRST_SEEN_KEYS[name], "block_timestamp")

    def debuts(self, name: str, period: Period) -> DataFrame:
        """``bucket, n``: keys of a kind that are first seen in a complete bucket of the period."""
        rows = self.dated_keys(name, period.start, period.cutoff)
        key = FIRST_SEEN_KEYS[name]
        return debuts_per_bucket(rows, key, "block_timestamp", period, "n", "bucket")

    def counted_rows(self, name: str, lower: date | None, upper: date | None) -> DataFrame:
        """``block_timestamp, key``: the values of a kind that is counted."""
        ts = "block_timestamp"
        match name:
            case "native_tx":
                rows, key = between(self.native_tx(), ts, lower, upper), F.col("tx_id")
            case "evm_tx":
                rows, key = between(self.evm_tx(), ts, lower, upper), F.col("tx_hash")
            case "native_active":
                rows, key = self.dated_keys("native_address", lower, upper), F.col("address")
            case "evm_active":
                rows, key = self.dated_keys("evm_address", lower, upper), F.col("address")
            case "native_first_actor":
                rows = between(self.native_actors(), ts, lower, upper)
                key = first_element("actors")
            case _:
                raise ValueError(f"unknown kind {name!r}; expected one of {DISTINCT_KEYS}")
        return rows.select(ts, key.alias("key"))

    def grain_counts(
        self, name: str, grain: str, lower: date | None, upper: date | None
    ) -> DataFrame:
        """``bucket, n``: exact distinct values per bucket, of the rows inside the bounds."""
        rows = self.counted_rows(name, lower, upper)
        bucket = grain_bucket(grain, "block_timestamp").alias("bucket")
        return rows.groupBy(bucket).agg(F.countDistinct("key").alias("n"))

    def bucket_counts(
        self, name: str, period: Period, lower: date | None, upper: date | None
    ) -> DataFrame:
        """`grain_counts` at the grain of a period."""
        return self.grain_counts(name, period.grain, lower, upper)

    def daily_sketches(self, name: str, lower: date | None, upper: date | None) -> DataFrame:
        """``day, sketch`` of the distinct values of each day inside the bounds."""
        return sketches_per_day(self.counted_rows(name, lower, upper), "block_timestamp", "key")

    def version(self) -> str | None:
        """Changes whenever data is landed; None if the source cannot tell."""
        return None

    @abstractmethod
    def native_actors(self) -> DataFrame: ...

    @abstractmethod
    def staking_actions(self) -> DataFrame: ...

    @abstractmethod
    def market_payload(self) -> DataFrame:
        """One JSON document per row, in the column ``payload``."""

    @abstractmethod
    def tvl_payload(self) -> DataFrame:
        """One JSON document per row, in the column ``payload``."""

    def market_series(self) -> DataFrame:
        """``series, date, value``: all points of the market documents."""
        return payloads.market_series(self.market_payload())

    def tvl_values(self) -> DataFrame:
        """``date, tvl``: all points of the locked-value documents."""
        return payloads.tvl_values(self.tvl_payload())


class ParquetSources(Sources):
    """Tables under one root folder: ``<root>/<table>`` and ``<root>/<payload>`` (JSON files).

    Tables split by ``block_date`` are pruned to the days of a period.  All rows of a
    transaction must lie in the folder of its block's day, as `land_table` writes them.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def _table(self, name: str) -> DataFrame:
        # A block_date partition column is found from the folder names.
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}")

    def version(self) -> str | None:
        """Tells all landings so far from any others."""
        try:
            landings = self.spark.read.parquet(f"{self.root}/{LANDINGS}")
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None
        n, runs = landings.agg(F.count("run"), F.bit_xor(F.xxhash64("run"))).first()
        return f"{n}:{runs}"

    def native_tx(self) -> DataFrame:
        return self._table("native_tx")

    def evm_tx(self) -> DataFrame:
        return self._table("evm_tx")

    def native_events(self) -> DataFrame:
        return self._table("native_events")

    def evm_logs(self) -> DataFrame:
        return self._table("evm_logs")

    def deploy_logs(self) -> DataFrame:
        """The topic logs, by the flag that landing has stored: the scan skips other row groups.

        Files without the flag read as NULL; their logs are tested here.
        """
        schema = T.StructType([*SCHEMAS["evm_logs"], T.StructField(DEPLOY_FLAG, T.BooleanType())])
        logs = self.spark.read.schema(schema).parquet(f"{self.root}/evm_logs")
        flag = F.col(DEPLOY_FLAG)
        maybe = logs.where(flag | flag.isNull())
        return maybe.where(F.coalesce(flag, has_topic("topics"))).drop(DEPLOY_FLAG)

    def native_actors(self) -> DataFrame:
        return self._table("native_actors")

    def staking_actions(self) -> DataFrame:
        return self._table("staking_actions")

    def _documents(self, name: str) -> DataFrame:
        files = self.spark.read.text(f"{self.root}/{name}", wholetext=True)
        return files.withColumnRenamed("value", "payload")

    def market_payload(self) -> DataFrame:
        return self._documents("market_payload")

    def tvl_payload(self) -> DataFrame:
        return self._documents("tvl_payload")

    def market_series(self) -> DataFrame:
        return payloads.split_market_series(self.spark, f"{self.root}/market_payload")

    def tvl_values(self) -> DataFrame:
        return payloads.split_tvl_values(self.spark, f"{self.root}/tvl_payload")


# Tables whose rows belong to a transaction, and the column that names it.
DEPENDENT = {"native_events": "tx_id", "native_actors": "tx_id", "evm_logs": "tx_hash"}
DEPLOY_FLAG = "is_deploy"
#: Folder beside the tables with a row for each landing.
LANDINGS = "landings"
#: Bytes of a row group of landed logs: small enough that few hold rows of both flags.
LOG_ROW_GROUP = 16 << 20


def land_table(
    df: DataFrame,
    root: str,
    name: str,
    transactions: DataFrame | None = None,
    row_group: int = LOG_ROW_GROUP,
) -> None:
    """Write rows of a source table into the day folders of their blocks.

    The days in ``df`` replace those days and no others, so a day can be landed after another
    one, and landed again.  A table of ``DEPENDENT`` takes the day of each row's transaction
    from ``transactions`` (its key and ``block_timestamp``), unless ``df`` has ``block_date``
    already; a row whose own time lies more than a day from it is refused.  EVM logs also get
    a flag for the deploy topic and are sorted by it inside their day, so the flagged ones share few
    row groups (and pages) and scans skip the others.  Each landing is noted beside the tables.

    The rebalance hint groups rows by day and splits the days that are too big for
    one task, so a busy day neither makes one huge file nor one slow task.
    """
    if PARTITION_DATE not in df.columns:
        if name in DEPENDENT:
            if transactions is None:
                raise ValueError(f"{name} needs its transactions, or a {PARTITION_DATE} column")
            df = _with_transaction_day(df, transactions, DEPENDENT[name])
        elif "block_timestamp" in df.columns:
            df = df.withColumn(PARTITION_DATE, F.to_date("block_timestamp"))
        else:
            raise ValueError(f"{name} has neither {PARTITION_DATE} nor block_timestamp")
    if "block_timestamp" in df.columns:
        df = df.withColumn(PARTITION_DATE, _checked_day())
    if name == "evm_logs":
        df = df.withColumn(DEPLOY_FLAG, F.coalesce(has_topic("topics"), F.lit(False)))
    rows = df.hint("rebalance", F.col(PARTITION_DATE))
    options = {}
    if name == "evm_logs":
        rows = rows.sortWithinPartitions(PARTITION_DATE, DEPLOY_FLAG)
        options = {"parquet.block.size": str(row_group)}
    root = root.rstrip("/")
    (
        rows.write.partitionBy(PARTITION_DATE)
        .options(**options)
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(f"{root}/{name}")
    )
    noted = df.sparkSession.range(1).select(
        F.lit(uuid.uuid4().hex).alias("run"), F.lit(name).alias("table")
    )
    noted.coalesce(1).write.mode("append").parquet(f"{root}/{LANDINGS}")


def _with_transaction_day(df: DataFrame, transactions: DataFrame, key: str) -> DataFrame:
    """``df`` with the day of its transaction's block; without one, that of its own time.

    Rows of copies of a transaction share its first day.
    """
    days = transactions.groupBy(F.col(key).alias("_key")).agg(
        F.min(F.to_date("block_timestamp")).alias(PARTITION_DATE)
    )
    joined = df.join(days, F.col(key) == F.col("_key"), "left").drop("_key")
    if "block_timestamp" not in df.columns:
        return joined
    day = F.coalesce(PARTITION_DATE, F.to_date("block_timestamp"))
    return joined.withColumn(PARTITION_DATE, day)


def _checked_day() -> Column:
    """The day folder, or an error if the row's own time is too far from it."""
    day = F.col(PARTITION_DATE).cast("date")
    far = F.abs(F.datediff(F.to_date("block_timestamp"), day)) > SLACK.days
    text = F.concat(
        F.lit("block_date "), day.cast("string"), F.lit(" is more than a day from "),
        F.col("block_timestamp").cast("string"),
    )
    return F.when(far, F.raise_error(text).cast("date")).otherwise(day)
