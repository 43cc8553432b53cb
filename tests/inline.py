"""Sources made of a few rows, for edge cases."""

from __future__ import annotations

import json
from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from tallychain.sources.schemas import SCHEMAS
from tallychain.sources.tables import Sources


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


class InlineSources(Sources):
    """Each table is a list of tuples in schema order; a table not given is empty."""

    def __init__(self, spark: SparkSession, market=(), tvl=(), **tables) -> None:
        self.spark = spark
        self._documents = {"market": market, "tvl": tvl}
        self._rows = tables

    def _table(self, name: str) -> DataFrame:
        return self.spark.createDataFrame(list(self._rows.get(name, [])), SCHEMAS[name])

    def native_tx(self) -> DataFrame:
        return self._table("native_tx")

    def evm_tx(self) -> DataFrame:
        return self._table("evm_tx")

    def native_events(self) -> DataFrame:
        return self._table("native_events")

    def evm_logs(self) -> DataFrame:
        return self._table("evm_logs")

    def native_actors(self) -> DataFrame:
        return self._table("native_actors")

    def staking_actions(self) -> DataFrame:
        return self._table("staking_actions")

    def _payload(self, name: str) -> DataFrame:
        rows = [(d if isinstance(d, str) else json.dumps(d),) for d in self._documents[name]]
        return self.spark.createDataFrame(rows, "payload string")

    def market_payload(self) -> DataFrame:
        return self._payload("market")

    def tvl_payload(self) -> DataFrame:
        return self._payload("tvl")


def native_tx(tx_id: str, time: str, *authorizers: str) -> tuple:
    return (tx_id, at(time), list(authorizers))


def evm_tx(tx_hash, time: str, sender: str, fee: str = "0", signature: str = "0x00") -> tuple:
    return (tx_hash, at(time), sender, Decimal(fee), signature)


def event(tx_id: str, time: str, contract: str, kind: str, data: str = "{}") -> tuple:
    return (tx_id, at(time), contract, kind, data)


def fee_event(tx_id: str, time: str, amount: str) -> tuple:
    from tallychain.constants import FEE_CONTRACT, FEE_EVENT

    return event(tx_id, time, FEE_CONTRACT, FEE_EVENT, json.dumps({"amount": amount}))


def actors(tx_id: str, time: str, *addresses: str) -> tuple:
    return (tx_id, at(time), list(addresses))


def stake(time: str, action: str, amount: str) -> tuple:
    return (at(time), action, Decimal(amount))


def rows(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]
