"""Addresses that take part in transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_actors(df: DataFrame) -> DataFrame:
    """One row per actor of a transaction; a transaction without actors vanishes."""
    return df.select("block_timestamp", F.explode("actors").alias("address"))


def senders(df: DataFrame) -> DataFrame:
    """Senders of EVM transactions in the shape of :func:`explode_actors`."""
    return df.select("block_timestamp", F.col("from_address").alias("address"))
