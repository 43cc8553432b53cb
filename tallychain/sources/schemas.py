"""Schemas of the source tables (stored as Parquet, optionally split by ``block_date``)."""

from pyspark.sql import types as T

# Native amounts: 16 integer digits and 12 decimals (more raises, see ``json_decimal``), which
# leaves room for exact sums and products in 38 digits.  EVM fees have 18 decimals.
NATIVE_AMOUNT = T.DecimalType(28, 12)
EVM_AMOUNT = T.DecimalType(38, 18)

_TS = T.TimestampNTZType()
_STRINGS = T.ArrayType(T.StringType())


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


SCHEMAS = {
    "native_tx": _table(tx_id=T.StringType(), block_timestamp=_TS, authorizers=_STRINGS),
    "evm_tx": _table(
        tx_hash=T.StringType(),
        block_timestamp=_TS,
        from_address=T.StringType(),
        tx_fee=EVM_AMOUNT,
        origin_function_signature=T.StringType(),
    ),
    "native_events": _table(
        tx_id=T.StringType(),
        block_timestamp=_TS,
        event_contract=T.StringType(),
        event_type=T.StringType(),
        event_data=T.StringType(),
    ),
    "evm_logs": _table(tx_hash=T.StringType(), contract_address=T.StringType(), topics=_STRINGS),
    "native_actors": _table(tx_id=T.StringType(), block_timestamp=_TS, actors=_STRINGS),
    "staking_actions": _table(block_timestamp=_TS, action=T.StringType(), amount=NATIVE_AMOUNT),
}

# Landed responses of the market and locked-value services.
MARKET_PAYLOAD = (
    "data struct<prices: array<array<double>>, market_caps: array<array<double>>,"
    " total_volumes: array<array<double>>>"
)
TVL_PAYLOAD = "data array<struct<date: bigint, tvl: double>>"
