"""Registration of named queries and the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallychain.constants import COA_PREFIX, DEPLOY_TOPIC, FEE_CONTRACT
from tallychain.sources.fixtures import EventSources, OrderSources

Build = Callable[[OrderSources], DataFrame]


@dataclass(frozen=True)
class Check:
    build: Build
    sources: type[OrderSources]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return decimals_as_double(self.build(self.sources(spark, folder)))


CHECKS: dict[str, Check] = {}


def decimals_as_double(df: DataFrame) -> DataFrame:
    """Exact decimals become doubles at the very end, for comparison only."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)]
    return df.withColumns({n: F.col(n).cast("double") for n in names}) if names else df


def check(
    key: str, sql: str | None, sources: type[OrderSources] = OrderSources
) -> Callable[[Build], Build]:
    """Register ``build`` under ``key``; ``sql`` may name the derived views below."""

    def register(build: Build) -> Build:
        if key in CHECKS:
            raise ValueError(f"{key} is registered twice")
        CHECKS[key] = Check(build, sources, sql and with_views(sql, sources))
        return build

    return register


# The derived source tables in SQL, written apart from their DataFrame form.
_BLOCK_TIME = "o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 24 AS INT)"

ORDER_VIEWS = {
    "native_tx": f"""
        SELECT CAST(o_orderkey AS VARCHAR) AS tx_id, {_BLOCK_TIME} AS block_timestamp,
               CASE WHEN o_orderkey % 50 = 1 THEN CAST([] AS VARCHAR[])
                    ELSE ['0x' || o_custkey] END AS authorizers
        FROM orders WHERE o_orderkey % 3 <> 0""",
    "evm_tx": f"""
        SELECT '0x' || o_orderkey AS tx_hash, {_BLOCK_TIME} AS block_timestamp,
               CASE WHEN o_custkey % 5 = 0 THEN '{COA_PREFIX}' ELSE '0x' END || o_custkey
                 AS from_address,
               CAST(o_totalprice AS DECIMAL(18, 2)) AS tx_fee,
               CASE o_orderpriority WHEN '1-URGENT' THEN '0x60806040'
                    WHEN '2-HIGH' THEN '0x60c06040' ELSE '0xa9059cbb' END
                 AS origin_function_signature
        FROM orders WHERE o_orderkey % 3 = 0""",
    "native_events": f"""
        SELECT CAST(l_orderkey AS VARCHAR) AS tx_id,
               {_BLOCK_TIME} + INTERVAL '1' MINUTE * l_linenumber AS block_timestamp,
               CASE WHEN l_returnflag = 'R' THEN '{FEE_CONTRACT}'
                    ELSE 'A.' || l_partkey END AS event_contract,
               CASE l_returnflag WHEN 'R' THEN 'FeesDeducted'
                    WHEN 'A' THEN 'AccountContractAdded' ELSE 'TokensDeposited' END AS event_type,
               '{{"amount":"' || CAST(l_extendedprice AS DECIMAL(18, 2)) || '"}}' AS event_data
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE o_orderkey % 3 <> 0""",
    "evm_logs": f"""
        SELECT '0x' || l_orderkey AS tx_hash, '0xc' || l_partkey AS contract_address,
               CASE WHEN l_linenumber = 7 THEN CAST([] AS VARCHAR[])
                    WHEN l_returnflag = 'A' THEN ['{DEPLOY_TOPIC.upper()}']
                    ELSE ['0xddf252ad'] END AS topics
        FROM lineitem WHERE l_orderkey % 3 = 0""",
    "native_actors": f"""
        SELECT CAST(o_orderkey AS VARCHAR) AS tx_id, {_BLOCK_TIME} AS block_timestamp,
               CASE WHEN o_orderkey % 50 = 1 THEN CAST([] AS VARCHAR[])
                    WHEN l_returnflag = 'R'
                    THEN ['0x' || o_custkey, '0xs' || l_suppkey, '0x' || o_custkey]
                    ELSE ['0x' || o_custkey, '0xs' || l_suppkey] END AS actors
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE o_orderkey % 3 <> 0""",
    "staking_actions": """
        SELECT l_shipdate AS block_timestamp,
               CASE WHEN day(l_shipdate) = 14 OR (day(l_shipdate) = 13 AND l_returnflag = 'N')
                      OR (l_returnflag = 'R' AND l_linestatus = 'O') THEN 'RewardTokensWithdrawn'
                    WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'TokensCommitted'
                    WHEN l_returnflag = 'N' THEN 'DelegatorTokensCommitted'
                    WHEN l_returnflag = 'A' THEN 'UnstakedTokensWithdrawn'
                    ELSE 'DelegatorUnstakedTokensWithdrawn' END AS action,
               CAST(l_quantity AS DECIMAL(18, 2)) AS amount
        FROM lineitem""",
    "market": """
        SELECT CAST(o_orderdate AS DATE) AS date, max(o_totalprice) / 1e6 AS price,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS market_cap,
               CAST(count(*) AS DOUBLE) AS volume
        FROM orders GROUP BY 1""",
    "tvl": """
        SELECT CAST(l_shipdate AS DATE) AS date,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS protocol_locked
        FROM lineitem GROUP BY 1""",
}

EVENT_VIEWS = {
    "native_tx": """
        SELECT CAST(event_id AS VARCHAR) AS tx_id, ts AS block_timestamp,
               ['0x' || user_id] AS authorizers
        FROM events WHERE event_type NOT IN ('error', 'purchase')""",
    "evm_tx": """
        SELECT '0x' || event_id AS tx_hash, ts AS block_timestamp, '0x' || user_id AS from_address,
               CAST(value AS DECIMAL(18, 2)) AS tx_fee, event_type AS origin_function_signature
        FROM events WHERE event_type IN ('error', 'purchase')""",
    "native_actors": """
        SELECT CAST(event_id AS VARCHAR) AS tx_id, ts AS block_timestamp,
               ['0x' || user_id] AS actors
        FROM events WHERE event_type NOT IN ('error', 'purchase')""",
}


def with_views(body: str, sources: type[OrderSources]) -> str:
    """Put the derived views that ``body`` names in front of it as CTEs."""
    views = EVENT_VIEWS if sources is EventSources else ORDER_VIEWS
    used = [n for n in views if re.search(rf"\b(FROM|JOIN)\s+{n}\b", body)]
    ctes = ",\n".join(f"{n} AS ({views[n]})" for n in used)
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
