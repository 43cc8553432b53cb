"""One key holds a third of all rows: results stay whole, and no task gets it all."""

import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallychain.constants import CONTRACT_ADDED_EVENT, DEPLOY_TOPIC, FEE_CONTRACT, FEE_EVENT
from tallychain.metrics import accounts, contracts, deployers, fees, transactions
from tallychain.operators.deploys import deploy_contracts
from tallychain.period import Period
from tallychain.sources.schemas import SCHEMAS
from tallychain.sources.tables import Sources

N = 90_000
HOT = N // 3
AS_OF = Period("last_month", date(2024, 6, 13))


class SkewedSources(Sources):
    """Row ``i`` has its own key, except that the last third shares one."""

    def __init__(self, spark):
        self.spark = spark

    def _rows(self):
        i = F.col("id")
        key = F.when(i >= N - HOT, F.lit("hot")).otherwise(F.concat(F.lit("k"), i))
        return self.spark.range(0, N, numPartitions=8).select(
            i, key.alias("key"), F.lit(datetime(2024, 6, 10)).cast("timestamp_ntz").alias("ts")
        )

    def _as(self, name, *columns):
        names = SCHEMAS[name].names
        return self._rows().select(*[F.expr(c).alias(n) for c, n in zip(columns, names, strict=True)])

    def native_tx(self):
        # Transactions are unique; the hot one is there once.
        return self._as("native_tx", "key", "ts", "array(key)").distinct()

    def evm_tx(self):
        return self._as(
            "evm_tx", "key", "ts", "key", "cast(1 as decimal(38,18))", "'0x60806040'"
        ).distinct()

    def native_events(self):
        kind = f"if(id % 2 = 0, '{FEE_EVENT}', '{CONTRACT_ADDED_EVENT}')"
        return self._as("native_events", "key", "ts", f"'{FEE_CONTRACT}'", kind, "'{\"amount\":\"0.5\"}'")

    def evm_logs(self):
        return self._as("evm_logs", "key", "concat('c', id)", f"array('{DEPLOY_TOPIC}')")

    def native_actors(self):
        return self._as("native_actors", "key", "ts", "array(key, 'hot')")

    def staking_actions(self):
        raise NotImplementedError

    market_payload = tvl_payload = staking_actions


@pytest.fixture(scope="module")
def src(spark):
    return SkewedSources(spark)


KEYS = N - HOT + 1


def test_counts_are_whole(src, settings):
    settings("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert transactions.tx_kpis(src, AS_OF).collect()[0].total_transactions == 2 * KEYS
    created = accounts.accounts_created_series(src, AS_OF).collect()
    assert [r.daily_new_accounts for r in created] == [KEYS]
    combined = accounts.nat_series(src, AS_OF).collect()
    assert [(r.active_users, r.new_accounts) for r in combined] == [(2 * KEYS, KEYS)]
    # Every log names a contract of its own, the hot transaction's logs too.
    kpis = contracts.contracts_kpis(src, AS_OF).collect()[0]
    assert (kpis.total_new_cadence_contracts, kpis.total_new_evm_contracts) == (1, N)
    series = contracts.contracts_series(src, AS_OF).collect()
    assert [r.new_evm_contracts for r in series] == [N]
    added = deployers.deployers_native_kpi(src, AS_OF).collect()[0].total_cadence_deployers
    assert added == (N - HOT) // 2 + 1


def test_fees_of_the_hot_transaction(src, settings):
    settings("spark.sql.autoBroadcastJoinThreshold", "-1")
    total = fees.fees_summary(src, AS_OF).collect()[0].total_fees
    assert float(total) == KEYS + 0.5 * N / 2


def test_fees_are_partially_summed_before_the_shuffle(src, settings):
    """The fee aggregate shuffles at most one row per transaction and map task."""
    settings("spark.sql.adaptive.enabled", "false")
    settings("spark.sql.autoBroadcastJoinThreshold", "-1")
    text = fees.fees_summary(src, AS_OF)._jdf.queryExecution().executedPlan().toString()
    lines = text.splitlines()
    by_tx = re.compile(r"Exchange hashpartitioning\(tx_id#\d+, \d+\)")
    shuffles = [i for i, line in enumerate(lines) if by_tx.search(line)]
    assert len(shuffles) == 2
    below = [next(line for line in lines[i:] if "Aggregate(key" in line) for i in shuffles]
    assert "partial_try_sum(" in below[0] and "partial_count(" in below[1]


def test_a_hot_transaction_is_split_over_tasks(src, settings):
    """The join that carries contract addresses may be split where one hash is hot."""
    settings("spark.sql.autoBroadcastJoinThreshold", "-1")
    settings("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "64KB")
    settings("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.2")
    settings("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    deploys = deploy_contracts(src).groupBy("contract").count()
    assert len(deploys.collect()) == N
    assert "skew=true" in deploys._jdf.queryExecution().executedPlan().toString()
