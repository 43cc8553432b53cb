"""Tables in buckets by transaction: same results, no shuffle, hot transactions kept apart."""

import re
import uuid

import pytest
from inline import InlineSources, event, evm_tx, fee_event, native_tx, rows
from paths import SMALL
from pyspark.sql import functions as F
from test_plans import plan

from tallychain.constants import DEPLOY_TOPIC, INIT_SIGNATURES
from tallychain.functions.rejects import Rejects
from tallychain.metrics import METRICS
from tallychain.metrics.fees import fees_summary
from tallychain.operators.deploys import deploy_contracts
from tallychain.period import Period
from tallychain.sinks.store import MetricStore
from tallychain.sources.buckets import BucketedSources, land_buckets
from tallychain.sources.fixtures import AS_OF, EPOCH_START, OrderSources

ALL = Period("all_time", AS_OF, EPOCH_START)
BY_TRANSACTION = ("fees_summary", "fees_series", "contracts_kpis", "contracts_series", "contracts_by_type",
                  "contracts_by_chain", "deployers_series", "weekly_contracts_by_type", "tx_kpis")


def landed(src, folder, hot_rows, buckets=4):
    return land_buckets(src, f"copy_{uuid.uuid4().hex}", str(folder), buckets, hot_rows)


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    base = OrderSources(spark, str(SMALL))
    return base, landed(base, tmp_path_factory.mktemp("buckets"), hot_rows=4)


@pytest.mark.parametrize("metric", BY_TRANSACTION)
def test_same_results(orders, metric):
    base, copy = orders
    want = sorted(map(str, rows(METRICS[metric](base, ALL))))
    assert want and sorted(map(str, rows(METRICS[metric](copy, ALL)))) == want


def test_every_row_is_in_one_part(orders):
    base, copy = orders
    for table, key in (("native_tx", "tx_id"), ("native_events", "tx_id"), ("evm_tx", "tx_hash"), ("evm_logs", "tx_hash")):
        bucketed, plain = (getattr(p, table)() for p in copy.parts())
        assert bucketed.count() and plain.count()
        assert bucketed.count() + plain.count() == getattr(base, table)().count()
        assert bucketed.join(plain, key, "left_semi").isEmpty()
        assert bucketed.groupBy(key).count().agg(F.max("count")).first()[0] <= 4


def test_no_exchange_by_transaction_in_buckets(orders, settings):
    settings("spark.sql.autoBroadcastJoinThreshold", "-1")
    settings("spark.sql.sources.bucketing.autoBucketedScan.enabled", "true")
    base, copy = orders
    bucketed = copy.parts()[0]
    for metric in ("fees_summary", "fees_series", "contracts_kpis", "contracts_by_chain"):
        by_key = r"Arguments: hashpartitioning\((tx_id|tx_hash)"
        assert re.search(by_key, plan(METRICS[metric](base, ALL)))
        assert not re.search(by_key, plan(METRICS[metric](bucketed, ALL)))


def test_hot_transactions_and_rows_without_one(spark, tmp_path):
    source = InlineSources(
        spark,
        native_tx=[native_tx("hot", "2024-06-06"), native_tx("cold", "2024-06-07"), native_tx(None, "2024-06-07")],
        evm_tx=[evm_tx("e", "2024-06-06", "0x1", "1", INIT_SIGNATURES[0]), evm_tx(None, "2024-06-06", "0x2", "1")],
        native_events=[
            *[fee_event("hot", "2024-06-06", "0.5") for _ in range(50)], fee_event("hot", "2024-06-06", "bad"),
            fee_event("cold", "2024-06-07", "2"), fee_event("cold", "2024-06-07", "worse"),
            *[fee_event(None, "2024-06-07", "100") for _ in range(5)],
            event("cold", "2024-06-07", "A.1", "AccountContractAdded"),
        ],
        evm_logs=[*[("e", f"0xc{i}", [DEPLOY_TOPIC]) for i in range(20)], (None, "0xd", [DEPLOY_TOPIC])],
    )
    copy = landed(source, tmp_path, hot_rows=10)
    bucketed, plain = copy.parts()
    assert {r.tx_id for r in bucketed.native_events().collect()} == {"cold"}
    assert {r.tx_id for r in plain.native_tx().collect()} == {"hot", None}
    assert bucketed.evm_logs().isEmpty() and plain.evm_logs().count() == 21
    period, found = Period("all_time", AS_OF, EPOCH_START), []
    for src in (source, copy):
        rejects = Rejects()
        fees = rows(fees_summary(src, period, rejects=rejects))
        found.append((fees, rejects.read, rejects.rejected, set(rejects.samples)))
        found.append(sorted(map(str, rows(deploy_contracts(src)))))
    assert found[:2] == found[2:]
    assert found[0][1:] == (58, 2, {"bad", "worse"})


def test_empty_tables_and_copies_that_are_not_there(spark, tmp_path):
    copy = landed(InlineSources(spark), tmp_path, hot_rows=10)
    assert rows(METRICS["tx_kpis"](copy, ALL))[0]["total_transactions"] == 0
    assert rows(METRICS["fees_summary"](copy, ALL))[0]["total_fees"] is None
    with pytest.raises(ValueError, match="no complete copy"):
        BucketedSources(copy.base, "never_made")


def test_the_store_tells_copies_apart(spark, tmp_path):
    source = InlineSources(spark, native_tx=[native_tx("a", "1996-06-06")])
    more = InlineSources(spark, native_tx=[native_tx("a", "1996-06-06"), native_tx("b", "1996-06-07")])
    store = MetricStore(str(tmp_path / "store"))
    for k, src in enumerate((source, more)):
        copy = landed(src, tmp_path / str(k), hot_rows=10)
        assert rows(store.get("tx_kpis", copy, ALL))[0]["cadence"] == k + 1
