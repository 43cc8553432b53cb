"""Plans of the metrics on stored tables: what is read, joined and shuffled."""

import re
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from inline import InlineSources, actors, event, evm_tx, fee_event, native_tx, rows, stake

from tallychain.constants import DEPLOY_TOPIC
from tallychain.metrics import METRICS
from tallychain.period import Period
from tallychain.sinks.prepared import PreparedSources
from tallychain.sources.tables import ParquetSources, land_table

DAY = Period("last_month", date(2024, 6, 13))
ALL = Period("all_time", date(2024, 6, 13))
TABLES = ("native_tx", "evm_tx", "native_events", "evm_logs", "native_actors", "staking_actions")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    days = [datetime(2024, 5, 20) + timedelta(days=d) for d in range(24)]
    texts = [d.isoformat() for d in days]
    source = InlineSources(
        spark,
        native_tx=[native_tx(f"n{i}", t, f"u{i % 5}") for i, t in enumerate(texts)],
        evm_tx=[evm_tx(f"e{i}", t, f"v{i % 5}", "1.5", "0x60806040") for i, t in enumerate(texts)],
        native_events=[
            *[fee_event(f"n{i}", t, "0.25") for i, t in enumerate(texts)],
            *[event(f"n{i}", t, f"c{i}", "AccountContractAdded") for i, t in enumerate(texts)],
        ],
        evm_logs=[
            (f"e{i}", f"c{i}", [DEPLOY_TOPIC if i % 3 else "0xddf252ad"]) for i in range(len(texts))
        ],
        native_actors=[actors(f"n{i}", t, f"u{i % 5}", "w") for i, t in enumerate(texts)],
        staking_actions=[stake(t, "TokensCommitted", "10") for t in texts],
    )
    root = tmp_path_factory.mktemp("tables")
    for name in TABLES:
        parents = {"evm_logs": source.evm_tx(), "native_events": source.native_tx(),
                   "native_actors": source.native_tx()}
        land_table(getattr(source, name)(), str(root), name, parents.get(name))
    ms = [int((d - datetime(1970, 1, 1)).total_seconds()) for d in days]
    points = ",".join(f"[{s}000,2.0]" for s in ms)
    (root / "market_payload").mkdir()
    (root / "market_payload" / "a.json").write_text(
        f'{{"data":{{"prices":[{points}],"market_caps":[{points}],"total_volumes":[{points}]}}}}'
    )
    (root / "tvl_payload").mkdir()
    (root / "tvl_payload" / "a.json").write_text(
        '{"data":[' + ",".join(f'{{"date":{s},"tvl":1.0}}' for s in ms) + "]}"
    )
    return ParquetSources(spark, str(root))


def plan(df, mode: str = "formatted") -> str:
    query = df._jdf.queryExecution()
    modes = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode
    return query.explainString(modes.fromString(mode))


@pytest.mark.parametrize("metric", METRICS)
def test_stored_tables_give_rows(stored, metric):
    assert METRICS[metric](stored, ALL).count() > 0


def test_amounts_keep_their_decimals(stored):
    row = METRICS["fees_summary"](stored, ALL).collect()[0]
    assert row.total_fees == Decimal("24") * Decimal("1.75")


@pytest.mark.parametrize("metric", METRICS)
def test_no_nested_loops_and_no_python(stored, metric):
    text = plan(METRICS[metric](stored, ALL))
    for operator in ("NestedLoop", "Cartesian", "Python", "MapInPandas", "MapInArrow"):
        assert operator not in text


@pytest.mark.parametrize("metric", METRICS)
def test_nothing_is_broadcast_by_force(stored, settings, metric):
    """With automatic broadcasts off, every join is planned with shuffles."""
    settings("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert "Broadcast" not in plan(METRICS[metric](stored, ALL))


# Metrics that read all history by definition, or know no period.
WHOLE = {"new_accounts_week_table", "nat_total_accounts", "supply_series", "supply_latest",
         "weekly_contracts_by_type"}


@pytest.mark.parametrize("metric", sorted(set(METRICS) - WHOLE))
def test_start_reaches_the_scan(stored, metric):
    text = plan(METRICS[metric](stored, DAY))
    assert "GreaterThanOrEqual(block_timestamp,2024-05-13T00:00)" in text
    # Day folders are bounded one day more widely than the times.
    assert re.search(r"PartitionFilters: \[.*block_date#\d+ >= 2024-05-12", text)
    # Every table of the metric is pruned by day, also those without a time filter.
    assert len(re.findall(r"PartitionFilters: \[.+\]", text)) == text.count("ReadSchema")


@pytest.mark.parametrize(
    "metric", ["tx_by_type", "accounts_created_series", "fees_series", "contracts_by_type"]
)
def test_cutoff_reaches_the_scan(stored, metric):
    text = plan(METRICS[metric](stored, DAY))
    assert "LessThan(block_timestamp,2024-06-13T00:00)" in text
    assert re.search(r"PartitionFilters: \[.*block_date#\d+ < 2024-06-14", text)


def test_only_needed_columns_are_read(stored):
    text = plan(METRICS["active_accounts_evm"](stored, DAY))
    schemas = re.findall(r"ReadSchema: (\S+)", text)
    assert schemas == ["struct<block_timestamp:timestamp_ntz,from_address:string>"]


def test_each_account_table_is_scanned_once_for_the_combined_series(stored):
    assert plan(METRICS["nat_series"](stored, DAY), "simple").count("FileScan") == 2


def test_fee_join_shuffles_each_side_once(stored, settings):
    settings("spark.sql.autoBroadcastJoinThreshold", "-1")
    text = plan(METRICS["fees_summary"](stored, ALL), "simple")
    assert len(re.findall(r"Exchange hashpartitioning\(tx_id", text)) == 2


def test_deployer_join_shuffles_each_side_once(stored, settings):
    settings("spark.sql.autoBroadcastJoinThreshold", "-1")
    text = plan(METRICS["deployers_series"](stored, ALL), "simple")
    assert len(re.findall(r"Exchange hashpartitioning\(tx_id#", text)) == 2


def test_fee_series_shuffles_the_sums_once_more(stored, settings):
    """By transaction and bucket for the sums, then by transaction on both sides of the join."""
    settings("spark.sql.autoBroadcastJoinThreshold", "-1")
    text = plan(METRICS["fees_series"](stored, ALL), "simple")
    assert len(re.findall(r"Exchange hashpartitioning\(tx_id#", text)) == 3


@pytest.mark.parametrize("metric", ["contracts_by_chain", "deployers_series"])
def test_transactions_meet_topic_logs_by_a_semi_join(stored, settings, metric):
    settings("spark.sql.autoBroadcastJoinThreshold", "-1")
    text = plan(METRICS[metric](stored, ALL))
    assert "LeftSemi" in text and "LeftOuter" not in text
    assert "In(origin_function_signature" in text


def test_log_aggregate_stands_above_a_semi_join(stored, settings):
    settings("spark.sql.autoBroadcastJoinThreshold", "-1")
    text = plan(METRICS["contracts_series"](stored, ALL), "simple")
    at = text.index("bool_and") if "bool_and" in text else text.index("min(coalesce")
    assert "LeftSemi" in text[at:]


def test_deploy_flag_is_pushed(stored):
    text = plan(METRICS["contracts_kpis"](stored, DAY))
    assert "EqualTo(is_deploy,true)" in text or "is_deploy" in re.findall(r"PushedFilters: \[.*\]", text)[0]
    logs = re.findall(r"PartitionFilters: (\[.*\])\nPushedFilters: (\[.*is_deploy.*\])", text)
    assert len(logs) == 2 and all(days != "[]" for days, _ in logs)


@pytest.fixture(scope="module")
def prepared(stored, tmp_path_factory):
    """Nothing kept, some days kept, and more days kept than the period needs."""
    empty = PreparedSources(stored, str(tmp_path_factory.mktemp("prepared")))
    early = empty.advance(date(2024, 5, 24))
    late = early.advance(date(2024, 6, 3)).advance(date(2024, 6, 9))
    return empty, early, late


@pytest.mark.parametrize(
    "metric",
    ["new_accounts_week_table", "contracts_kpis", "contracts_series", "contracts_by_type",
     "deployers_series", "weekly_contracts_by_type"],
)
def test_prepared_sources_give_the_same_rows(stored, prepared, metric):
    period = Period("last_3_months", date(2024, 6, 5))
    want = rows(METRICS[metric](stored, period))
    for sources in prepared:
        assert rows(METRICS[metric](sources, period)) == want


def test_prepared_sources_read_new_days_only(stored, tmp_path):
    prepared = PreparedSources(stored, str(tmp_path)).advance(date(2024, 6, 3))
    text = plan(prepared.first_seen("native_contract", date(2024, 6, 10)))
    assert re.search(r"PartitionFilters: \[.*block_date#\d+ >= 2024-06-02", text)
    with pytest.raises(ValueError, match="already"):
        prepared.advance(date(2024, 6, 3))
    with pytest.raises(ValueError, match="unknown kind"):
        stored.first_seen("nothing", date(2024, 6, 10))
