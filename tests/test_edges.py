"""Edge rows, with results worked out by hand."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from inline import InlineSources, actors, at, event, evm_tx, fee_event, native_tx, rows, stake
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallychain.constants import COA_PREFIX, CONTRACT_ADDED_EVENT, DEPLOY_TOPIC
from tallychain.functions import scalars as fn
from tallychain.metrics import accounts, contracts, deployers, fees, supply, transactions
from tallychain.operators import deploys
from tallychain.operators.filters import has_topic, is_coa
from tallychain.period import Period

# A Thursday; the current week starts on Monday the 10th.
AS_OF = date(2024, 6, 13)
WEEK = Period("last_week", AS_OF)
QUARTER = Period("last_3_months", AS_OF)
MONTH = Period("last_month", AS_OF)
ALL = Period("all_time", AS_OF)
UPPER_TOPIC = DEPLOY_TOPIC.upper().replace("0X", "0x")
INIT = "0x60806040"


def day(n: int, month: int = 6) -> datetime:
    return datetime(2024, month, n)


def test_time_bounds_of_kpi_and_series(spark):
    src = InlineSources(
        spark,
        native_tx=[
            native_tx("before", "2024-06-05 23:59:59"),
            native_tx("start", "2024-06-06 00:00:00"),
            native_tx("last", "2024-06-12 23:59:59"),
            native_tx("cutoff", "2024-06-13 00:00:00"),
            native_tx("later", "2024-06-20 00:00:00"),
        ],
    )
    assert rows(transactions.tx_kpis(src, WEEK)) == [
        {"cadence": 4, "evm": 0, "total_transactions": 4}
    ]
    series = rows(transactions.tx_by_type(src, WEEK))
    assert [(r["period"], r["transactions"]) for r in series] == [(day(12), 1), (day(6), 1)]


def test_last_24h_is_yesterday(spark):
    times = ["2024-06-11 23:59:59", "2024-06-12 00:00:00", "2024-06-12 23:00:01", "2024-06-13 00:30:00"]
    src = InlineSources(spark, native_tx=[native_tx(str(i), t) for i, t in enumerate(times)])
    hours = rows(transactions.tx_by_type(src, Period("last_24h", AS_OF)))
    assert [r["period"].hour for r in hours] == [23, 0]


def test_duplicate_transactions_count_once(spark):
    src = InlineSources(
        spark, native_tx=[native_tx("a", "2024-06-10"), native_tx("a", "2024-06-10")]
    )
    assert rows(transactions.tx_kpis(src, WEEK))[0]["cadence"] == 1


def test_first_bucket_label_may_precede_the_start(spark):
    # The period starts on Wednesday, March 13; its week starts on Monday the 11th.
    src = InlineSources(
        spark, native_tx=[native_tx("a", "2024-03-12"), native_tx("b", "2024-03-13")]
    )
    got = rows(transactions.tx_by_type(src, QUARTER))
    assert [(r["period"], r["transactions"]) for r in got] == [(day(11, 3), 1)]


def test_change_text_and_percent(spark):
    counts = {"2024-06-08": 2, "2024-06-09": 4, "2024-06-12": 1}
    txs = [native_tx(f"{d}{i}", d) for d, n in counts.items() for i in range(n)]
    got = rows(transactions.tx_over_time(InlineSources(spark, native_tx=txs), WEEK))
    assert [r["transactions_diff"] for r in got] == ["1 (-3)", "4 (2)", "2 (0)"]
    assert [r["pcg_diff"] for r in got] == [-75.0, 100.0, 0.0]
    assert [r["total_transactions"] for r in got] == [7, 6, 2]
    # The gap on the 10th and 11th is not filled: three rows enter the last mean.
    assert [r["rolling_avg"] for r in got] == [7 / 3, 3.0, 2.0]


def test_percent_after_a_zero(spark):
    from tallychain.operators.windows import pct_change, prev

    df = spark.createDataFrame([(1, 0), (2, 5), (3, 10)], "t int, n bigint")
    pct = pct_change(F.col("n"), prev("n", "t"))
    assert [r.p for r in df.select("t", pct.alias("p")).orderBy("t").collect()] == [None, None, 100.0]


def test_empty_actors_vanish(spark):
    src = InlineSources(
        spark,
        native_actors=[
            actors("a", "2024-06-10"),
            actors("b", "2024-06-10", "x", "y"),
            actors("c", "2024-06-10", "x", "z"),
        ],
    )
    # Only first actors count in the headline figure; the series counts all of them.
    assert rows(accounts.active_accounts_total(src, WEEK)) == [{"total_active_addresses": 1}]
    assert rows(accounts.accounts_created_total(src, WEEK)) == [{"total_new_accounts": 3}]


def test_address_on_both_chains(spark):
    src = InlineSources(
        spark,
        native_actors=[actors("a", "2024-06-10", "same", "n")],
        evm_tx=[evm_tx("h", "2024-06-11", "same")],
    )
    assert rows(accounts.accounts_created_total(src, WEEK))[0]["total_new_accounts"] == 2
    assert rows(accounts.nat_total_accounts(src, WEEK))[0]["total_accounts"] == 3
    got = rows(accounts.nat_series(src, WEEK))
    # On the 11th the address is active again but not new, so that day is left out.
    assert [(r["date"], r["active_users"], r["new_accounts"]) for r in got] == [(day(10), 2, 2)]


def test_same_bucket_on_both_chains(spark):
    src = InlineSources(
        spark,
        native_actors=[actors("a", "2024-06-10", "same")],
        evm_tx=[evm_tx("h", "2024-06-10", "same"), evm_tx("i", "2024-06-10", "other")],
    )
    got = rows(accounts.nat_series(src, WEEK))
    assert [(r["active_users"], r["new_accounts"]) for r in got] == [(3, 2)]


def test_total_accounts_include_midnight_of_today(spark):
    src = InlineSources(
        spark,
        evm_tx=[
            evm_tx("a", "2024-06-13 00:00:00", "in"),
            evm_tx("b", "2024-06-13 00:00:01", "out"),
            evm_tx("c", "2019-12-31 23:59:59", "too old"),
        ],
    )
    assert rows(accounts.nat_total_accounts(src, WEEK))[0]["total_accounts"] == 1
    assert rows(accounts.active_accounts_evm(src, ALL))[0]["total_active_addresses"] == 0


def test_active_series_keeps_partial_month_for_the_total_only(spark):
    src = InlineSources(
        spark,
        native_actors=[actors("a", "2024-05-10", "x"), actors("b", "2024-06-04", "x", "y")],
        evm_tx=[evm_tx("c", "2024-06-12", "z")],
    )
    got = {(r["day"], r["type"]): (r["active_users"], r["rolling_avg"])
           for r in rows(accounts.active_accounts_series(src, ALL))}
    # June starts before the current week, so the total shows it; the chains do not.
    assert got == {
        (day(1, 5), "Cadence"): (1, None),
        (day(1, 5), "EVM + Cadence"): (1, 1.0),
        (day(1, 6), "EVM + Cadence"): (3, 2.0),
    }


def test_active_series_by_day_loses_the_current_week(spark):
    src = InlineSources(
        spark, evm_tx=[evm_tx("a", "2024-06-09", "x"), evm_tx("b", "2024-06-10", "x")]
    )
    got = rows(accounts.active_accounts_series(src, WEEK))
    assert [(r["day"], r["type"]) for r in got] == [(day(9), "EVM"), (day(9), "EVM + Cadence")]


def test_window_relative_debut_differs_from_all_history(spark):
    src = InlineSources(
        spark,
        native_actors=[actors("old", "2024-01-02", "x"), actors("new", "2024-06-05", "x", "y")],
    )
    created = rows(accounts.accounts_created_series(src, MONTH))
    assert [(r["day"], r["daily_new_accounts"]) for r in created] == [(day(5), 2)]
    weekly = rows(accounts.new_accounts_by_week(src, AS_OF))
    assert {r["weeks_ago"]: r["cadence_accounts"] for r in weekly if r["cadence_accounts"]} == {0: 1}


def test_week_table_text(spark):
    src = InlineSources(
        spark,
        native_actors=[actors("a", "2024-05-28", "p", "q"), actors("b", "2024-06-04", "r")],
        evm_tx=[evm_tx("c", "2024-06-09 23:59:59", "s"), evm_tx("d", "2024-06-10", "t")],
    )
    table = {r["new_addresses_created"]: r for r in rows(accounts.new_accounts_week_table(src, ALL))}
    assert len(table) == 6
    native = table["# transacting wallets on Cadence"]
    assert (native["last_full_week"], native["week_ago_1"], native["week_ago_2"]) == ("1", "2", "0")
    change = table["Cadence % Change"]
    # From 2 to 1; from 0 to 2 there is no percentage.
    assert (change["last_full_week"], change["week_ago_1"]) == ("-50.00", None)
    assert table["Total % Change"]["last_full_week"] == "0.00"
    assert table["# total transacting wallets"]["last_full_week"] == "2"


def test_fee_counts_once_per_transaction_row(spark):
    src = InlineSources(
        spark,
        native_tx=[native_tx("a", "2024-06-10"), native_tx("a", "2024-06-10"), native_tx("b", "2024-06-01")],
        native_events=[
            fee_event("a", "2024-06-10", "0.00000001"),
            fee_event("a", "2024-06-10", "2.5"),
            fee_event("b", "2024-06-10", "7"),
            fee_event("missing", "2024-06-10", "100"),
        ],
    )
    # Bounded by the transaction's time: b is too old.
    got = rows(fees.fees_summary(src, WEEK))
    assert got[0]["total_fees"] == Decimal("5.000000020000000000")
    assert got[0]["avg_tx_fee"] == pytest.approx(1.250000005)
    # Bounded by the event's time: b counts.
    assert rows(fees.fees_series(src, WEEK))[0]["fees"] == Decimal("12.000000020000000000")


def test_mean_of_means_and_missing_chain(spark):
    evm = [evm_tx("x", "2024-06-10", "s", "4")]
    src = InlineSources(
        spark,
        evm_tx=evm,
        native_tx=[native_tx("a", "2024-06-10"), native_tx("b", "2024-06-10")],
        native_events=[fee_event("a", "2024-06-10", "1"), fee_event("b", "2024-06-10", "2")],
    )
    assert rows(fees.fees_summary(src, WEEK))[0]["avg_tx_fee"] == (4 + 1.5) / 2
    only_evm = rows(fees.fees_summary(InlineSources(spark, evm_tx=evm), WEEK))
    assert only_evm == [{"total_fees": Decimal("4").quantize(Decimal("1e-18")), "avg_tx_fee": 4.0}]
    assert rows(fees.fees_summary(InlineSources(spark), WEEK)) == [
        {"total_fees": None, "avg_tx_fee": None}
    ]


def test_equal_rows_of_both_chains_count_once(spark):
    src = InlineSources(
        spark,
        evm_tx=[evm_tx("x", "2024-06-10", "s", "3")],
        native_tx=[native_tx("a", "2024-06-10")],
        native_events=[fee_event("a", "2024-06-10", "3")],
    )
    got = rows(fees.fees_series(src, WEEK))
    assert [(r["fees"], r["avg_tx_fee"]) for r in got] == [(Decimal("3"), 3.0)]


def test_amount_that_is_no_number(spark):
    src = InlineSources(spark, native_events=[fee_event("a", "2024-06-10", "lots")])
    with pytest.raises(PySparkException):
        fees.fee_events(src.native_events()).collect()
    assert fees.fee_events(src.native_events(), strict=False).collect()[0].amount is None


def _log(tx_hash: str, contract: str, *topics: str) -> tuple:
    return (tx_hash, contract, list(topics))


def _deploy_sources(spark) -> InlineSources:
    return InlineSources(
        spark,
        evm_tx=[
            evm_tx("both", "2024-06-10", COA_PREFIX, signature=INIT),
            evm_tx("topic", "2024-06-10", "0xuser"),
            evm_tx("sig", "2024-06-11", "0xuser", signature=INIT),
            evm_tx("sig_logs", "2024-06-11", COA_PREFIX + "1", signature=INIT),
            evm_tx("plain", "2024-06-11", "0xother"),
        ],
        evm_logs=[
            _log("both", "c1", UPPER_TOPIC, "second"),
            _log("both", "noise", "0xddf252ad"),
            _log("topic", "c2", DEPLOY_TOPIC),
            _log("topic", "c1", DEPLOY_TOPIC),
            _log("sig_logs", "noise"),
            _log("plain", "noise", "0xddf252ad", DEPLOY_TOPIC),
        ],
    )


def test_topic_is_matched_in_any_case_and_only_first(spark):
    logs = _deploy_sources(spark).evm_logs().where(has_topic("topics"))
    assert sorted(r.contract_address for r in logs.collect()) == ["c1", "c1", "c2"]


def test_deployments_by_contract(spark):
    got = deploys.deploy_contracts(_deploy_sources(spark)).select("contract").collect()
    assert sorted(r.contract for r in got) == ["c1", "c1", "c2", "sig", "sig_logs"]


def test_deploying_transactions(spark):
    got = deploys.deploy_transactions(_deploy_sources(spark)).collect()
    assert sorted(r.tx_hash for r in got) == ["both", "sig", "sig_logs", "topic"]


def test_log_level_ids_count_a_transaction_with_other_logs_too(spark):
    got = deploys.deploy_ids(_deploy_sources(spark)).select("contract").distinct().collect()
    assert sorted(r.contract for r in got) == ["both", "c1", "c2", "sig", "sig_logs"]


def test_only_topic_logs_hide_the_transaction(spark):
    src = InlineSources(
        spark,
        evm_tx=[evm_tx("t", "2024-06-10", "u", signature=INIT)],
        evm_logs=[_log("t", "c", DEPLOY_TOPIC)],
    )
    assert [r.contract for r in deploys.deploy_ids(src).collect()] == ["c"]


def test_deployments_by_creator(spark):
    got = rows(contracts.contracts_by_type(_deploy_sources(spark), WEEK))
    # c1 was deployed by both kinds of creator on the 10th and counts for both.
    assert got == [
        {"day": day(11), "cadence_new": 0, "evm_coa_new": 1, "evm_eoa_new": 1},
        {"day": day(10), "cadence_new": 0, "evm_coa_new": 1, "evm_eoa_new": 2},
    ]


def test_coa_test_is_null_for_a_missing_creator(spark):
    df = spark.createDataFrame([(None,), (COA_PREFIX + "9",), ("0x1",)], "a string")
    got = [tuple(r) for r in df.select(is_coa("a"), ~is_coa("a")).collect()]
    assert got == [(None, None), (True, False), (False, True)]


def test_weekly_contracts_use_all_history(spark):
    src = InlineSources(
        spark,
        native_events=[
            event("a", "2023-01-02", "old", "x"),
            event("b", "2024-06-04", "old", "x"),
            event("c", "2024-06-04", "new", "x"),
            event("d", "2024-06-11", "this week", "x"),
        ],
        evm_tx=[
            evm_tx("t1", "2024-06-03", "0xuser"),
            # A later transaction, after the window, shows a native-owned creator.
            evm_tx("t2", "2024-06-12", COA_PREFIX),
        ],
        evm_logs=[_log("t1", "c", DEPLOY_TOPIC), _log("t2", "c", DEPLOY_TOPIC)],
    )
    assert rows(contracts.weekly_contracts_by_type(src, MONTH)) == [
        {"week": day(3), "cadence": 1, "evm_coa": 1, "evm_eoa": 0}
    ]


def test_deployers_without_authorizers(spark):
    src = InlineSources(
        spark,
        native_tx=[native_tx("a", "2024-06-10", "u", "v"), native_tx("b", "2024-06-10")],
        native_events=[
            event("a", "2024-06-10", "c1", CONTRACT_ADDED_EVENT),
            event("a", "2024-06-11", "c2", CONTRACT_ADDED_EVENT),
            event("b", "2024-06-12", "c3", CONTRACT_ADDED_EVENT),
        ],
    )
    assert rows(deployers.deployers_native_kpi(src, WEEK)) == [{"total_cadence_deployers": 1}]
    got = rows(deployers.deployers_series(src, WEEK))
    # A day whose only deployer is unknown stays, with a count of 0.
    assert [(r["day"], r["new_cadence_deployers"]) for r in got] == [
        (day(12), 0), (day(11), 1), (day(10), 1),
    ]
    assert [r["total_full_deployers"] for r in got] == [2, 2, 1]


def _market(*points: tuple[str, float, float]) -> dict:
    def ms(text: str) -> int:
        return int((at(text) - datetime(1970, 1, 1)).total_seconds() * 1000)

    return {
        "data": {
            "prices": [[ms(d), p] for d, p, _ in points],
            "market_caps": [[ms(d), c] for d, _, c in points],
            "total_volumes": [[ms(d), 1.0] for d, _, _ in points],
        }
    }


def _tvl(**days: float) -> dict:
    def seconds(text: str) -> int:
        return int((at(text) - datetime(1970, 1, 1)).total_seconds())

    return {"data": [{"date": seconds(d.replace("_", "-")[1:]), "tvl": v} for d, v in days.items()]}


def test_supply_parts(spark):
    src = InlineSources(
        spark,
        market=[
            _market(
                ("2024-06-01", 2.0, 1000.0),
                ("2024-06-02", 2.0, 1000.0),
                ("2024-06-03", 2.0, 20.0),
                ("2024-06-04", 0.0, 1000.0),
                ("2024-06-05", 2.0, 1000.0),
                ("2024-06-13", 2.0, 1000.0),
            )
        ],
        tvl=[_tvl(d2024_06_01=10.0, d2024_06_02=10.0, d2024_06_03=10.0, d2024_06_04=10.0)],
        staking_actions=[
            stake("2024-06-01", "TokensCommitted", "100"),
            stake("2024-06-01", "UnstakedTokensWithdrawn", "30"),
            stake("2024-06-02", "DelegatorUnstakedTokensWithdrawn", "50"),
            stake("2024-06-03", "DelegatorTokensCommitted", "5"),
            stake("2024-06-04", "RewardTokensWithdrawn", "999"),
            stake("2024-06-05", "TokensCommitted", "1"),
        ],
    )
    got = {r["date"].day: r for r in rows(supply.supply_series(src, ALL, staked_base=100.0))}
    # Today is left out.
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert (got[1]["staked_locked"], got[1]["unstaked_circulating"]) == (170.0, 320.0)
    assert got[1]["free_circulating_supply"] == 180.0
    # The 2nd has withdrawals only: no stake that day, and nothing in the running total.
    assert got[2]["staked_locked"] is None
    assert got[2]["unstaked_circulating"] is got[2]["free_circulating_supply"] is None
    assert got[3]["staked_locked"] == 175.0
    # Locked parts above the supply floor the remainder at 0.
    assert (got[3]["unstaked_circulating"], got[3]["free_circulating_supply"]) == (0.0, 10.0)
    # A price of 0 gives no supply; a day without locked value gives no remainder.
    assert got[4]["total_supply_actual"] is None
    assert got[5]["non_staked_locked"] is got[5]["unstaked_circulating"] is None
    latest = rows(supply.supply_latest(src, ALL, staked_base=100.0))
    assert [r["date"] for r in latest] == [date(2024, 6, 5)]


def test_null_strict_floor(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (2.0,)], "v double")
    assert [r.f for r in df.select(fn.floor_at_zero(F.col("v")).alias("f")).collect()] == [None, 0.0, 2.0]


def test_locked_value_in_tokens(spark):
    src = InlineSources(
        spark,
        market=[_market(("2024-06-01", 2.0, 1000.0))],
        tvl=[_tvl(d2024_06_01=10.0)],
    )
    got = rows(supply.supply_series(src, ALL, tvl_in_tokens=True))
    assert got[0]["non_staked_locked"] == 5.0
