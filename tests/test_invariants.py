"""Relations between metrics that hold for any data."""

import pytest
from inline import rows
from paths import SMALL

from tallychain.metrics import METRICS
from tallychain.operators.reshape import share_of_bucket
from tallychain.period import PERIOD_KEYS
from tallychain.registry.metric_checks import build_metric, fixture_period
from tallychain.sources.fixtures import OrderSources


@pytest.fixture(scope="module")
def src(spark):
    return OrderSources(spark, SMALL)


def run(src, metric, key):
    return rows(build_metric(metric, fixture_period(metric, key), src))


@pytest.mark.parametrize("key", PERIOD_KEYS)
def test_new_accounts_add_up(src, key):
    series = run(src, "accounts_created_series", key)
    total = run(src, "accounts_created_total", key)[0]["total_new_accounts"]
    assert sum(r["daily_new_accounts"] for r in series) == total
    assert (series[0]["total_new_accounts"] if series else 0) == total


@pytest.mark.parametrize(
    ("metric", "value", "total"),
    [
        ("tx_over_time", "transactions", "total_transactions"),
        ("contracts_series", "full_contracts", "total_full_contracts"),
        ("deployers_series", "full_deployers", "total_full_deployers"),
        ("fees_series", "fees", "total_fees"),
    ],
)
def test_last_running_total_is_the_sum(src, metric, value, total):
    series = run(src, metric, "all_time")
    assert series[0][total] == sum(r[value] for r in series)


def test_series_are_sorted_newest_first(src):
    for metric, key in [("tx_over_time", "time_stamp"), ("fees_series", "date"),
                        ("contracts_by_type", "day"), ("nat_series", "date")]:
        times = [r[key] for r in run(src, metric, "all_time")]
        assert times == sorted(times, reverse=True)
    weeks = [r["week"] for r in run(src, "weekly_contracts_by_type", "all_time")]
    assert weeks == sorted(weeks)


def test_active_series_sorts_types_within_a_day(src):
    got = [(r["day"], r["type"]) for r in run(src, "active_accounts_series", "last_year")]
    assert got == sorted(got, key=lambda x: (-x[0].timestamp(), x[1]))


def test_kpi_is_the_sum_of_chains(src):
    row = run(src, "tx_kpis", "last_year")[0]
    assert row["total_transactions"] == row["cadence"] + row["evm"]


def test_combined_series_agrees_with_its_parts(src):
    created = {r["day"]: r["daily_new_accounts"] for r in run(src, "accounts_created_series", "all_time")}
    active = {
        r["day"]: r["active_users"]
        for r in run(src, "active_accounts_series", "all_time")
        if r["type"] == "EVM + Cadence"
    }
    combined = run(src, "nat_series", "all_time")
    assert {r["date"]: r["new_accounts"] for r in combined} == created
    assert all(r["active_users"] == active[r["date"]] for r in combined)


def test_shares_add_up_to_one(src, spark):
    df = METRICS["tx_by_type"](src, fixture_period("tx_by_type", "all_time"))
    sums = {}
    for r in rows(share_of_bucket(df, "period", "transactions")):
        sums[r["period"]] = sums.get(r["period"], 0) + r["share"]
    assert all(abs(s - 1) < 1e-12 for s in sums.values())


def test_latest_supply_is_a_row_of_the_series(src):
    assert run(src, "supply_latest", "all_time")[0] in run(src, "supply_series", "all_time")


def test_supply_reaches_every_branch(src):
    series = run(src, "supply_series", "all_time")
    rest = [r["unstaked_circulating"] for r in series]
    assert any(v is None for v in rest)
    assert any(v == 0 for v in rest)
    assert any(v is not None and v > 0 for v in rest)
