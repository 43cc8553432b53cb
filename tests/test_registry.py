"""Every registered query, and every metric at every period, against DuckDB."""

import pytest
from compare import differences, duck_rows
from paths import SMALL

import __spark_entry__ as contract
from tallychain.metrics import METRICS
from tallychain.period import PERIOD_KEYS
from tallychain.registry import CHECKS
from tallychain.registry.base import decimals_as_double, with_views
from tallychain.registry.metric_checks import ORACLES, build_metric, fixture_period
from tallychain.sources.fixtures import OrderSources


@pytest.mark.parametrize("key", CHECKS)
def test_query_equals_its_sql(spark, duckdb_small, key):
    check = CHECKS[key]
    assert check.sql, "every query has SQL"
    assert duck_rows(duckdb_small, check.sql)[1], "a comparison of no rows with no rows"
    assert differences(check.run(spark, SMALL), duckdb_small, check.sql) == []


# Metrics whose result does not depend on the period key.
NO_PERIOD = {"new_accounts_week_table", "nat_total_accounts", "supply_series", "supply_latest"}
ALIASES = {"nat_active_total", "nat_new_total"}
MATRIX = [
    (metric, key)
    for metric in METRICS
    if metric not in NO_PERIOD | ALIASES
    for key in PERIOD_KEYS[1:]
    if f"{metric}__{key}" not in CHECKS
]


@pytest.mark.parametrize(("metric", "key"), MATRIX)
def test_metric_at_every_period(spark, duckdb_small, metric, key):
    period = fixture_period(metric, key)
    sql = with_views(ORACLES[metric](period), OrderSources)
    df = decimals_as_double(build_metric(metric, period, OrderSources(spark, SMALL)))
    assert differences(df, duckdb_small, sql) == []


def test_contract(spark):
    assert set(CHECKS) <= set(contract.oracle_sql()) <= set(contract.queries())
    assert set(contract.queries()) == set(CHECKS) | set(contract.EXTRA)
    assert set(METRICS) <= set(CHECKS)
    assert contract.entry(spark).count() > 0
