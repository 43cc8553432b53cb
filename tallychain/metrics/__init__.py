"""The metrics, by name.  Each takes ``(sources, period)`` and returns a DataFrame."""

from collections.abc import Callable

from pyspark.sql import DataFrame

from tallychain.metrics import accounts, contracts, deployers, fees, supply, transactions
from tallychain.period import Period
from tallychain.sources.tables import Sources

Metric = Callable[[Sources, Period], DataFrame]

METRICS: dict[str, Metric] = {
    "tx_kpis": transactions.tx_kpis,
    "tx_over_time": transactions.tx_over_time,
    "tx_by_type": transactions.tx_by_type,
    "active_accounts_total": accounts.active_accounts_total,
    "active_accounts_evm": accounts.active_accounts_evm,
    "active_accounts_series": accounts.active_accounts_series,
    "new_accounts_week_table": accounts.new_accounts_week_table,
    "accounts_created_total": accounts.accounts_created_total,
    "accounts_created_series": accounts.accounts_created_series,
    "nat_active_total": accounts.active_accounts_total,
    "nat_new_total": accounts.accounts_created_total,
    "nat_total_accounts": accounts.nat_total_accounts,
    "nat_series": accounts.nat_series,
    "fees_summary": fees.fees_summary,
    "fees_series": fees.fees_series,
    "supply_latest": supply.supply_latest,
    "supply_series": supply.supply_series,
    "contracts_kpis": contracts.contracts_kpis,
    "contracts_series": contracts.contracts_series,
    "contracts_by_type": contracts.contracts_by_type,
    "contracts_by_chain": contracts.contracts_by_chain,
    "deployers_native_kpi": deployers.deployers_native_kpi,
    "deployers_series": deployers.deployers_series,
    "weekly_contracts_by_type": contracts.weekly_contracts_by_type,
}
