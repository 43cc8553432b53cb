"""The 24 metrics, with SQL in the literal form of each definition.

The SQL keeps what the DataFrame code rewrites: NOT IN, ROW_NUMBER, range joins,
left joins over raw logs and filters on truncated times.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from tallychain.constants import (
    BOTH_LABEL,
    COA_PREFIX,
    COMMIT_ACTIONS,
    DEPLOY_TOPIC,
    EVM_LABEL,
    FEE_CONTRACT,
    INIT_SIGNATURES,
    NATIVE_LABEL,
    TOKEN_SYMBOL,
    WITHDRAW_ACTIONS,
)
from tallychain.metrics import METRICS
from tallychain.period import PERIOD_KEYS, Period
from tallychain.registry.base import check
from tallychain.sources import fixtures as fx

TOPIC_MATCH = f"{{0}}.topics[1] ILIKE '%{DEPLOY_TOPIC}%'"
SIGNATURES = f"({', '.join(repr(s) for s in INIT_SIGNATURES)})"
AMOUNT = "CAST(json_extract_string(e.event_data, '$.amount') AS DECIMAL(18, 2))"
ROLL = "ROWS BETWEEN 3 PRECEDING AND CURRENT ROW"


def _day(day) -> str:
    return f"DATE '{day.isoformat()}'"


def _bucket(p: Period, ts: str = "block_timestamp") -> str:
    return f"date_trunc('{p.grain}', {ts})"


def _since(p: Period, ts: str = "block_timestamp") -> str:
    return f"{ts} >= {_day(p.start)}"


def tx_kpis(p: Period) -> str:
    return f"""
    WITH n AS (SELECT count(DISTINCT tx_id) AS cadence FROM native_tx WHERE {_since(p)}),
         e AS (SELECT count(DISTINCT tx_hash) AS evm FROM evm_tx WHERE {_since(p)})
    SELECT cadence, evm, cadence + evm AS total_transactions FROM n, e"""


def tx_over_time(p: Period) -> str:
    return f"""
    WITH per_chain AS (
      SELECT {_bucket(p)} AS b, count(DISTINCT tx_id) AS n FROM native_tx WHERE {_since(p)} GROUP BY 1
      UNION ALL
      SELECT {_bucket(p)} AS b, count(DISTINCT tx_hash) AS n FROM evm_tx WHERE {_since(p)} GROUP BY 1),
    per_bucket AS (
      SELECT b, CAST(sum(n) AS BIGINT) AS n FROM per_chain WHERE b < {_day(p.cutoff)} GROUP BY b)
    SELECT b AS time_stamp, n AS transactions, lag(n) OVER w AS prev_period_transactions,
           n || ' (' || coalesce(n - lag(n) OVER w, 0) || ')' AS transactions_diff,
           coalesce((n - lag(n) OVER w) / nullif(lag(n) OVER w, 0) * 100, 0) AS pcg_diff,
           CAST(sum(n) OVER w AS BIGINT) AS total_transactions,
           avg(n) OVER (ORDER BY b {ROLL}) AS rolling_avg
    FROM per_bucket WINDOW w AS (ORDER BY b)"""


def tx_by_type(p: Period) -> str:
    return f"""
    WITH raw AS (
      SELECT {_bucket(p)} AS b, '{NATIVE_LABEL}' AS type, tx_id AS id FROM native_tx WHERE {_since(p)}
      UNION ALL
      SELECT {_bucket(p)} AS b, '{EVM_LABEL}' AS type, tx_hash AS id FROM evm_tx WHERE {_since(p)})
    SELECT b AS period, type, count(DISTINCT id) AS transactions
    FROM raw WHERE b < {_day(p.cutoff)} GROUP BY b, type"""


def active_accounts_total(p: Period) -> str:
    return f"""
    SELECT count(DISTINCT first_actor) AS total_active_addresses
    FROM (SELECT actors[1] AS first_actor, unnest(actors) AS actor FROM native_actors
          WHERE {_since(p)} AND block_timestamp < {_day(p.as_of)})"""


def active_accounts_evm(p: Period) -> str:
    return f"""
    SELECT count(DISTINCT from_address) AS total_active_addresses FROM evm_tx
    WHERE {_since(p)} AND block_timestamp < {_day(p.as_of)}"""


def _active(p: Period) -> str:
    return f"""
      SELECT {_bucket(p)} AS b, '{NATIVE_LABEL}' AS type, count(DISTINCT actor) AS n
      FROM (SELECT block_timestamp, unnest(actors) AS actor FROM native_actors WHERE {_since(p)})
      GROUP BY 1
      UNION ALL
      SELECT {_bucket(p)} AS b, '{EVM_LABEL}' AS type, count(DISTINCT from_address) AS n
      FROM evm_tx WHERE {_since(p)} GROUP BY 1"""


def active_accounts_series(p: Period) -> str:
    return f"""
    WITH base AS ({_active(p)}),
    rows_ AS (
      SELECT b, type, n FROM base WHERE b < {_day(p.cutoff)}
      UNION ALL
      SELECT b, '{BOTH_LABEL}', CAST(sum(n) AS BIGINT) FROM base GROUP BY b),
    rolled AS (
      SELECT b, type, n, CASE WHEN type = '{BOTH_LABEL}'
             THEN avg(n) OVER (PARTITION BY type ORDER BY b {ROLL}) END AS r
      FROM rows_)
    SELECT b AS day, type, n AS active_users, r AS rolling_avg
    FROM rolled WHERE b < {_day(p.this_week)}"""


def new_accounts_week_table(p: Period) -> str:
    monday = _day(p.this_week)
    names = ["last_full_week"] + [f"week_ago_{n}" for n in range(1, 12)]
    rows = {
        "c": "# transacting wallets on Cadence",
        "c_pct": "Cadence % Change",
        "e": "# transacting wallets on EVM",
        "e_pct": "EVM % Change",
        "t": "# total transacting wallets",
        "t_pct": "Total % Change",
    }

    def pct(n: str) -> str:
        before = f"lag({n}) OVER (ORDER BY weeks_ago DESC)"
        ratio = f"({n} - {before}) / nullif({before}, 0) * 100"
        return f"CAST(round({ratio}, 2) AS DECIMAL(18, 2)) AS {n}_pct"

    selects = [
        f"SELECT '{label}' AS new_addresses_created, "
        + ", ".join(
            f"max(CASE WHEN weeks_ago = {i} THEN CAST({col} AS VARCHAR) END) AS {name}"
            for i, name in enumerate(names)
        )
        + " FROM changes"
        for col, label in rows.items()
    ]
    return f"""
    WITH weeks AS (
      SELECT CAST(range AS INT) AS weeks_ago,
             {monday} - INTERVAL 7 DAY * (CAST(range AS INT) + 1) AS lo,
             {monday} - INTERVAL 7 DAY * CAST(range AS INT) AS hi
      FROM range(12)),
    native_first AS (
      SELECT actor, min(block_timestamp) AS t
      FROM (SELECT block_timestamp, unnest(actors) AS actor FROM native_actors) GROUP BY actor),
    evm_first AS (
      SELECT from_address AS actor, min(block_timestamp) AS t FROM evm_tx GROUP BY 1),
    per_week AS (
      SELECT w.weeks_ago,
             (SELECT count(DISTINCT f.actor) FROM native_first f WHERE f.t >= w.lo AND f.t < w.hi) AS c,
             (SELECT count(DISTINCT f.actor) FROM evm_first f WHERE f.t >= w.lo AND f.t < w.hi) AS e
      FROM weeks w),
    totals AS (SELECT *, c + e AS t FROM per_week),
    changes AS (SELECT weeks_ago, c, e, t, {pct("c")}, {pct("e")}, {pct("t")} FROM totals)
    {" UNION ALL ".join(selects)}"""


def _numbered(p: Period) -> str:
    return f"""
    WITH seen AS (
      SELECT {_bucket(p)} AS b, actor FROM (
        SELECT block_timestamp, unnest(actors) AS actor FROM native_actors
        UNION ALL
        SELECT block_timestamp, from_address FROM evm_tx)
      WHERE {_since(p)}),
    numbered AS (
      SELECT b, actor, row_number() OVER (PARTITION BY actor ORDER BY b) AS rn
      FROM seen WHERE b < {_day(p.cutoff)})"""


def accounts_created_total(p: Period) -> str:
    return f"""{_numbered(p)}
    SELECT count(DISTINCT actor) AS total_new_accounts FROM numbered WHERE rn = 1"""


def _created(p: Period) -> str:
    return f"""{_numbered(p)},
    new_ AS (SELECT b, count(DISTINCT actor) AS n FROM numbered WHERE rn = 1 GROUP BY b),
    created AS (
      SELECT b AS day, n AS daily_new_accounts,
             CAST(sum(n) OVER (ORDER BY b) AS BIGINT) AS total_new_accounts,
             avg(n) OVER (ORDER BY b {ROLL}) AS rolling_avg_new_accounts
      FROM new_)"""


def accounts_created_series(p: Period) -> str:
    return f"{_created(p)} SELECT * FROM created"


def nat_total_accounts(p: Period) -> str:
    span = f"block_timestamp >= {_day(p.epoch_start)} AND block_timestamp <= {_day(p.as_of)}"
    return f"""
    WITH counts AS (
      SELECT count(DISTINCT actor) AS n
      FROM (SELECT unnest(actors) AS actor FROM native_actors WHERE {span})
      UNION ALL
      SELECT count(DISTINCT from_address) FROM evm_tx WHERE {span})
    SELECT CAST(sum(n) AS BIGINT) AS total_accounts FROM counts"""


def nat_series(p: Period) -> str:
    return f"""{_created(p)},
    active AS (SELECT b, CAST(sum(n) AS BIGINT) AS n FROM ({_active(p)}) GROUP BY b),
    rolled AS (SELECT b, n, avg(n) OVER (ORDER BY b {ROLL}) AS r FROM active)
    SELECT a.b AS date, a.n AS active_users, a.r AS rolling_avg_active_users,
           c.daily_new_accounts AS new_accounts, c.rolling_avg_new_accounts, c.total_new_accounts
    FROM rolled a JOIN created c ON a.b = c.day"""


_FEE_EVENT = f"e.event_contract = '{FEE_CONTRACT}' AND e.event_type = 'FeesDeducted'"


def fees_summary(p: Period) -> str:
    return f"""
    WITH chains AS (
      SELECT sum(tx_fee) AS fees, avg(tx_fee) AS mean FROM evm_tx WHERE {_since(p)}
      UNION ALL
      SELECT sum({AMOUNT}), avg({AMOUNT})
      FROM native_tx t JOIN native_events e ON t.tx_id = e.tx_id
      WHERE {_since(p, "t.block_timestamp")} AND {_FEE_EVENT})
    SELECT CAST(sum(fees) AS DOUBLE) AS total_fees, avg(mean) AS avg_tx_fee FROM chains"""


def fees_series(p: Period) -> str:
    ts = "e.block_timestamp"
    return f"""
    WITH chains AS (
      SELECT {_bucket(p)} AS b, sum(tx_fee) AS fees, avg(tx_fee) AS mean
      FROM evm_tx WHERE {_since(p)} AND block_timestamp < {_day(p.cutoff)} GROUP BY 1
      UNION
      SELECT {_bucket(p, ts)} AS b, sum({AMOUNT}) AS fees, avg({AMOUNT}) AS mean
      FROM native_tx t JOIN native_events e ON t.tx_id = e.tx_id
      WHERE {_FEE_EVENT} AND {_since(p, ts)} AND {ts} < {_day(p.cutoff)} GROUP BY 1),
    per_bucket AS (SELECT b, sum(fees) AS fees, avg(mean) AS mean FROM chains GROUP BY b)
    SELECT b AS date, CAST(fees AS DOUBLE) AS fees, mean AS avg_tx_fee,
           CAST(sum(fees) OVER (ORDER BY b) AS DOUBLE) AS total_fees,
           CAST(sum(fees) OVER (ORDER BY b {ROLL}) AS DOUBLE)
             / count(fees) OVER (ORDER BY b {ROLL}) AS rolling_avg_fees
    FROM per_bucket"""


def _supply(p: Period, base: float) -> str:
    commits, withdraws = tuple(COMMIT_ACTIONS), tuple(WITHDRAW_ACTIONS)
    return f"""
    WITH points AS (SELECT * FROM market WHERE date < {_day(p.as_of)}),
    supplies AS (SELECT date, market_cap / nullif(price, 0) AS total_supply FROM points),
    staking AS (
      SELECT CAST(block_timestamp AS DATE) AS date, sum(amount) AS v FROM staking_actions
      WHERE action IN {commits} GROUP BY 1),
    unstaking AS (
      SELECT CAST(block_timestamp AS DATE) AS date, sum(amount) AS v FROM staking_actions
      WHERE action IN {withdraws} GROUP BY 1),
    staked AS (
      SELECT s.date, CAST(sum(coalesce(s.v, 0) - coalesce(u.v, 0)) OVER (ORDER BY s.date) AS DOUBLE)
                     + CAST({base} AS DOUBLE) AS v
      FROM staking s LEFT JOIN unstaking u ON s.date = u.date),
    parts AS (
      SELECT p.date, max(s.total_supply) AS total, max(k.v) AS staked,
             max(l.protocol_locked) AS locked, CAST(0.0 AS DOUBLE) AS liquid
      FROM points p LEFT JOIN supplies s ON p.date = s.date
      LEFT JOIN tvl l ON p.date = l.date LEFT JOIN staked k ON p.date = k.date
      GROUP BY p.date),
    rest AS (
      SELECT *, CASE WHEN total - (staked + locked + liquid) IS NOT NULL
                     THEN greatest(total - (staked + locked + liquid), 0) END AS free
      FROM parts)
    SELECT date, '{TOKEN_SYMBOL}' AS token, total AS total_supply_actual, staked AS staked_locked,
           locked AS non_staked_locked, free AS unstaked_circulating, liquid AS liquid_supply,
           total - free AS free_circulating_supply
    FROM rest"""


def supply_series(p: Period) -> str:
    return _supply(p, fx.STAKED_BASE)


def supply_latest(p: Period) -> str:
    return f"""{_supply(p, fx.STAKED_BASE)}
    WHERE date < {_day(p.this_week)} ORDER BY date DESC LIMIT 1"""


def _deploys(where: str, union: str) -> str:
    """Deployments by topic log, then those by signature whose transaction has no such log."""
    return f"""
      SELECT x.block_timestamp AS t, x.from_address AS creator, y.contract_address AS contract
      FROM evm_tx x JOIN evm_logs y ON x.tx_hash = y.tx_hash
      WHERE {TOPIC_MATCH.format("y")} AND {where}
      {union}
      SELECT x.block_timestamp AS t, x.from_address AS creator, x.tx_hash AS contract
      FROM evm_tx x WHERE x.origin_function_signature IN {SIGNATURES} AND {where}
        AND x.tx_hash NOT IN (
          SELECT i.tx_hash FROM evm_tx i JOIN evm_logs j ON i.tx_hash = j.tx_hash
          WHERE {TOPIC_MATCH.format("j")})"""


def contracts_kpis(p: Period) -> str:
    return f"""
    WITH emitters AS (
      SELECT event_contract AS c, min(block_timestamp) FROM native_events WHERE {_since(p)} GROUP BY 1),
    deploys AS ({_deploys(_since(p, "x.block_timestamp"), "UNION")})
    SELECT (SELECT count(DISTINCT c) FROM emitters) AS total_new_cadence_contracts,
           (SELECT count(DISTINCT contract) FROM deploys) AS total_new_evm_contracts"""


def _two_sided(native: str, evm: str, p: Period, names: tuple[str, ...]) -> str:
    new_n, all_n, new_e, all_e, both, all_both, roll = names
    return f"""
    WITH n AS ({native}), e AS ({evm}),
    filled AS (
      SELECT coalesce(n.b, e.b) AS b, coalesce(n.c, 0) AS nc, coalesce(e.c, 0) AS ec
      FROM n FULL JOIN e ON n.b = e.b WHERE coalesce(n.b, e.b) < {_day(p.cutoff)})
    SELECT b AS day, nc AS {new_n}, CAST(sum(nc) OVER w AS BIGINT) AS {all_n},
           ec AS {new_e}, CAST(sum(ec) OVER w AS BIGINT) AS {all_e},
           nc + ec AS {both}, CAST(sum(nc + ec) OVER w AS BIGINT) AS {all_both},
           avg(nc + ec) OVER (ORDER BY b {ROLL}) AS {roll}
    FROM filled WINDOW w AS (ORDER BY b)"""


def contracts_series(p: Period) -> str:
    native = f"""
      SELECT {_bucket(p)} AS b, count(DISTINCT event_contract) AS c
      FROM native_events WHERE {_since(p)} GROUP BY 1"""
    evm = f"""
      SELECT {_bucket(p, "x.block_timestamp")} AS b,
             count(DISTINCT CASE WHEN {TOPIC_MATCH.format("y")} THEN y.contract_address
                                 ELSE x.tx_hash END) AS c
      FROM evm_tx x LEFT JOIN evm_logs y ON x.tx_hash = y.tx_hash
      WHERE ({TOPIC_MATCH.format("y")} OR x.origin_function_signature IN {SIGNATURES})
        AND {_since(p, "x.block_timestamp")}
      GROUP BY 1"""
    return _two_sided(
        native, evm, p,
        ("new_cadence_contracts", "total_cadence_contracts", "new_evm_contracts",
         "total_evm_contracts", "full_contracts", "total_full_contracts",
         "rolling_avg_new_contracts"),
    )


def contracts_by_type(p: Period) -> str:
    def span(ts: str) -> str:
        return f"{_since(p, ts)} AND {ts} < {_day(p.cutoff)}"

    return f"""
    WITH debuts AS (
      SELECT event_contract AS c, min(block_timestamp) AS t
      FROM native_events WHERE {span("block_timestamp")} GROUP BY 1),
    n AS (SELECT {_bucket(p, "t")} AS b, count(DISTINCT c) AS c FROM debuts GROUP BY 1),
    deploys AS ({_deploys(span("x.block_timestamp"), "UNION")}),
    e AS (
      SELECT {_bucket(p, "t")} AS b,
             count(DISTINCT CASE WHEN creator LIKE '{COA_PREFIX}%' THEN contract END) AS coa,
             count(DISTINCT CASE WHEN creator NOT LIKE '{COA_PREFIX}%' THEN contract END) AS eoa
      FROM deploys GROUP BY 1)
    SELECT coalesce(n.b, e.b) AS day, coalesce(n.c, 0) AS cadence_new,
           coalesce(e.coa, 0) AS evm_coa_new, coalesce(e.eoa, 0) AS evm_eoa_new
    FROM n FULL JOIN e ON n.b = e.b"""


def contracts_by_chain(p: Period) -> str:
    return f"""
    WITH chains AS (
      SELECT {_bucket(p)} AS b, '{NATIVE_LABEL}' AS type, count(DISTINCT event_contract) AS n
      FROM native_events WHERE {_since(p)} GROUP BY 1
      UNION ALL
      SELECT {_bucket(p, "x.block_timestamp")}, '{EVM_LABEL}', count(DISTINCT x.tx_hash)
      FROM evm_tx x LEFT JOIN evm_logs y ON x.tx_hash = y.tx_hash
      WHERE ({TOPIC_MATCH.format("y")} OR x.origin_function_signature IN {SIGNATURES})
        AND {_since(p, "x.block_timestamp")}
      GROUP BY 1)
    SELECT b AS day, type, n AS new_contracts FROM chains WHERE b < {_day(p.cutoff)}"""


def deployers_native_kpi(p: Period) -> str:
    return f"""
    SELECT count(DISTINCT t.authorizers[1]) AS total_cadence_deployers
    FROM native_events e JOIN native_tx t ON e.tx_id = t.tx_id
    WHERE {_since(p, "e.block_timestamp")} AND e.event_type = 'AccountContractAdded'"""


def deployers_series(p: Period) -> str:
    native = f"""
      SELECT {_bucket(p, "e.block_timestamp")} AS b, count(DISTINCT t.authorizers[1]) AS c
      FROM native_events e JOIN native_tx t ON e.tx_id = t.tx_id
      WHERE e.event_type = 'AccountContractAdded' AND {_since(p, "e.block_timestamp")}
      GROUP BY 1"""
    evm = f"""
      SELECT {_bucket(p, "t")} AS b, count(DISTINCT creator) AS c
      FROM ({_deploys(_since(p, "x.block_timestamp"), "UNION")}) GROUP BY 1"""
    return _two_sided(
        native, evm, p,
        ("new_cadence_deployers", "total_cadence_deployers", "new_evm_deployers",
         "total_evm_deployers", "full_deployers", "total_full_deployers",
         "rolling_avg_full_deployers"),
    )


def weekly_contracts_by_type(p: Period) -> str:
    span = f"t >= {_day(p.start)} AND t < {_day(p.this_week)}"
    return f"""
    WITH n AS (
      SELECT date_trunc('week', t) AS w, count(*) AS c
      FROM (SELECT event_contract, min(block_timestamp) AS t FROM native_events GROUP BY 1)
      WHERE {span} GROUP BY 1),
    debuts AS (
      SELECT contract, min(t) AS t,
             max(CASE WHEN creator LIKE '{COA_PREFIX}%' THEN 1 ELSE 0 END) AS coa
      FROM ({_deploys("TRUE", "UNION ALL")}) GROUP BY contract),
    e AS (
      SELECT date_trunc('week', t) AS w, CAST(sum(coa) AS BIGINT) AS coa,
             CAST(sum(1 - coa) AS BIGINT) AS eoa
      FROM debuts WHERE {span} GROUP BY 1)
    SELECT coalesce(n.w, e.w) AS week, coalesce(n.c, 0) AS cadence,
           coalesce(e.coa, 0) AS evm_coa, coalesce(e.eoa, 0) AS evm_eoa
    FROM n FULL JOIN e ON n.w = e.w"""


ORACLES: dict[str, Callable[[Period], str]] = {
    "tx_kpis": tx_kpis,
    "tx_over_time": tx_over_time,
    "tx_by_type": tx_by_type,
    "active_accounts_total": active_accounts_total,
    "active_accounts_evm": active_accounts_evm,
    "active_accounts_series": active_accounts_series,
    "new_accounts_week_table": new_accounts_week_table,
    "accounts_created_total": accounts_created_total,
    "accounts_created_series": accounts_created_series,
    "nat_active_total": active_accounts_total,
    "nat_new_total": accounts_created_total,
    "nat_total_accounts": nat_total_accounts,
    "nat_series": nat_series,
    "fees_summary": fees_summary,
    "fees_series": fees_series,
    "supply_latest": supply_latest,
    "supply_series": supply_series,
    "contracts_kpis": contracts_kpis,
    "contracts_series": contracts_series,
    "contracts_by_type": contracts_by_type,
    "contracts_by_chain": contracts_by_chain,
    "deployers_native_kpi": deployers_native_kpi,
    "deployers_series": deployers_series,
    "weekly_contracts_by_type": weekly_contracts_by_type,
}

# Metrics that look at first appearances over all history are seen from an early day.
EARLY = {"new_accounts_week_table", "weekly_contracts_by_type"}
# Metrics registered at every period; the others at all_time only.
EVERY_PERIOD = (
    "tx_over_time",
    "active_accounts_series",
    "accounts_created_series",
    "fees_series",
    "contracts_series",
    "deployers_series",
)


def fixture_period(metric: str, key: str) -> Period:
    as_of = fx.EARLY_AS_OF if metric in EARLY else fx.AS_OF
    return Period(key, as_of, fx.EPOCH_START)


def build_metric(metric: str, period: Period, src):
    options = {"staked_base": fx.STAKED_BASE} if metric.startswith("supply") else {}
    return METRICS[metric](src, period, **options)


def _register(name: str, metric: str, period: Period, sources=fx.OrderSources) -> None:
    sql = ORACLES[metric](period)
    check(name, sql, sources)(partial(build_metric, metric, period))


for _metric in METRICS:
    _register(_metric, _metric, fixture_period(_metric, "all_time"))
for _metric in EVERY_PERIOD:
    for _key in PERIOD_KEYS[1:]:
        _period = fixture_period(_metric, _key)
        if (_metric, _key) == ("active_accounts_series", "last_24h"):
            # Days of the current week are left out, so yesterday shows on a Monday only.
            _period = Period(_key, fx.MONDAY, fx.EPOCH_START)
        _register(f"{_metric}__{_key}", _metric, _period)
for _metric in sorted(EARLY):
    _register(f"{_metric}__late", _metric, Period("all_time", fx.AS_OF, fx.EPOCH_START))
for _metric in ("tx_over_time", "active_accounts_series", "accounts_created_series", "nat_series"):
    _register(
        f"{_metric}__hours",
        _metric,
        Period("last_24h", fx.EVENTS_AS_OF, fx.EVENTS_EPOCH),
        fx.EventSources,
    )
