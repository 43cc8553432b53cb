"""Display reshaping, applied to metric frames and whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallychain.constants import EVM_LABEL
from tallychain.metrics import accounts, contracts, fees, supply, transactions
from tallychain.operators import reshape
from tallychain.registry import metric_checks as sql
from tallychain.registry.base import check
from tallychain.registry.operator_checks import ALL
from tallychain.sources import fixtures as fx
from tallychain.sources.fixtures import OrderSources

BARS = {"rolling_avg": "Rolling avg", "transactions": "Transactions"}


def _over(view: str, body: str) -> str:
    """``body`` over a metric's SQL, which it reads as ``m``."""
    return f"WITH m AS ({view}) {body}"


def _bars(src: OrderSources) -> DataFrame:
    return reshape.unpivot_measures(transactions.tx_over_time(src, ALL), ["time_stamp"], BARS)


BARS_SQL = """
    SELECT time_stamp, 'Rolling avg' AS series, rolling_avg AS value FROM m
    UNION ALL SELECT time_stamp, 'Transactions', CAST(transactions AS DOUBLE) FROM m"""


@check(
    "unpivot_measures",
    _over(
        sql.supply_series(ALL),
        " UNION ALL ".join(
            f"SELECT date, '{c}' AS bucket, {c} AS amount FROM m"
            for c in (
                "staked_locked", "non_staked_locked", "liquid_supply", "unstaked_circulating",
            )
        ),
    ),
)
def unpivot_measures(src: OrderSources) -> DataFrame:
    rows = supply.supply_series(src, ALL, fx.STAKED_BASE)
    parts = ["staked_locked", "non_staked_locked", "liquid_supply", "unstaked_circulating"]
    return reshape.unpivot_measures(rows, ["date"], parts, "bucket", "amount")


@check(
    "series_order",
    _over(
        sql.tx_over_time(ALL),
        f"SELECT *, CASE series WHEN 'Rolling avg' THEN 1 ELSE 2 END AS series_order FROM ({BARS_SQL})",
    ),
)
def series_order(src: OrderSources) -> DataFrame:
    return reshape.series_order(_bars(src), "series", list(BARS.values()))


@check(
    "share_of_bucket",
    _over(
        sql.tx_by_type(ALL),
        """SELECT period, type, transactions,
                  transactions / nullif(sum(transactions) OVER (PARTITION BY period), 0) AS share
           FROM m""",
    ),
)
def share_of_bucket(src: OrderSources) -> DataFrame:
    return reshape.share_of_bucket(transactions.tx_by_type(src, ALL), "period", "transactions")


@check(
    "latest_bucket_share",
    _over(
        sql.tx_by_type(ALL),
        """SELECT type, CAST(sum(transactions) AS BIGINT) AS transactions FROM m
           WHERE period = (SELECT max(period) FROM m) GROUP BY type""",
    ),
)
def latest_bucket_share(src: OrderSources) -> DataFrame:
    rows = transactions.tx_by_type(src, ALL)
    return reshape.latest_bucket_share(rows, "period", "type", "transactions")


@check(
    "total_by_type",
    _over(
        sql.contracts_by_chain(ALL),
        "SELECT type, CAST(sum(new_contracts) AS BIGINT) AS new_contracts FROM m GROUP BY type",
    ),
)
def total_by_type(src: OrderSources) -> DataFrame:
    return reshape.total_by_type(contracts.contracts_by_chain(src, ALL), "type", "new_contracts")


@check(
    "sum_by_bucket_series",
    _over(
        sql.tx_over_time(ALL),
        f"SELECT time_stamp, series, sum(value) AS value FROM ({BARS_SQL}) GROUP BY 1, 2",
    ),
)
def sum_by_bucket_series(src: OrderSources) -> DataFrame:
    return reshape.sum_by_bucket_series(_bars(src), "time_stamp", "series", "value")


@check(
    "split_types",
    _over(sql.active_accounts_series(ALL), f"SELECT * FROM m WHERE type = '{EVM_LABEL}'"),
)
def split_types(src: OrderSources) -> DataFrame:
    return reshape.split_types(accounts.active_accounts_series(src, ALL), "type", EVM_LABEL)


@check(
    "coerce_types",
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS amount,
              CASE WHEN event_type <> 'view' THEN date_trunc('second', ts) END AS seen
       FROM events""",
)
def coerce_types(src: OrderSources) -> DataFrame:
    """Numbers and times as text, some of it not parsable, turned back into values."""
    kind = F.col("event_type")
    amount = F.when(kind == "error", "n/a").otherwise(F.col("value").cast("string"))
    seen = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    text = src.table("events").select(
        "event_id", amount.alias("amount"), F.when(kind == "view", "-").otherwise(seen).alias("seen")
    )
    return reshape.coerce_types(text, numbers=("amount",), timestamps=("seen",))


@check(
    "drop_null_keys",
    _over(sql.active_accounts_series(ALL), "SELECT * FROM m WHERE rolling_avg IS NOT NULL"),
)
def drop_null_keys(src: OrderSources) -> DataFrame:
    return reshape.drop_null_keys(accounts.active_accounts_series(src, ALL), "day", "rolling_avg")


@check("sort_by_time", _over(sql.fees_series(ALL), "SELECT * FROM m ORDER BY date"))
def sort_by_time(src: OrderSources) -> DataFrame:
    return reshape.sort_by_time(fees.fees_series(src, ALL), "date")


@check(
    "kpi_format",
    """SELECT l_returnflag, format('{:,}', count(*)) AS row_text,
              format('{:,.2f}', CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE))
                AS price_text,
              coalesce(format('{:,.4f}', CASE WHEN l_returnflag <> 'R' THEN
                CAST(sum(CAST(l_discount AS DECIMAL(18, 2))) AS DOUBLE) END), '—') AS discount_text
       FROM lineitem GROUP BY 1""",
)
def kpi_format(src: OrderSources) -> DataFrame:
    price = F.sum(F.col("l_extendedprice").cast("decimal(18,2)"))
    discount = F.sum(F.col("l_discount").cast("decimal(18,2)"))
    sums = src.table("lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), price.alias("price"), discount.alias("discount")
    )
    shown = F.when(F.col("l_returnflag") != "R", F.col("discount"))
    return sums.select(
        "l_returnflag",
        reshape.kpi_format("n").alias("row_text"),
        reshape.kpi_format("price", 2).alias("price_text"),
        reshape.kpi_format(shown, 4).alias("discount_text"),
    )


@check(
    "normalise_names",
    _over(
        sql.tx_by_type(ALL),
        'SELECT period AS "TS", type AS "TYPE", transactions AS "TX" FROM m',
    ),
)
def normalise_names(src: OrderSources) -> DataFrame:
    rows = transactions.tx_by_type(src, ALL)
    return reshape.normalise_names(rows, {"PERIOD": "TS", "TRANSACTIONS": "TX"})
